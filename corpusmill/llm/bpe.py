"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of texts are put into a trie (kept as its
depth-first order: sorted words and the length each shares with the one
before). Walking it depth first, every node gets one state: the last token of
the encoding of the prefix that ends there. It is the one token that ends
there and may follow the state at its start, so a state costs a few look-ups,
whatever was before, and words that share a prefix share its states. A word's
encoding is read off its path backwards. Two tokens may be neighbours if BPE
merges their joined symbols into just these two; such verdicts are kept.

The end-of-word suffix makes the last symbol of a word another one, so the
end of a word is its own kind of node below the prefix before it.

The vocabulary file is a parameter: a ``tokenizers`` JSON with an NFC, blank
folding, lower-case normaliser and a splitting byte-level pre-tokenizer. Rows
stay where they are read: Spark deals the partitions, and each task works in
blocks of bounded size, so that texts and words of any length, and any number
of distinct words, need bounded memory. Nothing is shuffled.

Defined results: null counts as empty and has no tokens. Rows are
independent, so ties, repeated rows and null ids keep a row each. Extra
columns are not read.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from corpusmill.llm.common import table

SUFFIX = "</w>"
#: chunks (text between blanks) of a block, and chunks whose encoding is kept
BLOCK_CHUNKS = 100_000
KEPT_CHUNKS = 1_000_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _ranges(chars: Iterable[str]) -> str:
    """Characters in code point order as the inside of a class."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """The classes of the pattern, written out for ``re`` from the library's
    own Unicode tables (Python's are of another version)."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {k: _ranges(c for piece, _ in Split(Regex(rf"{k}+"), "removed", invert=True).pre_tokenize_str(every) for c in piece)
            for k in (r"\p{L}", r"\p{N}", r"\s")}


def _spelled_out(pattern: str) -> str:
    for k, inside in _classes().items():
        pattern = pattern.replace(f"[{k}]", f"[{inside}]").replace(k, inside)
    return pattern


class _Memo(dict):
    """Keeps what ``of`` gives for a key; starts over beyond ``most`` keys."""

    def __init__(self, of, most: int = 500_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.of(key)
        return out


@lru_cache(maxsize=2)
def prepared(path: str) -> dict:
    """What tasks need of a vocabulary file, as plain values: the driver alone
    reads the file, and its size bounds what is sent."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    out = {
        "ids": model["vocab"], "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "ranks": {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])},
        "words": _spelled_out(pattern), "normalizer": json.dumps(spec["normalizer"]),
        "odd": _ranges(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn"),
    }
    out["last_merge"] = {t: _last_merge(t, out["ranks"]) for t in out["ids"]}
    return out


def _last_merge(token: str, ranks: dict[tuple[str, str], int]) -> tuple[str, str, int] | None:
    """The merge that plain BPE makes last in the token's own symbols; null if
    these do not become the token (then it never comes out), and
    (token, "", -1) for a single symbol."""
    s = [*token[:-5], token[-5:]] if token.endswith(SUFFIX) and len(token) > 4 else list(token)
    last = (token, "", -1)
    while len(s) > 1:
        rank, i = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(s, s[1:])))
        if rank == 1 << 60:
            return None
        last = (s[i], s[i + 1], rank)
        s[i:i + 2] = [s[i] + s[i + 1]]
    return last


class Vocabulary:
    """Token table, merges, and the verdicts on neighbouring tokens; made from
    what :func:`prepared` gives."""

    def __init__(self, spec: dict):
        self.ids: dict[str, int] = spec["ids"]
        self.special: dict[str, int] = spec["special"]
        self.ranks = spec["ranks"]
        self.last_merge = spec["last_merge"]
        self.tokens = [""] * (1 + max(*self.ids.values(), *self.special.values()))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.words = re.compile(spec["words"])
        self.normalizer = Tokenizer.from_str(json.dumps(
            {"version": "1.0", "added_tokens": [], "normalizer": json.loads(spec["normalizer"]), "model": {"type": "BPE", "vocab": {}, "merges": []}})).normalizer
        self.plain = re.compile("[\0-\x1b -\u0377]*\\Z").match  # quick, and true of most texts
        #: characters that Python's tables don't know, and blanks of str.split() alone
        self.odd = re.compile("[\x1c-\x1f" + spec["odd"] + "]")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = str.maketrans({i: c for i, c in enumerate(_byte_symbols())})
        #: every end of a token (a walk backwards stops where no token goes on),
        #: and whether it is one itself
        self.ends = {t[i:]: False for t in self.ids for i in range(len(t))} | dict.fromkeys(self.ids, True)
        self.spine = _Memo(self._spine)
        self.fits = _Memo(self._fits)

    def _spine(self, key: tuple[str, bool]) -> list[tuple[str, float]]:
        """The symbols at the right (or left) end of a token while BPE builds
        it, each with the rank of the merge that swallows it."""
        token, right = key
        one, other, rank = self.last_merge[token]
        inner = self.spine[other if right else one, right] if rank >= 0 else []
        return [*inner[:-1], *((x, rank) for x, _ in inner[-1:]), (token, float("inf"))]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the second may follow the first within a word: while BPE
        builds both, no merge across their border comes first (of equal
        ranks, the leftmost does)."""
        left, right, i, j = self.spine[pair[0], True], self.spine[pair[1], False], 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until == y_until == float("inf"):
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _state(self, word: str, end: int, states: list[str], suffix: str) -> str:
        """The one token that ends at ``end`` and fits the state at its start."""
        ends, start, found = self.ends, end - 1, []
        while start >= 0:
            t = word[start:end] + suffix
            is_token = ends.get(t)
            if is_token is None:
                break
            if is_token:
                found.append((start, t))
            start -= 1
        for start, t in reversed(found):
            if self.last_merge[t] and (not start or self.fits[states[start], t]):
                return t
        raise ValueError(f"no token ends at {end} of {word[:80]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words (in byte symbols), by a depth-first walk."""
        out, before, states = {}, "", [""]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word) - 1, len(states) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1:]  # back up to the node where the paths part
            for end in range(shared + 1, len(word)):
                states.append(self._state(word, end, states, ""))
            last = self._state(word, len(word), states, SUFFIX)
            ids, at = [self.ids[last]], len(word) - len(last) + len(SUFFIX)
            while at:
                ids.append(self.ids[states[at]])
                at -= len(states[at])
            out[word] = ids[::-1]
            before = word
        return out

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Normalised text between blanks; a special token is its own chunk."""
        for part in self.marks.split(text) if "<" in text else (text,):
            if part in self.special:
                yield [part]
            elif part:
                odd = not self.plain(part) and self.odd.search(part)
                if odd:
                    s = self.normalizer.normalize_str(part)
                else:  # letter by letter: no final sigma
                    s = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                yield [c for c in s.split(" ") if c] if odd else s.split()

    def encode_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        parts = {c: None if c in self.special else [
            w.encode().decode("latin-1").translate(self.bytes) for w in self.words.findall(c)] for c in chunks}
        ids = self.encode_words({w for ws in parts.values() if ws for w in ws})
        return {c: _packed([self.special[c]] if ws is None else [i for w in ws for i in ids[w]]) for c, ws in parts.items()}

    def decode(self, ids: Iterable[int]) -> str:
        """What ``decode(ids, skip_special_tokens=False)`` gives without a
        decoder: the tokens, one space between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _packed(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _unpacked(ids: bytes) -> array.array:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a


class _Encoder:
    """Encodes texts block by block, keeping the encodings of chunks."""

    def __init__(self, spec: dict):
        self.vocab, self.kept = Vocabulary(spec), {}

    def _learn(self, chunks: set[str]) -> None:
        new = chunks - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_CHUNKS:
            self.kept.clear()
            new = chunks
        self.kept.update(self.vocab.encode_chunks(new))

    def blocks(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids of its next part) in order."""
        waiting: list[tuple[int, list[str]]] = []
        n = 0

        def flush():
            self._learn({c for _, cs in waiting for c in cs})
            for i, cs in waiting:
                yield i, b"".join(map(self.kept.__getitem__, cs))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.vocab.chunks(text):
                for at in range(0, len(part), BLOCK_CHUNKS):
                    waiting.append((i, part[at:at + BLOCK_CHUNKS]))
                    n += len(waiting[-1][1])
                    if n >= BLOCK_CHUNKS:
                        yield from flush()
                        n = 0
        yield from flush()


def _encoder(spec: dict) -> _Encoder:
    """The encoder of a worker process. It is kept beside the broadcast value,
    so that the worker's later tasks find what the earlier ones have learned
    (verdicts and chunks, both of bounded number)."""
    if "encoder" not in spec:
        spec["encoder"] = _Encoder(spec)
    return spec["encoder"]


def _texts(column: pa.Array) -> Iterator[str]:
    return (x.as_py().decode("utf-8", "replace") if x.is_valid else "" for x in column)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of each row's whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(prepared(path))

    def run(batches):
        enc = _encoder(sent.value)
        for b in batches:
            out = [array.array("I") for _ in range(b.num_rows)]
            for i, ids in enc.blocks(_texts(b.column(1))):
                out[i].extend(_unpacked(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(o) for o in out], pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", id_col: str = "id") -> DataFrame:
    """(id, text) of rows with token ids; null ids give the empty text."""
    id_type = rows.schema[id_col].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(prepared(path))

    def run(batches):
        vocab = _encoder(sent.value).vocab
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vocab.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, text string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text, keeping counts and digests alone: (id,
    n_tokens, ids_sha256, decoded_sha256). Ids and decoded texts of a row pass
    through in blocks and are never whole in memory."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(prepared(path))

    def run(batches):
        enc = _encoder(sent.value)
        for b in batches:
            n, ids_sha, text_sha = [0] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for i, ids in enc.blocks(_texts(b.column(1))):
                if ids_sha[i] is None:
                    ids_sha[i], text_sha[i] = hashlib.sha256(), hashlib.sha256()
                if ids:
                    if n[i]:
                        text_sha[i].update(b" ")
                    n[i] += len(ids) // 4
                    ids_sha[i].update(ids)
                    text_sha[i].update(enc.vocab.decode(_unpacked(ids)).encode())
            none = hashlib.sha256().hexdigest()
            hexed = [[h.hexdigest() if h else none for h in hs] for hs in (ids_sha, text_sha)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *map(pa.array, hexed)],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_trie(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
