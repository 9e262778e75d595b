"""Cross-entropy difference of two matched bigram models.

The *target* model is counted over the texts of good quality, the
*background* model over all texts. They share one vocabulary, one order and one
smoothing, and the background's counts are scaled to the target's number of
tokens, so that their losses differ by what was written and not by size or
vocabulary. With c the counts of a model, N its tokens, V the vocabulary's
size (with one unknown token), ``<s>`` the context of a first token:

    p1(w)   = (c(w) + 1) / (N + V)
    p(w|v)  = (c(v w) + MU * p1(w)) / (c(v) + MU)

c(v) sums c(v w), so each distribution sums to one. A document's score is the
mean over its tokens of the loss under the target model minus the loss under
the background model: the lower, the more it is like the target.

:func:`differences`, which the query runs, keeps every word and pair, so the
model grows with the input and is never in one place. Texts become blocks of
word numbers, written once. Each block sends its distinct words and pairs with
their counts, in buckets of keys; a bucket's task adds up what all blocks sent
and answers each block with the totals of the keys that others have too (of
the rest the block's own counts are the totals). A block is then scored with
the totals of its own keys. A key is sent once a block, so a hot word or pair has
a row per block and no more. The number of buckets grows with the tokens; the
driver sees three sums. Words are known by 64-bit fingerprints, pairs by 64
bits and their bucket.

:func:`learn` and :func:`scored` are for callers who want a small model that
tasks can be sent: words and pairs enter it by their shares of all tokens
(``min_word``, ``min_pair``), which bound it. No query uses them.

Defined results: a null or blank text has no tokens and scores 0. Without any
target text both models are the background's, and all scores are 0. Labels are
taken by id: a null id has none, and an id is good if any of its labels is.
Repeated rows count and score each for themselves. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import blocks, table, written

MIN_WORD = 2e-6
MIN_PAIR = 1e-6
MU = 50.0
_MOST = 500_000  # distinct words or pairs that a task holds before it hands them on
_TOGETHER = 8  # blocks of text that send and get their counts as one
_PER_BUCKET = 1 << 18  # tokens for each bucket of keys
_WORDS, _PAIRS = 0, 1  # kinds of keys
_ROWS = {_WORDS: 4, _PAIRS: 2}  # counts (all, good) as a token and as a context; of a pair
_START, _UNIGRAM = (1 << 32) - 1, (1 << 32) - 2  # contexts that are no words


def words(text: str) -> list[str]:
    return text.lower().split()


def _texts(column):
    return (x.as_py().decode("utf-8", "replace") if x.is_valid else "" for x in column)


def _parts(texts):
    """Blocks of (number of the text, part, whether it is the first one)."""
    return blocks(texts, lambda c: not c.isspace())


def _word_counts(batches):
    """Task: (text) -> (word, n)."""

    def given(sums):
        return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])

    sums = Counter()
    for b in batches:
        for block in _parts(enumerate(_texts(b.column(0)))):
            for _, part, _ in block:
                sums.update(words(part))
            if len(sums) > _MOST:
                yield given(sums)
                sums = Counter()
    yield given(sums)


class Tokens:
    """Word ids of blocks: 0 is the unknown word."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}

    def pairs(self, texts):
        """(number of the text, context, token) arrays, block by block."""
        last = _START
        for block in _parts(texts):
            row, context, token = [], [], []
            for i, part, first in block:
                ws = words(part)
                ids = np.fromiter(map(self.ids.get, ws, repeat(0)), np.int64, len(ws))
                if first:
                    last = _START
                if len(ids):
                    row.append(np.full(len(ids), i))
                    context.append(np.r_[last, ids[:-1]])
                    token.append(ids)
                    last = ids[-1]
            if row:
                yield np.concatenate(row), np.concatenate(context), np.concatenate(token)


def _code(context, token):
    """One long for a pair, in the order of (context, token)."""
    return (context - (1 << 31)) * (1 << 32) + token


def _pair_counts(vocabulary):
    """Task: (text, good) -> (gram, n, n_good), pairs and single tokens."""

    def run(batches):
        tokens = Tokens(vocabulary.value)
        held, size = [], 0

        def merged():
            code, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return code, *(np.bincount(at, np.concatenate([h[k] for h in held])).astype(np.int64) for k in (1, 2))

        def given(code, n, good):
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.array(good)], ["gram", "n", "n_good"])

        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, context, token in tokens.pairs(enumerate(_texts(b.column(0)))):
                codes = np.r_[_code(context, token), _code(np.full(len(token), _UNIGRAM), token)]
                code, at = np.unique(codes, return_inverse=True)
                held.append((code, np.bincount(at), np.bincount(at, np.tile(good[row], 2))))
                size += len(code)
                if size > 2 * _MOST:
                    one = merged()
                    if len(one[0]) > _MOST:
                        yield given(*one)
                        held, size = [], 0
                    else:
                        held, size = [one], len(one[0])
        if held:
            yield given(*merged())

    return run


@dataclass
class Model:
    """``code``: known pairs in order; ``pair``, ``context``, ``one``: for
    (target, background) the counts of pairs, of contexts (in the order of
    their ids, ``<s>`` last) and the probabilities of single tokens."""

    vocabulary: list[str]
    code: np.ndarray
    pair: np.ndarray
    context: np.ndarray
    one: np.ndarray
    mu: float

    def losses(self, texts, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, summed losses under target and background) of each text."""
        texts = list(texts)
        n, loss = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)))
        for row, context, token in tokens.pairs(enumerate(texts)):
            n += np.bincount(row, minlength=len(texts))
            code = _code(context, token)
            at = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
            known = self.code[at] == code if len(self.code) else np.zeros(len(code), bool)
            c = np.minimum(context, len(self.vocabulary) + 1)
            for k in range(2):
                pair = np.where(known, self.pair[k][at], 0.0) if len(self.code) else 0.0
                p = (pair + self.mu * self.one[k][token]) / (self.context[k][c] + self.mu)
                loss[k] += np.bincount(row, -np.log(p), minlength=len(texts))
        return n, loss


def _target(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text, good) of every row."""
    # labels grow with the documents: no size at which they may be broadcast
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct().hint("merge")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(
        good, F.col("id") == F.col("good_id"), "left").select("id", "text", F.col("good_id").isNotNull().alias("good"))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_word: float = MIN_WORD,
          min_pair: float = MIN_PAIR, mu: float = MU) -> Model:
    """Count both models over all documents."""
    counts = written(docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_word_counts, "word string, n long").groupBy(
        "word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    vocabulary = counts.where(F.col("n") >= min_word * total).select("word").orderBy("word").toArrow().column(0).to_pylist()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    grams = written(_target(docs, labels, text_col, id_col).select("text", "good").mapInArrow(_pair_counts(sent), "gram long, n long, n_good long").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("n_good").alias("n_good")), "grams")
    first_single = _code(_UNIGRAM, 0)
    is_single = (F.col("gram") >= first_single) & (F.col("gram") < _code(_START, 0))
    n_good = grams.where(is_single).agg(F.sum("n_good")).first()[0] or 0
    common = (F.col("n") >= min_pair * total) | (F.col("n_good") >= min_pair * n_good) & (F.col("n_good") > 0)
    kept = grams.where(is_single | common).orderBy("gram").toArrow()
    code, n, good = (kept.column(k).to_numpy() for k in range(3))
    size = len(vocabulary) + 1
    both = np.stack([good if n_good else n, n]).astype(float)
    if n_good:
        both[1] *= n_good / max(total, 1)  # matched: as many tokens as the target
    single = (code >= first_single) & (code < _code(_START, 0))
    one = np.ones((2, size))
    one[:, code[single] - first_single] += both[:, single]
    one /= one.sum(axis=1, keepdims=True)
    pairs, context = code[~single], np.zeros((2, size + 1))
    at = np.minimum((pairs >> 32) + (1 << 31), size)
    for k in range(2):
        np.add.at(context[k], at, both[k][~single])
    return Model(vocabulary, pairs, both[:, ~single], context, one, mu)


def scored(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (means per token), score."""
    # plain values: a task can read them without this package on its path
    sent = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.code, model.pair, model.context, model.one, model.mu))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Model(*sent.value)
        tokens = Tokens(model.vocabulary)
        for b in batches:
            n, loss = model.losses(_texts(b.column(1)), tokens)
            mean = loss / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, mean[0], mean[1], mean[0] - mean[1]))],
                                             ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_tokens long, loss_target double, loss_background double, score double")


_ENCODED = "block long, tokens long, good_tokens long, row binary, size binary, good binary, stream binary, words binary"


def _encoded(batches):
    """Task: (id, text, good) -> blocks. ``row``, ``ids``, ``size`` (tokens) and
    ``good`` of each text or part of one; ``stream``: for each, the context of
    its first token and its tokens, as places in ``words`` (fingerprints), where
    the first place is that of ``<s>``."""
    base = TaskContext.get().partitionId() << 40
    numbers, blocks_done, id_type = count(), count(), pa.null()
    number, held = defaultdict(count(1).__next__), []

    def texts():
        nonlocal id_type
        for b in batches:
            id_type = b.schema.field(0).type
            for i, text, good in zip(b.column(0), _texts(b.column(1)), b.column(2)):
                yield (base + next(numbers), i.as_py(), good.as_py()), text

    def given():
        keys, codes = zip(*held)
        row, ids, good = zip(*keys)
        size = np.array([len(c) - 1 for c in codes], np.int64)
        good = np.array(good, np.uint8)
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in chain([" "], number)), np.uint64, len(number) + 1)
        cols = [base + next(blocks_done), int(size.sum()), int(size[good > 0].sum())]
        binary = [np.array(row, np.int64).tobytes(), size.tobytes(), good.tobytes(), _planes(np.concatenate(codes)), known.tobytes()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([c], pa.int64()) for c in cols), *(pa.array([c], pa.binary()) for c in binary), pa.array([ids], pa.list_(id_type))],
            [*(c.split()[0] for c in _ENCODED.split(", ")), "ids"])

    last, taken = None, 0
    for block in _parts(texts()):
        for key, part, first in block:
            ws = words(part)
            if first:
                last = None
            lead = 0 if last is None else number[last]
            held.append((key, np.fromiter(chain([lead], map(number.__getitem__, ws)), np.uint32, len(ws) + 1)))
            if ws:
                last = ws[-1]
        taken += 1
        if taken == _TOGETHER:
            yield given()
            number, held, taken = defaultdict(count(1).__next__), [], 0
    if held:
        yield given()


def _planes(ints) -> bytes:
    """Integers as their first bytes, then their second ones, up to the highest
    that any needs: small numbers compress to little."""
    x = np.ascontiguousarray(ints, np.int64).reshape(-1)
    width = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _ints(planes: bytes, rows: int, n: int) -> np.ndarray:
    """``rows`` of ``n`` integers from their planes."""
    x = np.zeros((rows * n, 8), np.uint8)
    if len(x):
        x[:, :len(planes) // len(x)] = np.frombuffer(planes, np.uint8).reshape(-1, len(x)).T
    return x.view(np.int64).reshape(rows, n)


def _mixed(x):
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Block:
    """Distinct words (by their places) and pairs of a block, their counts, and
    their order by bucket."""

    def __init__(self, size, good, stream, known, n_buckets):
        self.size, good, known = (np.frombuffer(c, t) for c, t in zip((size, good, known), (np.int64, np.uint8, np.uint64)))
        stream = _ints(stream, 1, self.size.sum() + len(self.size))[0]
        inside = np.ones(len(stream), bool)
        inside[np.cumsum(self.size + 1) - self.size - 1] = False
        at = np.flatnonzero(inside)
        context, token = stream[at - 1].astype(np.uint64), stream[at].astype(np.uint64)
        weight = good.repeat(self.size).astype(float)
        code, self.at = np.unique((context << np.uint64(32)) | token, return_inverse=True)
        self.context, self.token = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64((1 << 32) - 1)).astype(np.int64)
        pairs = np.stack([np.bincount(self.at, minlength=len(code)), np.bincount(self.at, weight, len(code))])
        self.counts = {_PAIRS: pairs, _WORDS: np.stack([np.bincount(by, n, len(known)) for by in (self.token, self.context) for n in pairs])}
        a, b = known[self.context], known[self.token]
        self.keys = {_WORDS: known, _PAIRS: _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)}
        # other bits than the key's: with the bucket, they tell more pairs apart
        spread = {_WORDS: _mixed(known), _PAIRS: _mixed(a * np.uint64(0xD6E8FEB86659FD93) + _mixed(b))}
        self.order, self.cuts = {}, {}
        for kind, n in n_buckets.items():
            bucket = spread[kind] % np.uint64(n)
            self.order[kind] = np.argsort(bucket, kind="stable")
            self.cuts[kind] = np.searchsorted(bucket[self.order[kind]], np.arange(n + 1, dtype=np.uint64))

    def bucket(self, kind, k):
        return self.order[kind][self.cuts[kind][k]:self.cuts[kind][k + 1]]


def _sent(n_buckets):
    """Task: blocks -> keys and counts of each block and bucket."""

    def run(batches):
        for b in batches:
            for block, *cols in zip(*(c.to_pylist() for c in b.columns)):
                x = _Block(*cols, n_buckets)
                for kind, n in n_buckets.items():
                    used = np.flatnonzero(np.diff(x.cuts[kind]))
                    at = [x.bucket(kind, k) for k in used]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), kind)), pa.array(used), pa.array(np.full(len(used), block)),
                         pa.array([x.keys[kind][o].tobytes() for o in at], pa.binary()),
                         pa.array([_planes(x.counts[kind][:, o]) for o in at], pa.binary())],
                        ["kind", "bucket", "block", "keys", "counts"])

    return run


def _answers(group: pa.Table) -> pa.Table:
    """What all blocks sent to one bucket -> for each block, which of its keys
    others have too, and their totals. ``distinct``: keys of the bucket, once."""
    keys = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
    counts = [_ints(c, _ROWS[kind], len(k)) for kind, c, k in zip(group.column("kind").to_pylist(), group.column("counts").to_pylist(), keys)]
    _, at, blocks_of = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    totals = np.stack([np.bincount(at, c) for c in np.concatenate(counts, axis=1)]).astype(np.int64)
    which, sums, end = [], [], np.cumsum([len(k) for k in keys])
    for k, e in zip(keys, end):
        mine = at[e - len(k):e]
        others = blocks_of[mine] > 1
        which.append(np.packbits(others).tobytes())
        sums.append(_planes(totals[:, mine[others]]))
    distinct = np.zeros(len(keys), np.int64)
    distinct[0] = len(blocks_of)
    return pa.Table.from_arrays([*(group.column(c).combine_chunks() for c in ("kind", "bucket", "block")), pa.array(which, pa.binary()), pa.array(sums, pa.binary()),
                                 pa.array(distinct)], ["kind", "bucket", "block", "which", "totals", "distinct"])


def _block_losses(n_buckets, vocabulary: int, total: int, n_good: int, mu: float):
    """Function over (a block, the answers to it) -> losses of its parts."""
    n = n_good or total
    scale = n / max(total, 1)  # matched: as many tokens as the target

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row, size, good, stream, known = (block.column(c)[0].as_py() for c in ("row", "size", "good", "stream", "words"))
        x = _Block(size, good, stream, known, n_buckets)
        for kind, k, which, totals in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "which", "totals"))):
            at = x.bucket(kind, k)
            at = at[np.unpackbits(np.frombuffer(which, np.uint8), count=len(at)).view(bool)]
            x.counts[kind][:, at] = _ints(totals, _ROWS[kind], len(at))
        pair, word = x.counts[_PAIRS], x.counts[_WORDS]
        part, loss = np.arange(len(x.size)).repeat(x.size), []
        for target in (True, False):
            # places of (token, context) counts: those of good texts follow those of all
            k, s = (1, 1.0) if target and n_good else (0, scale)
            one = (s * word[k] + 1) / (n + vocabulary)
            p = (s * pair[k] + mu * one[x.token]) / (s * word[2 + k][x.context] + mu)
            loss.append(np.bincount(part, -np.log(p)[x.at], len(x.size)))
        return pa.Table.from_arrays([pa.array(np.frombuffer(row, np.int64)), block.column("ids").combine_chunks().flatten(), pa.array(x.size), *map(pa.array, loss)],
                                    ["row", "id", "n", "target", "background"])

    return run


def _written_once(df: DataFrame, what: str) -> DataFrame:
    """Like ``written``, and what ``df`` shuffled is deleted when the files are
    there: nothing reads it again, and each shuffle here is as large as the texts."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df, what)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def differences(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", mu: float = MU) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (means per token), score,
    under the models of all words and pairs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    encoded = _written_once(_target(docs, labels, text_col, id_col).mapInArrow(_encoded, f"{_ENCODED}, ids array<{id_type}>"), "encoded")
    sums = encoded.agg(F.sum("tokens"), F.sum("good_tokens"), F.sum(F.octet_length("words") / 8).cast("long")).first()
    total, n_good, n_words = (x or 0 for x in sums)
    n_buckets = {_WORDS: n_words // _PER_BUCKET + 1, _PAIRS: total // _PER_BUCKET + 1}
    sent = encoded.select("block", "size", "good", "stream", "words").mapInArrow(
        _sent(n_buckets), "kind long, bucket long, block long, keys binary, counts binary")
    answers = _written_once(sent.groupBy("kind", "bucket").applyInArrow(
        _answers, "kind long, bucket long, block long, which binary, totals binary, distinct long"), "answers")
    # <s> is among the words: it takes the place of the unknown token
    vocabulary = answers.where(F.col("kind") == _WORDS).agg(F.sum("distinct")).first()[0] or 0
    parts = encoded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _block_losses(n_buckets, vocabulary, total, n_good, mu), f"row long, id {id_type}, n long, target double, background double")
    n = F.greatest(F.col("n"), F.lit(1))
    return parts.groupBy("row").agg(F.first("id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n", "target", "background"))).select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("target") / n).alias("loss_target"), (F.col("background") / n).alias("loss_background"),
        (F.col("target") / n - F.col("background") / n).alias("score"))


def op4_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    return differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
