import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from corpusmill.llm import bpe as B
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rnd = random.Random(0)
    pick = [(32, 127), (0, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0x10000, 0x20000)]
    out = ["".join(chr(rnd.randrange(*rnd.choice(pick))) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    return out + [None, "", " \t\n", "<|endoftext|>a<|startoftext|> b<|endoftext|", "I'LL don't it's ''re", "ΟΔΟΣ ΣΑΣ İstanbul ﬁ é Å", "x\x1fy \x1c\x85z\xa0w",
                  "1234½²Ⅷ", "日本語 한국어 नमस्ते 😀👩‍👧", "a" * 30_000, "<|endoftext|>" * 3, "word " * 60_000 + "end",
                  "the quick Brown fox, unbelievably internationalization's"] + ["same text"] * 5


def test_query_as_the_library(spark, tables, library):
    texts = _texts()
    got = B.op8_bpe_trie(spark, tables("documents", docs_of(texts), DOCS)).collect()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert ordered(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_encode_and_decode_frames(spark, library):
    texts = [t for t in _texts() if t][:60]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, ids int")
    enc = B.encode(df, PATH)
    got = {r.id: list(r.ids) for r in enc.collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)} | {None: []}
    dec = {r.id: r.text for r in B.decode(enc, PATH).collect()}
    assert dec == {i: library.decode(x, skip_special_tokens=False) for i, x in got.items()}
    assert B.encode(df.limit(0), PATH).count() == B.round_trip(df.limit(0), PATH).count() == 0


def test_small_blocks_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_CHUNKS", 7)
    monkeypatch.setattr(B, "KEPT_CHUNKS", 11)
    texts = [t or "" for t in _texts()[380:]]
    out = [[] for _ in texts]
    for i, ids in B._Encoder(B.prepared(PATH)).blocks(texts):
        out[i].extend(np.frombuffer(ids, "<u4").tolist())
    assert out == [library.encode(t, add_special_tokens=False).ids for t in texts]
