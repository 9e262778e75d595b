import random
import zlib

import pytest
from corpusmill.llm import common as C
from corpusmill.llm import langid as L
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401

WORDS = {"en": "the and of thing whose window thread", "de": "der und schön straße Zeit auch nicht", "el": "Και το ΟΔΟΣ είναι νερό"}


def _rows(n=240, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, rnd.choice([" ", ", ", "\n1 "]).join(rnd.choices(WORDS[lang].split(), k=rnd.randint(3, 40))), lang, "s", 0))
    return out


def _grams(text):
    """Brute force: trigrams within words, with a blank at both ends."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [f" {w} "[i:i + 3] for w in words for i in range(len(w))]


def _code(g):
    return ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])


def test_trigrams_as_brute_force_in_any_block(monkeypatch):
    texts = [r[1] for r in _rows(30)] + ["", "12 3", "a", "é-ab", "x" * 50, "İstanbul ΣΑΣ"]
    for size in (1 << 20, 40):
        monkeypatch.setattr(C, "BLOCK", size)
        got = {i: [] for i in range(len(texts))}
        for block in C.blocks(enumerate(texts), str.isalpha):
            row, grams = L.trigrams([t for _, t, _ in block])
            for r, g in zip(row, grams.tolist()):
                got[block[r][0]].append(g)
        assert all(sorted(got[i]) == sorted(map(_code, _grams(t))) for i, t in enumerate(texts))


def test_query_predicts_the_held_out(spark, tables):
    rows = _rows() + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 ?!", None, "s", 0), (903, "the and of " * 150_000, "en", "s", 0)]
    rows += [(904, "und der", "de", "s", 0)] * 3
    got = L.op1_bitmask_langid(spark, tables("documents", rows, DOCS)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (900, 901, 902) else truth[r.doc_id])


def test_filters_hold_all_their_trigrams_and_counts_are_corrected(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, DOCS)
    m = L.learn(df)
    assert m.langs == sorted(WORDS) and (m.false < 0.01).all()
    mine = {_code(g) for g in _grams(WORDS["el"])}
    import numpy as np
    at = L.slots(np.array(sorted(mine), np.uint64))
    found = m.masks[0][at[0]] & m.masks[0][at[1]] & m.masks[0][at[2]]
    assert (found >> 1 & 1).all()
    # a fuller filter: what it lets pass is taken off
    full = L.Model(["a", "b"], [np.full(1 << L.SLOTS_LOG2, 1, np.uint8)], np.array([0.5, 0.0]))
    assert full.predict(["word"])[1][0] == 1.0


def test_more_languages_than_a_mask_has_bits(spark):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}qz{chr(97 + i % 26)}" for i in range(70)]
    rows = [(i * 10 + k, f"{w} {w}", f"l{i:02}", "s", 0) for i, w in enumerate(words) for k in range(4)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.id: r.lang_pred for r in L.predicted(df, L.learn(df)).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)


def test_nothing_learned_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", None, 5), (None, None, None, 6)], "doc_id long, text string, lang string, __lang int")
    m = L.learn(df)
    assert m.langs == [] and {r.lang_pred for r in L.predicted(df, m).collect()} == {"und"}
    full = spark.createDataFrame(_rows(), DOCS)
    kept = L.identified(df, L.learn(full))
    assert kept.columns == df.columns and [r["__lang"] for r in kept.collect()] == [5]
    assert L.predicted(df.limit(0), m).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in L.op1_bitmask_langid(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.97 * len(got)
