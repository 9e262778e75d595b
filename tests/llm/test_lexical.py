import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpusmill.llm import lexical as X
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"
NAMES = ("item_id", "rank", "doc_id", "score")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """Every pair, in Python integers; ``docs``: (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        q = Counter(terms(text))
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * c.total() * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("wo", "né", "x9", "日")]
    docs = []
    for _ in range(n):
        words = rng.choice(langs)
        docs.append(" ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 60))))
    return docs, langs, rng


def test_terms_fold_only_a_to_z():
    text = "Ab-c9 É\x7fİK_z\x00日本·x　y  Ünï"
    assert X.term_counts(text.encode()) == {t.encode(): c for t, c in Counter(terms(text)).items()}
    assert not X.term_counts(None) and not X.term_counts(b" ._") 


def test_query_equals_brute_force_and_sql(spark, tables, duck, monkeypatch):
    monkeypatch.setattr(X, "DOC_BLOCK", 96)
    texts, langs, rng = corpus(700)
    texts += [texts[0]] * 40 + [None, "", "--", "WO1 Wo1 wo1"]  # ties beyond the 20th
    items = [(i, " ".join(rng.choices(rng.choice(langs), k=rng.randint(1, 30)))) for i in range(60)] + [(60, None), (61, "nowhere"), (62, texts[0])]
    folder = tables("documents", docs_of(texts), DOCS)
    tables("benchmark", items, ITEMS)
    got = ordered(X.op11_dual_tree_search(spark, folder).collect(), *NAMES)
    assert got == sorted(brute(list(enumerate(texts)), items), key=repr)
    assert got == ordered(duck(folder, X.ORACLE), *NAMES)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "ITEM_BLOCK", 7)
    texts, langs, rng = corpus(120)
    items = [(i, " ".join(rng.choices(rng.choice(langs), k=9))) for i in range(30)]
    got = X.ranked(spark.createDataFrame(docs_of(texts), DOCS), spark.createDataFrame(items, ITEMS), k=3).collect()
    assert ordered(got, *NAMES) == sorted(brute(list(enumerate(texts)), items, 3), key=repr)


def _block(texts, items):
    names = sorted({t for _, q in items for t in terms(q)})
    index = {t: i for i, t in enumerate(names)}

    def rows(lists):
        return X.Rows(np.concatenate([[0], np.cumsum([len(p) for p in lists])]), [c for p in lists for c, _ in p], [v for p in lists for _, v in p])

    docs = rows([sorted((index[t], 1000 * c) for t, c in Counter(terms(x)).items() if t in index) for x in texts])
    return X.Items([i for i, _ in items], rows([sorted((index[t], c) for t, c in Counter(terms(q)).items()) for _, q in items]), len(names)), docs


def test_batches_are_pruned_without_loss():
    """Four vocabularies: most node pairs share no coordinate."""
    texts, langs, rng = corpus(2000)
    items = [(i, " ".join(rng.choices(langs[i % 4], k=12))) for i in range(80)]
    block, docs = _block(texts, items)
    found, scored = X.search(block, np.arange(2000), docs, 5, np.zeros(80, np.int64))
    dense = np.zeros((2000, block.width))
    dense[docs.row_of(), docs.cols] = docs.vals
    every = (block.dense @ dense.T).astype(np.int64)
    assert len(found) == 80
    for i, ids, scores in found:
        top = np.lexsort((np.arange(2000), -every[i]))[:5]
        assert ids.tolist() == top.tolist() and scores.tolist() == every[i][top].tolist()
    assert scored < 0.5 * 80 * 2000
    # what another block has reached prunes all but ties of it
    again, fewer = X.search(block, np.arange(2000), docs, 5, np.array([s[-1] for _, _, s in found]))
    assert fewer <= scored and [(i, s.tolist()) for i, _, s in again] == [(i, s.tolist()) for i, _, s in found]


def test_bounds_are_no_less_than_any_score_below():
    texts, langs, rng = corpus(300)
    block, docs = _block(texts, [(i, " ".join(rng.choices(rng.choice(langs), k=8))) for i in range(33)])
    order = X.arranged(docs, block.width, X.DOC_LEAF)
    assert sorted(order.tolist()) == list(range(300))
    docs = docs.take(order)
    dense = np.zeros((300, block.width))
    dense[docs.row_of(), docs.cols] = docs.vals
    scores = block.dense @ dense.T
    for a, i in enumerate(block.levels):
        for b, d in enumerate(X.maxima(docs, block.width, X.DOC_LEAF)):
            bound = i @ d.T
            for x in range(len(i)):
                for y in range(len(d)):
                    part = scores[x * (X.ITEM_LEAF << a):(x + 1) * (X.ITEM_LEAF << a), y * (X.DOC_LEAF << b):(y + 1) * (X.DOC_LEAF << b)]
                    assert bound[x, y] >= part.max(initial=0)


def test_nulls_repeats_large_weights_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(None, "alpha beta", 1, 2), (5, "alpha beta", 1, 2), (5, "alpha beta", 1, 2), (9, "gamma", 1, 2), (None, None, None, None)],
                                 "doc_id long, text string, n int, item int")
    items = spark.createDataFrame([(1, "alpha", 3), (1, "alpha", 4), (1, "gamma", 5), (None, "beta", 6), (2, "beta " * 300_000, 7)], "item_id long, text string, rank int")
    rows = [(None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (9, "gamma")]
    got = ordered(X.ranked(docs, items).collect(), *NAMES)
    assert got == sorted(brute(rows, [(1, "alpha"), (1, "gamma"), (None, "beta"), (2, "beta " * 300_000)]), key=repr)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.limit(0).selectExpr("item_id", "text"))):
        empty = X.ranked(d, i)
        assert empty.count() == 0 and empty.columns == list(NAMES)


def test_weights_beyond_doubles_and_a_very_long_text():
    long_text = "alpha " * 400_000 + "Beta"
    assert X.term_counts(long_text.encode()) == {b"alpha": 400_000, b"beta": 1}
    rows = X.Rows([0, 1], [0], [2.0 ** 40])
    block = X.Items([0], rows, 1)
    assert not block.exact
    docs = X.Rows([0, 1, 2], [0, 0], [999_999, 999_998])
    found, _ = X.search(block, np.array([7, 8]), docs, 2, np.zeros(1, np.int64))
    assert found[0][2].tolist() == [2 ** 40 * 999_999, 2 ** 40 * 999_998]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_all_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert ordered(X.op11_dual_tree_search(spark, sf).collect(), *NAMES) == sorted(brute(docs, items), key=repr)
