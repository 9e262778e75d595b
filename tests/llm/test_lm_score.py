import math
import random
from collections import Counter

import pytest
from corpusmill.llm import common as C
from corpusmill.llm import lm_score as M
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, good, min_word=M.MIN_WORD, min_pair=M.MIN_PAIR, mu=M.MU):
    toks = {i: (t or "").lower().split() for i, t in docs}
    count = Counter(w for ws in toks.values() for w in ws)
    total = sum(count.values())
    vocab = {w for w, n in count.items() if n >= min_word * total}
    seqs = {i: [w if w in vocab else "?" for w in ws] for i, ws in toks.items()}
    size = len(vocab) + 1
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, s in seqs.items():
        for k in ([0, 1] if i in good else [1]):
            uni[k].update(s)
            bi[k].update(zip(["<s>", *s], s))
    n_good = sum(uni[0].values())
    known = {p for p in bi[1] if bi[1][p] >= min_pair * total or bi[0][p] and bi[0][p] >= min_pair * n_good}
    if not n_good:
        uni[0], bi[0], n_good = uni[1], bi[1], total
    scale = [1, n_good / max(total, 1)]
    out = []
    for i, s in seqs.items():
        losses = []
        for k in range(2):
            one = lambda w: (scale[k] * uni[k][w] + 1) / (scale[k] * sum(uni[k].values()) + size)
            ctx = Counter()
            for (v, w) in known:
                ctx[v] += scale[k] * bi[k][v, w]
            losses.append(sum(-math.log((scale[k] * bi[k][v, w] * ((v, w) in known) + mu * one(w)) / (ctx[v] + mu)) for v, w in zip(["<s>", *s], s)))
        n = max(len(s), 1)
        out.append((i, len(s), losses[0] / n, losses[1] / n, (losses[0] - losses[1]) / n))
    return out


def _rows(seed=1, n=60):
    rnd = random.Random(seed)
    return [(i, rnd.choice([" ", "\n "]).join(rnd.choice(["the", "The", "cat", "dog", "é%d" % rnd.randint(0, 30)]) for _ in range(rnd.randint(0, 30)))) for i in range(n)] + [
        (n, None), (n + 1, " "), (n + 2, "cat " * 500)]


@pytest.mark.parametrize("shares", [{}, {"min_word": 0.01, "min_pair": 0.004}])
def test_scores_as_brute_force(spark, monkeypatch, shares):
    rows, good = _rows(), {i for i in range(0, 60, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(40)] + [(i, 1, 0) for i in good] + [(None, 1, 0)], LABELS)
    want = sorted(brute(rows, good, **shares))
    for size in (1 << 20, 64):
        monkeypatch.setattr(C, "BLOCK", size)
        model = M.learn(docs, labels, **shares)
        got = sorted(tuple(r) for r in M.scored(docs, model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], abs=1e-9)


def test_query_ranks_target_like_texts_first(spark, tables):
    rnd = random.Random(2)
    style = {1: "fine calm clear prose reads well".split(), 0: "junk spam click here now win".split()}
    kind = [rnd.randint(0, 1) for _ in range(200)]
    texts = [" ".join(rnd.choices(style[k], k=30)) for k in kind]
    tables("labels", [(i, k, 0) for i, k in enumerate(kind) if i < 100], LABELS)
    got = M.op4_cross_entropy_difference(spark, tables("documents", docs_of(texts), DOCS)).collect()
    assert len(got) == 200 and all((r.score < 0) == (kind[r.doc_id] == 1) for r in got)


def test_no_target_nulls_ties_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "a", 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, n long")
    none = spark.createDataFrame([], LABELS)
    got = M.scored(docs, M.learn(docs, none)).collect()
    assert len(got) == 5 and all(r.score == 0 for r in got) and ordered(got, "n_tokens") == [(0,), (0,), (1,), (2,), (2,)]
    good = spark.createDataFrame([(1, 1, 0)], LABELS)
    scores = {(r.doc_id, r.n_tokens): r.score for r in M.scored(docs, M.learn(docs, good)).collect()}
    assert scores[1, 2] < 0 == scores[2, 0]
    empty = docs.limit(0)
    assert M.scored(empty, M.learn(empty, good)).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_whole_model_as_brute_force(spark, monkeypatch, size):
    """Blocks, buckets and parts of texts of any size; repeated and null ids."""
    monkeypatch.setattr(C, "BLOCK", size)
    monkeypatch.setattr(M, "_TOGETHER", 2)
    monkeypatch.setattr(M, "_PER_BUCKET", 50)
    rows, good = _rows(3), {i for i in range(0, 60, 3)}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(60)] + [(None, 1, 0)], LABELS)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for kept in (good, set()):
        got = sorted(tuple(r) for r in M.differences(docs, labels if kept else labels.limit(0)).collect())
        want = sorted(brute(rows, kept, 0, 0))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], abs=1e-9)
    twice = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = M.differences(twice, labels).collect()
    assert ordered(got, "doc_id", "n_tokens") == [(1, 0), (1, 2), (1, 2), (None, 2)]
    assert M.differences(twice.limit(0), labels).count() == 0


def test_rare_words_and_pairs_count_in_a_large_corpus(spark, tables):
    """Words and pairs of one in a million tokens are in the models."""
    n = 1_100_000
    texts = ["the " * n, "rare gem", "gem rare"]
    tables("labels", [(0, 0, 0), (1, 1, 0), (2, 0, 0)], LABELS)
    got = {r.doc_id: r for r in M.op4_cross_entropy_difference(spark, tables("documents", docs_of(texts), DOCS)).collect()}
    scale, size, mu = 2 / (n + 4), 4, M.MU
    one = [(1 + 1) / (2 + size), (scale * 2 + 1) / (2 + size)]  # of rare and of gem alike
    # <s> rare, rare gem: seen once in the target and in all; <s> stands three times in all
    target = -math.log((1 + mu * one[0]) / (1 + mu)) * 2
    background = -math.log((scale + mu * one[1]) / (3 * scale + mu)) - math.log((scale + mu * one[1]) / (scale + mu))
    assert (got[1].loss_target, got[1].loss_background) == pytest.approx((target / 2, background / 2), abs=1e-12)
    assert got[1].score < got[2].score < 0
