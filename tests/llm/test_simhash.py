import random

import numpy as np
import xxhash
from corpusmill.llm import graph, simhash as S
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401


def _brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _brute_components(pairs):
    """pairs (id, fingerprint) -> {id: smallest id that can be reached}"""
    root = {i: i for i, _ in pairs}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in pairs:
        for j, b in pairs:
            if (a ^ b).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in pairs}


def _texts():
    rnd = random.Random(3)
    base = ["É %d " % i + " ".join(rnd.choice("alpha Beta gamma delta eps zeta".split()) for _ in range(rnd.randint(150, 400))) for i in range(12)]
    out = []
    for t in base:
        w = t.split(" ")
        for k in range(rnd.randint(1, 6)):
            v = list(w)
            v[rnd.randrange(len(v))] = "other%d" % k
            out.append(" \t".join(v))
    return out + ["one", "one two", "A b c", "a  B\nC", None, "", " \n"] + ["copy of one text"] * 30 + ["long word " * 70_000]


def test_query_against_brute_force(spark, tables):
    texts = _texts()
    got = S.op3_simhash_near_dedup(spark, tables("documents", docs_of(texts), DOCS)).collect()
    fps = [(i, _brute_fp(t)) for i, t in enumerate(texts)]
    roots = _brute_components(fps)
    assert ordered(got, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", roots[i]) for i, f in fps), key=repr)
    assert len(set(roots.values())) < len(texts) - 40


def test_links_lose_no_pair_and_the_chain_prunes(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5)} | {0, 1, (1 << 64) - 1}
    signed = {int(np.uint64(f).astype(np.int64)) for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.a, r.b) for r in S.links(df).collect()}
    u = lambda v: v & ((1 << 64) - 1)
    want = {(a, b) for a in signed for b in signed if a < b and (u(a) ^ u(b)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, j) for j in range(6, 90)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain + star + [(3, 3)], "x long, y long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 90)}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_representatives_nulls_ties_and_clashing_columns(spark):
    rows = [(4, "a b c d", 1), (2, "A b c  d", 2), (2, "A b c  d", 2), (9, None, 3), (None, "", 4), (7, "x y z", 5), (None, "only null id", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = S.representatives(df)
    assert out.columns == df.columns
    assert ordered(out.collect(), "doc_id", "text") == sorted([(2, "A b c  d"), (9, None), (7, "x y z"), (None, "only null id")], key=repr)
    assert S.near_duplicates(df.limit(0)).count() == S.representatives(df.limit(0)).count() == 0
