import itertools
import random

import numpy as np
from corpusmill.llm import packing as P
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401

COLS = ("doc_id", "n_tokens", "bucket", "bucket_tokens", "batch_id", "slot")


def _texts(n=400, seed=1):
    rnd = random.Random(seed)
    return [" ".join(["w"] * int(rnd.lognormvariate(3, 1.5))) for _ in range(n)] + [None, "", " \n", "one"] + ["w " * 5] * 60 + ["w " * 30_000]


def test_against_sql(spark, tables, duck):
    folder = tables("documents", docs_of(_texts()), DOCS)
    got = P.op2_length_packing(spark, folder).collect()
    assert ordered(got, *COLS) == ordered(duck(folder, P.oracle()), *COLS)


def test_boundaries_are_optimal():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        rows = [rnd.randint(1, 20) for _ in lengths]
        most, rows_, total = np.array(lengths), np.array(rows), np.array([a * b for a, b in zip(lengths, rows)])
        for k in (1, 2, 3, 20):
            got = P.optimal(most, rows_, total, k)
            parts = min(k, len(lengths))
            pad = lambda cuts: sum(r * (min(c for c in cuts if c >= x) - x) for x, r in zip(lengths, rows))
            least = min(pad([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], parts - 1))
            assert got.padding == least == pad(got.length) and len(got.length) == parts and sum(got.rows) == sum(rows)


def test_batches_keep_to_the_budget(spark):
    df = spark.createDataFrame(docs_of(_texts()), DOCS)
    got = P.packed(df, buckets=5, budget=200).collect()
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for rows in batches.values():
        assert len({r.bucket for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or rows[0].bucket_tokens * len(rows) <= 200


def test_many_groups_number_like_one(spark, monkeypatch):
    df = spark.createDataFrame(docs_of(_texts()), DOCS)
    one = ordered(P.packed(df).collect(), *COLS)
    monkeypatch.setattr(P, "_GROUP_ROWS", 3)
    assert ordered(P.packed(df).collect(), *COLS) == one


def test_nulls_repeated_rows_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "a b", 1), (3, "a b", 2), (3, "a b", 2), (3, "a", 2)], "doc_id long, text string, hash int")
    got = P.packed(df, buckets=1, budget=4).collect()
    assert ordered(got, "doc_id", "n_tokens") == sorted([(None, 0), (None, 2), (3, 2), (3, 2), (3, 1)], key=repr)
    assert ordered(got, "batch_id", "slot") == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert P.packed(df.limit(0)).count() == 0
