"""Driver contract: flagship query, registry, and the similarity query
(which has no SQL oracle) against a brute-force reference on sf0.001."""
import os
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["system", "n_samples", "mean_similarity"]
    assert {r.system for r in rows} == {"other", "model"}


def test_registry_names_and_oracles():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)


def _brute_lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
        prev = cur
    return prev[-1]


def test_similarity_query_against_brute_force(spark):
    from pyspark.sql import functions as F

    from corpusmill.functions import text as T
    from corpusmill.operators import compare as OC
    from corpusmill.plans.corpus_queries import stand_in_prediction
    from corpusmill.sources.corpus import code_files
    from corpusmill.sources.files import primary_only, with_suffix

    files = code_files(spark, SF_SMALL)
    keys = with_suffix(primary_only(files), ".c").select("stem")
    j = OC.join_systems(files, keys, truth=".c", asm=".s", other=".ghidra.c")
    texts = j.select(T.normalize_for_eval("truth").alias("t"), T.normalize_for_eval("other").alias("o"),
                     T.normalize_for_eval(stand_in_prediction("asm")).alias("m")).collect()

    def sim(a, b):
        ta, tb = a.split(), b.split()
        if not ta and not tb:
            return 1.0
        return 1.0 - _brute_lev(ta, tb) / max(len(ta), len(tb), 1)

    exp = {"other": sum(sim(r.o, r.t) for r in texts) / len(texts),
           "model": sum(sim(r.m, r.t) for r in texts) / len(texts)}
    got = {r.system: (r.n_samples, r.mean_similarity) for r in E.queries()["system_similarity"](spark, SF_SMALL).collect()}
    for k in exp:
        assert got[k][0] == len(texts)
        assert got[k][1] == pytest.approx(exp[k], abs=1e-9)
