"""Counts observed in the pass that does the work, fail-fast on them, and the evaluation in one piece."""
import math
import os

import pytest
from corpusmill.operators import checks as CH
from corpusmill.plans import workflows as W
from pyspark.sql import functions as F

FILES = "name string, path string, content string"


def _files(spark, n, empty=False):
    rows = []
    for i in range(n):
        rows += [(f"f{i}.c", f"d/f{i}.c", "" if empty else f"#include <a.h>\nint f{i}(void)\n{{ return {i}; }}\n"), (f"f{i}.s", f"d/f{i}.s", f"\t.text\nf{i}:\n\tret\n")]
    return spark.createDataFrame(rows, FILES)


def test_no_pairs_and_no_rows_of_a_split_are_errors(spark):
    with pytest.raises(RuntimeError, match="no .src, tgt. pairs"):
        W.build_training_set(_files(spark, 3).where("name like '%.c'"), require=True)
    with pytest.raises(RuntimeError, match="no validation rows"):
        W.build_training_set(_files(spark, 3), require=True)  # int(3 * 0.1) = 0
    with pytest.raises(RuntimeError, match="no training rows"):
        W.build_training_set(_files(spark, 20), max_src_tokens=0, require=True)
    assert W.build_training_set(_files(spark, 20), require=True).count() == 20


def test_no_stems_and_no_valid_pairs_are_errors(spark):
    files = _files(spark, 4)
    keys = spark.createDataFrame([("f1",), ("gone",)], "stem string")
    assert [r.stem for r in W.evaluation_set(files, keys, require=True).collect()] == ["f1"]
    with pytest.raises(RuntimeError, match="no stems"):
        W.evaluation_set(files, keys.limit(0), require=True)
    with pytest.raises(RuntimeError, match="no valid pairs"):
        W.evaluation_set(files, keys.where("stem = 'gone'"), require=True)
    with pytest.raises(RuntimeError, match="no valid pairs"):
        W.evaluation_set(_files(spark, 4, empty=True), keys, require=True)


def test_counts_are_taken_in_the_one_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(i):
        calls.add(1)
        return i

    out, counts = CH.counted(spark.range(50).select(seen(F.col("id").cast("int")).alias("i")), "once", n=F.count(F.lit(1)), odd=F.count_if(F.col("i") % 2 == 1))
    assert counts == {"n": 50, "odd": 25} and out.count() == 50 and out.agg(F.max("i")).first()[0] == 49
    assert calls.value == 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_corpus_counts_scan_little(spark):
    from corpusmill.plans.corpus_queries import corpus_counts
    from corpusmill.sources.corpus import code_files_at_once

    sf = "/root/testdata/sf0.001"
    scans = [df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") for df in (code_files_at_once(spark, sf), corpus_counts(spark, sf))]
    assert sum(scans) <= 4, scans


def test_counts_of_any_files(spark):
    rows = [("a.c", "#include <x.h>\n #include   <x.h>\n"), ("a.s", "ret"), ("a.ghidra.c", "#include <y.h>"), ("a.ghidra.s", ""), ("b.c", ""), ("b.s", "ret"), ("c.s", ""), ("z.txt", "#include <z.h>")]
    got = W.corpus_counts(spark.createDataFrame(rows, "name string, content string")).collect()
    assert [r.asDict() for r in got] == [dict(n_sources=2, n_listings=4, n_other=1, n_pairs=3, n_usable=1, n_distinct_includes=2)]


def test_evaluation_from_pairs_to_the_split_line(spark):
    """Nested logits of batches against sums by hand: pads, a cut, a stem without logits."""
    ev = spark.createDataFrame([("a", "p q", "t", 1), ("b", "q q q r", "t", 2), ("c", "", "t", 3), ("d", "p", "v", 1), ("e", "p", "v", 2)],
                               "stem string, tgt string, split string, split_rank long")
    ids = {"p": 1, "q": 2, "r": 0}
    tok = lambda t: F.transform(t, lambda x: F.when(x == "p", 1).when(x == "q", 2).otherwise(0))
    batches = W.evaluation_batches(ev, tok, size=2, max_tgt=3)
    got = {r.stem: (r.batch_id, r.labels) for r in batches.collect()}
    assert got == {"a": (0, [1, 2, -100]), "b": (0, [2, 2, 2]), "c": (1, []), "d": (0, [1]), "e": (0, [1])}
    z = [[0.5, 1.0, 2.0], [0.0, 3.0, 1.0], [1.0, 1.0, 1.0]]
    logits = spark.createDataFrame([("a", z), ("b", z), ("c", []), ("d", z[:1])], "stem string, logits array<array<double>>")
    nll = lambda l, y: math.log(sum(map(math.exp, l))) - l[y]
    t = [(z[0], ids["p"]), (z[1], 2), (z[0], 2), (z[1], 2), (z[2], 2)]
    rows = {r.split: r for r in W.evaluation_metrics(batches, logits).collect()}
    s = sum(nll(l, y) for l, y in t)
    hits = sum(l.index(max(l)) == y for l, y in t)
    assert rows["t"].n_tokens == 5 and rows["t"].nll_sum == pytest.approx(s, abs=1e-6) and rows["t"].token_accuracy == pytest.approx(hits / 5)
    assert rows["v"].n_tokens == 1 and rows["v"].avg_nll == pytest.approx(nll(z[0], 1), abs=1e-6)
    assert rows["t"].summary == f"{'t':<10} | NLL: {s / 5:.4f} | PPL: {math.exp(s / 5):.4f} | token_acc: {hits / 5 * 100:.4f}%"
