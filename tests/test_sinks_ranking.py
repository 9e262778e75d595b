"""Sinks (partitioned splits, logs, changed-only rewrites, sample report)
and candidate ranking through a scorer plug-in."""
import os
import tempfile

import pytest


from corpusmill.operators import compare as OC
from corpusmill.operators import plugins as P
from corpusmill.sinks import writers as W


def test_write_splits_partitions_by_split(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-sink-")
    df = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test"), ("d", "train")], "stem string, split string")
    W.write_splits(df, os.path.join(d, "splits"))
    parts = sorted(x for x in os.listdir(os.path.join(d, "splits")) if x.startswith("split="))
    assert parts == ["split=test", "split=train", "split=val"]
    back = spark.read.parquet(os.path.join(d, "splits")).where("split = 'train'")
    assert sorted(r.stem for r in back.collect()) == ["a", "d"]


def test_logs_changed_and_report(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-sink2-")
    gated = spark.createDataFrame([(True, "a.c -> a.s"), (False, "b.c (deleted) :: err")], "ok boolean, log_line string")
    W.write_logs(gated, os.path.join(d, "ok"), os.path.join(d, "fail"))
    assert [r.value for r in spark.read.text(os.path.join(d, "fail")).collect()] == ["b.c (deleted) :: err"]
    df = spark.createDataFrame([("x", "a", "a"), ("y", "b", "c")], "k string, before string, after string")
    assert [r.k for r in W.changed_rows(df, "before", "after").collect()] == ["y"]
    rep = W.sample_report(spark.createDataFrame([(3, "p"), (1, "q")], "o int, t string"), "o", "t")
    assert [r.value for r in rep.orderBy("o").collect()] == ["\n=== SAMPLE 0 ===\nq\n", "\n=== SAMPLE 1 ===\np\n"]


def test_candidate_ranking_with_scorer(spark):
    cands = spark.createDataFrame(
        [("s1", "original", "int main"), ("s1", "model", "int main ( )"), ("s1", "other", "x"),
         ("s2", "original", "a b"), ("s2", "model", "a")], "stem string, candidate string, text string")
    asm = spark.createDataFrame([("s1", "li a0,1"), ("s2", "ret")], "stem string, asm string")
    joined = asm.join(cands, "stem")

    def fake_loss(model, srcs, tgts):
        # loss = tokens of the candidate (lower is better), one "token" each
        return [(float(len(t.split())), 1, 0) for t in tgts]

    scored = P.score(joined, "asm", "text", lambda: None, fake_loss).withColumnRenamed("nll_sum", "loss")
    ranked = {(r.stem, r.candidate): r["rank"] for r in OC.rank_candidates(scored).collect()}
    assert ranked[("s1", "other")] == 1 and ranked[("s1", "model")] == 3
    assert ranked[("s2", "model")] == 1


def test_write_named_keeps_only_written_rows(spark):
    from corpusmill.operators.names import assign_names

    d = tempfile.mkdtemp(prefix="corpusmill-sink3-")
    arrivals = spark.createDataFrame([(1, "T", "a"), (2, "T", "a"), (3, "T", "b")], "arrival long, title string, code string")
    W.write_named(assign_names(arrivals), os.path.join(d, "named"))
    back = {r.name: r.content for r in spark.read.parquet(os.path.join(d, "named")).collect()}
    assert back == {"T.c": "a\n", "T__2.c": "b\n"}


def test_gate_keeps_sources_without_a_result(spark):
    from corpusmill.operators import gate as G

    src = spark.createDataFrame([("a", "c/a.c"), ("b", "c/b.c"), ("x", "c/x.c")], "stem string, path string")
    res = spark.createDataFrame([("a", 0, "", "out"), ("b", 1, "e" * 3000, None)], "stem string, returncode int, stderr string, asm string")
    got = {r.stem: r for r in G.gate(src, res).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "compiled", "b": "failed", "x": "no result"}
    assert got["x"].log_line == "c/x.c :: no result" and not got["x"].ok and len(got["b"].info) == 3000
    assert len(G.gate(src, res, max_info=10).where("stem = 'b'").first()["info"]) < 40


def test_an_external_step_may_return_anything(spark):
    from corpusmill.operators.plugins import run_external

    df = spark.createDataFrame([(1,), (2,)], "k int")
    got = {r.k: r for r in run_external(df, "k", lambda row: ("no number" if row["k"] == 1 else 0, "", "o")).collect()}
    assert got[1].returncode == -1 and got[2].returncode == 0


def test_sample_report_computes_its_rows_once(spark):
    """The report carries the frame's other columns: no join back to it."""
    from corpusmill.plans import corpus_queries as cq
    from conftest import SF_SMALL

    if not os.path.isdir(SF_SMALL):
        pytest.skip("driver tables not present")
    plan = cq.prediction_samples(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GlobalLimit 5") == 1
