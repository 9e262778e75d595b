"""Stored logits beside the labels, in stretches: every position gets its row, none is moved alone."""
import hashlib
import math

from corpusmill.functions import metrics as M
from corpusmill.operators import metrics as OM
from corpusmill.plans import eval_queries as EQ
from corpusmill.plans import workflows as W
from pyspark.sql import functions as F


def _vectors(spark, folder, n):
    rows = [(1000 - 3 * i, [float((i * k) % 7) / 2 for k in range(EQ.WIDTH)] if i != 4 else None, i) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return [r[1] for r in sorted(rows)]


def _first(stem, n):
    return int(hashlib.md5(stem.encode()).hexdigest()[:8], 16) % n


def test_each_position_has_its_row(spark, tmp_path):
    """Against the places by hand: texts that end where a stretch does, that pass the end of the vectors once and more often."""
    for n in (150, 64, 5):
        order = _vectors(spark, f"{tmp_path}/{n}", n)
        texts = {f"s{i}": list(range(k)) for i, k in enumerate((0, 1, 63, 64, 65, 149, 150, 400))}
        labelled = spark.createDataFrame([*texts.items(), ("none", None)], "stem string, labels array<int>")
        got = EQ.stored_logits(spark, f"{tmp_path}/{n}")(labelled.withColumn("more", F.lit("m"))).collect()
        assert all(len(r.labels) == len(r.logits) <= EQ.STRETCH and r.more == "m" for r in got)
        at = {(r.stem, y): l for r in got for y, l in zip(r.labels, r.logits)}
        assert sum(len(r.labels) for r in got) == len(at) == sum(map(len, texts.values()))
        assert all(r.labels[0] == r.start for r in got)
        assert at == {(s, p): order[(_first(s, n) + p) % n] for s, t in texts.items() for p in t}


def test_no_vectors_score_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    labelled = spark.createDataFrame([("a", [1, 2])], "stem string, labels array<int>")
    assert EQ.stored_logits(spark, str(tmp_path))(labelled).collect() == []


def test_a_long_candidate_is_ranked_by_parts_of_its_logits(spark, tmp_path):
    """a text of 5,000 tokens is no row of 5,000 nested logits, and its loss is that of all of them."""
    order = [v or [] for v in _vectors(spark, str(tmp_path), 150)]
    words = [f"w{i % 90}" for i in range(5000)]
    cands = spark.createDataFrame([("a", "original", " ".join(words)), ("a", "other", "w1 w2")], "stem string, candidate string, text string")
    most = []

    def model(labelled):
        out = EQ.stored_logits(spark, str(tmp_path))(labelled)
        most.append(out.agg(F.max(F.size("logits"))).first()[0])
        return out

    got = {r.candidate: r for r in W.rank_candidate_texts(cands, model, EQ.hashed_ids).collect()}
    assert most == [EQ.STRETCH]
    ids = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (EQ.WIDTH - 1) + 1 for w in words]
    losses = [math.log(sum(map(math.exp, l))) - l[y] for p, y in enumerate(ids) if (l := order[(_first("a", 150) + p) % 150])]
    assert got["original"].n_tokens == len(losses) and abs(got["original"].mean_loss - sum(losses) / len(losses)) < 1e-9
    assert {got["original"]["rank"], got["other"]["rank"]} == {1, 2}


def test_metrics_from_stretches_are_those_of_whole_logits(spark, tmp_path):
    """padded batches scored by parts of their logits; no position is shuffled with its row."""
    order = _vectors(spark, str(tmp_path), 150)
    ev = spark.createDataFrame([(f"s{i}", " ".join(f"w{(i * k) % 50}" for k in range(20 * i)), "val" if i % 3 else "test", i // 3 + 1 if i % 3 == 0 else 2 * (i // 3) + i % 3)
                                for i in range(12)], "stem string, tgt string, split string, split_rank long")
    batches = W.evaluation_batches(ev, EQ.hashed_ids, 4, 100)
    nested = spark.createDataFrame([(r.stem, [order[(_first(r.stem, 150) + p) % 150] for p in range(len(r.labels))]) for r in batches.collect()],
                                   "stem string, logits array<array<double>>")
    parts = W.evaluation_metrics(batches, EQ.stored_logits(spark, str(tmp_path)))
    want = {r.split: r for r in W.evaluation_metrics(batches, nested).collect()}
    got = {r.split: r for r in parts.collect()}
    assert got.keys() == want.keys() == {"val", "test"}
    for k, r in got.items():
        assert (r.n_tokens, r.token_accuracy, r.summary) == (want[k].n_tokens, want[k].token_accuracy, want[k].summary)
        assert abs(r.nll_sum - want[k].nll_sum) < 2e-6
    plan = parts._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():  # rows of logits are shuffled for their stretch alone
        if "Exchange hashpartitioning" in line:
            assert "stem" not in line


def test_scores_with_norms_are_those_without(spark):
    """labels that are ignored, missing or outside, rows with a null, without logits or with infinite ones."""
    whole, inf = [0.5, -1.25, 3.0], float("inf")
    rows = [(f"s{i}", [l], [y]) for i, (l, y) in enumerate((l, y) for l in (whole, [1.0, None, 2.0], None, [], [inf, 0.0], [-inf, 0.0], [float("nan"), 1.0])
                                                           for y in (0, 2, 3, -1, -100, None))]
    df = spark.createDataFrame([*rows, ("more", [whole, whole], [1]), ("less", [whole], [1, 2])], "stem string, logits array<array<double>>, labels array<int>")
    plain = OM.score_tokens(OM.flatten_logits(df))
    normed = OM.score_tokens(OM.flatten_logits(df.withColumn("norms", F.transform("logits", M.log_norm))))
    told = [{(r.stem, r.pos): (repr(r.nll), r.pred, r.correct) for r in x.collect()} for x in (plain, normed)]
    assert told[0] == told[1] and len(told[0]) == len(rows) + 4 and told[0]["s0", 0][0] != "None"


def test_no_position_takes_a_log_sum_exp(spark, tmp_path):
    """it is taken for each stored vector, below the join with the labels; 24 us a position, where the look into the logits is under one."""
    _vectors(spark, str(tmp_path), 150)
    cands = spark.createDataFrame([("a", "original", "x y z"), ("a", "other", "x")], "stem string, candidate string, text string")
    plan = W.rank_candidate_texts(cands, EQ.stored_logits(spark, str(tmp_path)), EQ.hashed_ids)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate posexplode(arrays_zip(" in line)
    assert not any("aggregate(" in line for line in plan[:at]) and any("aggregate(" in line for line in plan[at:])
