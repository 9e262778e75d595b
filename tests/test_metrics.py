"""Cross-entropy, argmax, perplexity caps and split metrics."""
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import metrics as M
from corpusmill.operators import metrics as OM


def test_cross_entropy_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([1.0, 3.0, 3.0], -100), ([0.5], 4)], "l array<double>, y int")
    rows = df.select(M.nll("l", "y").alias("n"), M.argmax("l").alias("a")).collect()
    assert rows[0].n == pytest.approx(0.407606, abs=1e-6)
    assert rows[0].a == 2 and rows[1].a == 1
    assert rows[1].n is None and rows[2].n is None


def test_label_smoothing(spark):
    l = [1.0, 2.0, 3.0]
    lse = math.log(sum(math.exp(x) for x in l))
    exp = 0.9 * (lse - 3.0) + 0.1 * (lse - sum(l) / 3)
    df = spark.createDataFrame([(l, 2)], "l array<double>, y int")
    assert df.select(M.nll("l", "y", 0.1).alias("n")).first().n == pytest.approx(exp)


def test_perplexity_cap(spark):
    df = spark.createDataFrame([(20.0,), (1.0,), (800.0,)], "x double")
    rows = df.select(M.perplexity("x", cap=20).alias("c"), M.perplexity("x").alias("p")).collect()
    assert rows[0].c == float("inf") and rows[1].c == pytest.approx(math.e)
    assert rows[2].p == float("inf")


def test_split_metrics_and_nan_when_no_labels(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 2), ("a", [3.0, 2.0, 1.0], 2), ("b", [1.0, 1.0], -100)],
                               "split string, logits array<double>, label int")
    out = {r.split: r for r in OM.split_metrics(OM.score_tokens(df), "split").collect()}
    assert out["a"].n_tokens == 2 and out["a"].token_accuracy == 0.5
    assert math.isnan(out["b"].masked_accuracy) and out["b"].token_accuracy == 0.0


def test_pad_batches_masks_by_value(spark):
    df = spark.createDataFrame([(0, [5, 0, 7]), (0, [4]), (1, [9, 9])], "batch_id long, ids array<int>")
    rows = {tuple(r.ids): r for r in OM.pad_batches(df, "ids", ["batch_id"], 0).collect()}
    assert rows[(4,)].padded == [4, 0, 0] and rows[(4,)].attention_mask == [1, 0, 0]
    assert rows[(5, 0, 7)].labels == [5, -100, 7]
    assert rows[(9, 9)].padded == [9, 9]


def test_flatten_logits(spark):
    df = spark.createDataFrame([("s", [[1.0, 2.0], [3.0, 0.0]], [1, 0])], "stem string, logits array<array<double>>, labels array<int>")
    rows = OM.flatten_logits(df).orderBy("pos").collect()
    assert [(r.pos, r.label) for r in rows] == [(0, 1), (1, 0)]


def test_metrics_summary_line(spark):
    df = spark.createDataFrame([("validation", 1.23456, 3.43689, 0.125)],
                               "split string, avg_nll double, perplexity double, token_accuracy double")
    line = OM.metrics_summary(df).first().summary
    assert line == "validation | NLL: 1.2346 | PPL: 3.4369 | token_acc: 12.5000%"


def test_bad_positions_are_rejected_and_not_counted(spark):
    import math

    from corpusmill.operators import metrics as OM

    rows = [("a", [1.0, 2.0], 1), ("a", [1.0, 2.0], 7), ("a", [1.0, None], 0), ("a", None, 0), ("a", [0.0, 0.0], -100), ("a", [1.0], None)]
    df = spark.createDataFrame(rows, "split string, logits array<double>, label int")
    got = OM.split_metrics(OM.score_tokens(df, smoothing=0.1), smoothing=0.1, digits=None).first()
    nll = math.log(math.exp(-1) + 1)
    assert got.n_tokens == 1 and abs(got.avg_nll - nll) < 1e-12 and got.token_accuracy == 1.0
    assert abs(got.smoothed_loss - (0.9 * nll + 0.1 * (nll + 0.5))) < 1e-12
    assert OM.rejected_tokens(df).count() == 3


def test_metrics_take_a_scorers_sums(spark):
    from corpusmill.operators import metrics as OM

    df = spark.createDataFrame([("a", 4.0, 2, 1), ("a", 2.0, 1, 1), ("b", 0.0, 0, 0)], "split string, nll_sum double, n_tokens long, n_correct long")
    got = {r.split: r for r in OM.split_metrics(df).collect()}
    assert got["a"].avg_nll == 2.0 and got["a"].n_tokens == 3 and got["b"].n_tokens == 0


def test_loss_is_linear_in_the_width(spark):
    """The maximum and the log-sum-exp are taken once: the plan's size and its
    time do not grow with a second factor of the width."""
    import time

    from corpusmill.functions import metrics as FM
    from pyspark.sql import functions as F

    def seconds(width):
        df = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda x: (x % 7).cast("double")).alias("l"))
        best = 1e9
        for _ in range(2):
            t = time.time()
            df.select(F.sum(FM.nll("l", F.lit(3), 0.1))).collect()
            best = min(best, time.time() - t)
        return best

    seconds(64)
    # quadratic, 8,192 would take 16,000 times what 64 takes
    assert seconds(8192) < 40 * max(seconds(64), 0.05)
