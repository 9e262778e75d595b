"""Token-level evaluation: flatten logits, score, aggregate per split, and
pad batches. All aggregates are plain ``groupBy`` sums (partial + final
aggregation, so a split holding most rows costs one small partial per
task)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import metrics as M


def flatten_logits(df: DataFrame, logits: str = "logits", labels: str = "labels",
                   keep=("split", "stem"), norms: str = "norms") -> DataFrame:
    """``[B,T,V]`` rows (``array<array<double>>`` logits with ``array<int>``
    labels) -> one row per position ``(…, pos, logits, label)``. If the frame has
    ``norms``, the :func:`functions.metrics.log_norm` of each row of logits, there
    is ``norm`` too."""
    keep = [c for c in keep if c in df.columns]
    with_norms = norms in df.columns
    z = F.posexplode(F.arrays_zip(F.col(logits).alias("l"), F.col(labels).alias("y"), *([F.col(norms).alias("n")] if with_norms else [])))
    return df.select(*keep, z).select(*keep, "pos", F.col("col.l").alias("logits"), F.col("col.y").alias("label"),
                                      *([F.col("col.n").alias("norm")] if with_norms else []))


def score_tokens(df: DataFrame, logits: str = "logits", label: str = "label",
                 smoothing: float = 0.0, norm: str = "norm") -> DataFrame:
    """Add ``nll`` (NULL where ignored or not scorable), ``pred`` (argmax) and
    ``correct``. Positions that can't be scored are told by
    :func:`rejected_tokens`. A frame that has ``norm``, the log-sum-exp of each row
    of logits (:func:`functions.metrics.log_norm`), is scored without taking it anew;
    the smoothed loss needs all of the logits, and takes them."""
    if norm in df.columns and not smoothing:
        out = df.withColumn("pred", M.argmax(logits)).withColumn("nll", M.nll_of_norm(logits, label, norm))
    else:
        both = M.losses(logits, label, smoothing)
        out = df.withColumn("__losses", both).withColumn("pred", M.argmax(logits)).withColumn("nll", F.col("__losses.nll"))
        if smoothing:
            out = out.withColumn("nll_smoothed", F.col("__losses.nll_smoothed"))
    return out.drop("__losses").withColumn(
        "correct", F.col("nll").isNotNull() & F.coalesce(F.col("pred") == F.col(label), F.lit(False)))


def rejected_tokens(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Positions with a label (not the ignored one) that can't be scored: it
    lies outside the logits, or logits are missing."""
    return df.where((F.col(label) != M.IGNORE_INDEX) & ~M.scorable(logits, label))


def split_metrics(scored: DataFrame, group: str = "split", digits: int | None = 6,
                  smoothing: float = 0.0) -> DataFrame:
    """Token-weighted metrics per group over the positions that can be scored
    (or, if ``scored`` has ``nll_sum``, ``n_tokens`` and ``n_correct`` per row, as
    a scorer plug-in gives them, over those sums): ``n_tokens``, ``nll_sum``,
    ``avg_nll = sum / max(n, 1)``, ``perplexity = exp(avg_nll)`` (no cap),
    ``token_accuracy = correct / max(n, 1)``, ``masked_accuracy`` (NaN when
    no labelled token) and, with smoothing, the smoothed loss and its
    perplexity (``+inf`` on overflow)."""
    if {"nll_sum", "n_tokens", "n_correct"} <= set(scored.columns):
        if smoothing:
            raise ValueError("sums per row hold no smoothed loss")
        aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "nll_sum", "n_correct")]
    else:
        aggs = [
            F.count("nll").alias("n_tokens"),
            F.coalesce(F.sum("nll"), F.lit(0.0)).alias("nll_sum"),
            F.count_if(F.col("correct")).alias("n_correct"),
        ]
    if smoothing:
        aggs.append(F.coalesce(F.sum("nll_smoothed"), F.lit(0.0)).alias("smoothed_sum"))
    g = scored.groupBy(group).agg(*aggs)
    n1 = F.greatest(F.col("n_tokens"), F.lit(1))
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    cols = [
        F.col(group), F.col("n_tokens"), r(F.col("nll_sum")).alias("nll_sum"),
        r(F.col("nll_sum") / n1).alias("avg_nll"),
        r(M.perplexity(F.col("nll_sum") / n1)).alias("perplexity"),
        r(F.col("n_correct") / n1).alias("token_accuracy"),
        F.when(F.col("n_tokens") == 0, F.lit(float("nan"))).otherwise(r(F.col("n_correct") / F.col("n_tokens")))
        .alias("masked_accuracy"),
    ]
    if smoothing:
        cols += [r(F.col("smoothed_sum") / n1).alias("smoothed_loss"),
                 r(M.perplexity(F.col("smoothed_sum") / n1)).alias("smoothed_perplexity")]
    return g.select(*cols)


def pad_batches(df: DataFrame, ids: str, batch_cols=("batch_id",), pad_id: int = 0,
                mask_pad: bool = True) -> DataFrame:
    """Pad every sequence to its batch maximum. Adds ``padded`` (ids + pad),
    ``attention_mask`` (1 on real positions) and, with ``mask_pad``,
    ``labels`` where every value equal to the pad id becomes -100 (by value:
    a real token equal to the pad id is masked too)."""
    w = Window.partitionBy(*batch_cols)
    n = F.size(F.col(ids))
    m = F.max(n).over(w)
    out = (df.withColumn("__m", m)
           .withColumn("padded", F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), F.col("__m") - n)))
           .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n),
                                                  F.array_repeat(F.lit(0), F.col("__m") - n))))
    if mask_pad:
        out = out.withColumn("labels", F.transform("padded", lambda x: M.mask_label(x, pad_id)))
    return out.drop("__m")


def tally(df: DataFrame, status: str = "status") -> DataFrame:
    """Run tallies: rows per status."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def metrics_summary(metrics: DataFrame, group: str = "split") -> DataFrame:
    """One printable line per split: name padded to 10, NLL and perplexity
    with 4 decimals, token accuracy as a percentage with 4 decimals."""
    line = F.format_string("%-10s | NLL: %.4f | PPL: %.4f | token_acc: %.4f%%", F.col(group),
                           F.col("avg_nll"), F.col("perplexity"), F.col("token_accuracy") * 100.0)
    return metrics.select(group, line.alias("summary"))
