"""Sinks: split membership, changed-only rewrites, logs, sample reports and
collision-safe code writes. All are DataFrame writes (no driver loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


def write_splits(splits: DataFrame, path: str, key: str = "stem", fmt: str = "parquet") -> None:
    """Split membership partitioned by ``split`` (``split=train/…``), so a
    reader of one split prunes the others."""
    w = splits.select(key, "split").write.mode("overwrite").partitionBy("split")
    if fmt == "text":
        w.text(path)
    else:
        w.parquet(path)


def changed_rows(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose text changed, for a rewrite-only-if-changed sink."""
    return df.where(F.col(before) != F.col(after))


def write_changed(df: DataFrame, path: str, key: str, before: str, after: str) -> None:
    """Rewrite only changed rows (keyed), as parquet."""
    changed_rows(df, before, after).select(key, F.col(after).alias("content")) \
        .write.mode("overwrite").parquet(path)


def write_logs(gated: DataFrame, ok_path: str, fail_path: str) -> None:
    """ok / failed log lines (one text line per row). The verdicts are taken
    once, into the checkpoint folder: an external step above must not run a
    second time, perhaps with another outcome."""
    lines = cut_lineage(gated.select("ok", F.col("log_line").alias("value")))
    lines.where("ok").select("value").write.mode("overwrite").text(ok_path)
    lines.where("not ok").select("value").write.mode("overwrite").text(fail_path)


def sample_report(samples: DataFrame, order_col: str, text_col: str) -> DataFrame:
    """``=== SAMPLE i ===`` blocks (0-based ``i`` in ``order_col`` order)
    over a small, already limited frame; ``value`` first, then the frame's
    other columns."""
    w = Window.orderBy(order_col)
    i = F.row_number().over(w) - 1
    return samples.select(F.concat(F.lit("\n=== SAMPLE "), i.cast("string"), F.lit(" ===\n"),
                                   F.col(text_col), F.lit("\n")).alias("value"),
                          *[F.col(c) for c in samples.columns if c != text_col])


def write_named(named: DataFrame, path: str) -> None:
    """Append the rows the naming step decided to write, one parquet row per
    file name, partitioned by nothing (names are unique)."""
    named.where(F.col("status").startswith("written")).select("name", "content") \
        .write.mode("append").parquet(path)
