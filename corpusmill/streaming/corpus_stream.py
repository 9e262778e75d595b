"""Structured Streaming forms of the row-wise operators.

The reference processes files one at a time with no cross-file state, so
every row operator (normalisers, comment removal, reply clean-up, code
blocks) runs unchanged on a stream. What needs state is expressed with
Spark's own stateful operators:

* incremental "skip what already exists": ``dropDuplicates`` on the key
  (state per key; with a watermark column the state can be evicted);
* splitting unbounded input: the stateless hash-threshold split;
* running status tallies: a streaming ``groupBy(status).count()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import docs as D
from corpusmill.functions import text as TX
from corpusmill.operators.split import split_threshold


def normalize_stream(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Row-local normal forms of a stream of files: C sources get the
    evaluation form, listings the assembly form (no window, no shuffle)."""
    n = F.col(name)
    normalized = (F.when(n.endswith(".s"), TX.normalize_asm_expr(content))
                  .otherwise(TX.normalize_for_eval(content)))
    return files.select(name, normalized.alias("normalized"), TX.remove_comments(content).alias("comment_free"))


def new_keys_only(stream: DataFrame, key: str, watermark_col: str | None = None,
                  delay: str = "1 hour") -> DataFrame:
    """Emit each key once (skip already produced keys incrementally)."""
    if watermark_col:
        return stream.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def split_stream(stream: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed=42) -> DataFrame:
    return stream.withColumn("split", split_threshold(key, train, val, seed))


def reply_codes(stream: DataFrame, response: str = "response") -> DataFrame:
    code = D.reply_to_code(response)
    return stream.withColumn("code", code).withColumn(
        "status", F.when(F.col("code").isNull(), "no reply").when(F.col("code") == "", "empty").otherwise("written"))


def running_tally(stream: DataFrame, status: str = "status") -> DataFrame:
    return stream.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
