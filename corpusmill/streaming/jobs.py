"""Streams that run to the end of what is there (``availableNow``) with their
state and progress in a checkpoint folder: started again after a stop or a
failure, they go on where they were, and every batch writes a folder of its own
(``batch=<id>``, replaced if the batch is run again), so nothing is written
twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files below ``path`` (a folder, or a file) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}*")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append") -> None:
    """Write every batch, after ``each(batch, id)``, below ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if each is None else each(batch, batch_id)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches have written, those before ``before`` only if given."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    df = spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path) if there else spark.createDataFrame([], f"{schema}, batch int")
    return df if before is None else df.where(F.col("batch") < before)


def produce_new(stream: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """Rows whose key was never produced: of each batch, those with a key that no
    earlier batch holds (an anti join) and one row for each key (the least of its
    other columns). A batch that is run again compares with the batches before it
    alone, so it writes the same rows."""
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rest = [c for c in stream.columns if c != key]

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        one = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else batch.distinct()
        done = batches(spark, path, schema, before=batch_id).select(F.col(key).alias("__done")).distinct()
        return one.join(done, F.col(key).eqNullSafe(F.col("__done")), "left_anti").select(*stream.columns)

    run_to_end(stream, path, checkpoint, fresh)
    return batches(spark, path, schema).drop("batch")


def last_tally(stream: DataFrame, status: str, path: str, checkpoint: str) -> DataFrame:
    """Running counts by status (kept as state), as they stand after the last batch."""
    from corpusmill.streaming.corpus_stream import running_tally

    tallied = running_tally(stream, status)
    run_to_end(tallied, path, checkpoint, mode="complete")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tallied.schema)
    every = batches(stream.sparkSession, path, schema)
    last = every.agg(F.max("batch").alias("last"))
    return every.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")  # one row
