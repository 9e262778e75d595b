"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "corpusmill") -> SparkSession:
    """Session for tests and the bench on one machine.

    On a cluster, build the session from the cluster's own configuration and
    only call :func:`ensure_checkpoint_dir` on it.
    """
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    parts = shuffle_partitions or max(8, 2 * int(n))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # rows carry whole texts: keep Arrow batches to a few hundred rows
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.driver.memory", os.environ.get("CORPUSMILL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only when a local
    session has none (tests, local runs). A cluster names a shared folder in
    ``spark.checkpoint.dir``; that setting always wins, and without it a
    cluster session is refused, as a folder of the driver's machine would not
    be seen by the executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    except Exception:  # no SparkContext (e.g. a Connect session): use the config as is
        return configured
    if configured:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="corpusmill-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost
    executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a new folder below the shared checkpoint
    folder and read it back: what stands above runs once, later readers take only
    the columns they need, and lost executors cost no recomputation."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
