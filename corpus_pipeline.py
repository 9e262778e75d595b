"""The corpus pipeline: from ``documents`` to token-budget batches.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; what it returns is written as Parquet into the shared folder and read
back as the next one's ``docs``. All but the last return the columns of
``documents``:

1. language ID: texts without a letter (null and empty ones too) go. Clean texts
   of every language stay.
2. exact dedup: of equal texts, the smallest id stays.
3. SimHash near-dedup: one document of each group of near-duplicates stays.
4. secret scan: every reported secret becomes ``[SECRET]``; no row goes.
5. packing: a row per document with its length bucket, batch and slot.

Null ids are kept like others; columns besides those of ``documents`` pass
through to the last stage. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, langid, packing, secrets, simhash
from corpusmill.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.learn(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the number of characters follows the text
    return secrets.redacted(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: language ID and SimHash have no SQL form; tests/llm/test_pipeline.py holds the
#: result against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
