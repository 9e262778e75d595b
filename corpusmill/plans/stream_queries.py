"""Registered streaming queries: the same operators over a table read as a
stream, run to its end with state and progress in the shared folder. Each equals
its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.session import fresh_folder
from corpusmill.sources.corpus import C_TEXT_SQL, STEM_SQL
from corpusmill.streaming import corpus_stream as CS
from corpusmill.streaming import jobs as J

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh folders for the output and the progress of one run."""
    root = fresh_folder(spark, name)
    return f"{root}/out", f"{root}/progress"


def stream_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: C sources arriving as a stream -> evaluation form and comment-free
    text, by the column functions of the batch queries."""
    out, progress = _folders(spark, "stream-normal-form")
    docs = J.read_stream(spark, f"{sf_dir}/documents.parquet", DOCS)
    files = docs.select(F.concat(F.expr(STEM_SQL), F.lit(".c")).alias("name"), F.expr(C_TEXT_SQL).alias("content"))
    J.run_to_end(CS.normalize_stream(files), out, progress)
    return J.batches(spark, out, "name string, normalized string, comment_free string").drop("batch")


def stream_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: texts not yet produced, by the hash of the text; of several documents
    in one batch the smallest id."""
    out, progress = _folders(spark, "stream-new-texts")
    docs = J.read_stream(spark, f"{sf_dir}/documents.parquet", DOCS)
    keyed = docs.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "doc_id")
    return J.produce_new(keyed, "text_sha256", out, progress).select("text_sha256")


def stream_reply_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4: running counts of what becomes of replies: no code in them, empty,
    or written."""
    out, progress = _folders(spark, "stream-reply-tally")
    turns = J.read_stream(spark, f"{sf_dir}/conversations.parquet", TURNS).where("role = 'assistant'")
    coded = CS.reply_codes(turns.select(T.strip_ws("text").alias("response")))
    return J.last_tally(coded, "status", out, progress)
