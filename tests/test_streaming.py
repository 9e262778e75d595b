"""Row operators and state on a stream (file source -> memory sink)."""
import os
import tempfile

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.streaming import corpus_stream as CS


def test_stream_normalise_dedupe_split_tally(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-stream-")
    rows = [("a.c", "int f()\n{ return 0; } // c"), ("a.c", "dup"), ("b.s", "\t.text\nmain:\n\tret # x")]
    spark.createDataFrame(rows, "name string, content string").write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema("name string, content string").parquet(os.path.join(d, "in"))
    norm = CS.normalize_stream(stream)
    q = norm.writeStream.format("memory").queryName("norm_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.name, r.normalized) for r in spark.sql("select * from norm_out").collect()}
    assert ("b.s", "main:\nret") in got
    assert ("a.c", "int f() { return 0; } // c") in got

    first = CS.split_stream(CS.new_keys_only(stream, "name"), "name")
    q = first.writeStream.format("memory").queryName("first_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) c from first_out").first().c == 2

    tallied = CS.running_tally(stream.withColumn("status", F.when(F.col("name").endswith(".c"), "c").otherwise("s")))
    q = tallied.writeStream.format("memory").queryName("tally_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.status: r.n for r in spark.sql("select * from tally_out").collect()} == {"c": 2, "s": 1}


def test_expression_forms_are_stream_safe(spark):
    # the row-local asm form must not need a window (windows are rejected on streams)
    d = tempfile.mkdtemp(prefix="corpusmill-stream2-")
    spark.createDataFrame([("\t.section .rodata\n\t.string \"s\"\n",)], "t string").write.parquet(d + "/in")
    s = spark.readStream.schema("t string").parquet(d + "/in").select(T.normalize_asm_expr("t").alias("a"))
    q = s.writeStream.format("memory").queryName("asm_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select a from asm_out").first().a == '.string "s"'


def test_new_keys_with_watermark(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-stream3-")
    rows = [("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:00:30"), ("k2", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "key string, t string").select(
        "key", F.to_timestamp("t").alias("ts")).write.parquet(d + "/in")
    s = spark.readStream.schema("key string, ts timestamp").parquet(d + "/in")
    q = CS.new_keys_only(s, "key", "ts", "10 minutes").writeStream.format("memory").queryName("wm_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.sql("select key from wm_out").collect()) == ["k1", "k2"]


def test_reply_codes_on_stream(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-stream4-")
    rows = [('{"choices":[{"message":{"content":"```c\\nint main(){}\\n```"}}]}',), ("",)]
    spark.createDataFrame(rows, "response string").write.parquet(d + "/in")
    s = spark.readStream.schema("response string").parquet(d + "/in")
    q = CS.reply_codes(s).writeStream.format("memory").queryName("rc_out").start()
    q.processAllAvailable()
    q.stop()
    got = {r.status: r.code for r in spark.sql("select * from rc_out").collect()}
    assert got == {"written": "int main(){}\n", "empty": ""}
