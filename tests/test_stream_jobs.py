"""Streams run to the end of their input, stopped half-way and started again."""
import pytest
from corpusmill.streaming import jobs as J
from pyspark.sql import functions as F

SCHEMA = "k string, v long"


def _input(spark, path):
    """Five files with keys that come again within and across files."""
    for i in range(5):
        rows = [(f"k{j % 7}", 100 * i + j) for j in range(i, i + 9)] + [(None, i)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _keys(df):
    return sorted((r.k or "") for r in df.collect())


class Killed(Exception):
    pass


def _dies_in_batch(monkeypatch, when):
    """The process dies after batch ``when`` has written its rows, before the
    batch is committed: on the next start the same batch runs again."""
    whole = J.run_to_end

    def run(stream, path, checkpoint, each=None, mode="append"):
        def write(batch, batch_id):
            out = batch if each is None else each(batch, batch_id)
            out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            if batch_id == when:
                raise Killed

        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(J, "run_to_end", run)
    return lambda: monkeypatch.setattr(J, "run_to_end", whole)


@pytest.mark.parametrize("when", [0, 2])
def test_new_keys_after_a_restart(spark, tmp_path, monkeypatch, when):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    _input(spark, src)
    revive = _dies_in_batch(monkeypatch, when)

    def run():
        return J.produce_new(J.read_stream(spark, src + "/", SCHEMA, files_per_batch=1), "k", out, progress)

    with pytest.raises(Exception, match="Killed"):
        run()
    revive()
    got = run()
    assert _keys(got) == sorted(["", *{f"k{j}" for j in range(7)}])
    batch = spark.read.parquet(src).select("k").distinct()
    assert _keys(got) == _keys(batch)
    assert _keys(run()) == _keys(batch)  # nothing new: nothing more


def test_new_files_are_produced_by_the_next_run(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    _input(spark, src)
    run = lambda: J.produce_new(J.read_stream(spark, src + "/", SCHEMA), "k", out, progress)
    first = run().count()
    spark.createDataFrame([("k1", 5000), ("new", 5001)], SCHEMA).write.mode("append").parquet(src)
    assert run().count() == first + 1


@pytest.mark.parametrize("when", [1, 4])
def test_running_counts_after_a_restart(spark, tmp_path, monkeypatch, when):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    _input(spark, src)
    revive = _dies_in_batch(monkeypatch, when)

    def run():
        stream = J.read_stream(spark, src + "/", SCHEMA, files_per_batch=1)
        return J.last_tally(stream.withColumn("status", F.coalesce("k", F.lit("none"))), "status", out, progress)

    with pytest.raises(Exception, match="Killed"):
        run()
    revive()
    want = {r.k or "none": r["count"] for r in spark.read.parquet(src).groupBy("k").count().collect()}
    assert {r.status: r.n for r in run().collect()} == want
