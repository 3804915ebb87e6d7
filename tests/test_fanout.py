"""Fan-out to listeners: each sink right after a kill between two sinks, cursors, one job's listener, retention."""

import os

import pytest

from quire.streaming import fanout

SCHEMA = "job_id string, ts timestamp, event string, status string, progress double, stage string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, "job_id string, ts string, event string, status string, progress double, stage string").selectExpr("job_id", "timestamp(ts) ts", "event", "status", "progress", "stage").coalesce(1).write.mode("append").parquet(folder)


def events(first, n=4):
    return [(f"job{k % 3}", f"2024-01-01 00:00:{first + k:02d}", f"e{first + k}", "completed" if k == n - 1 else "running", k / n, "s") for k in range(n)]


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def names(df):
    return sorted(r.event for r in df.collect())


def test_kill_between_two_sinks(spark, tmp_path):
    put(spark, f"{tmp_path}/in", events(0))
    sinks, killed = fanout.listeners(), []

    def dies(e):
        if not killed:
            killed.append(1)
            raise RuntimeError("killed")
        return e

    with pytest.raises(Exception, match="killed"):
        fanout.fan_out(source(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", {"all": sinks["all"], "late": dies})
    assert fanout.batches(spark, f"{tmp_path}/out", "all") == [0] and fanout.batches(spark, f"{tmp_path}/out", "late") == []
    written = sorted(os.listdir(f"{tmp_path}/out/all/batch=000000000"))
    put(spark, f"{tmp_path}/in", events(10))
    fanout.fan_out(source(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", {"all": sinks["all"], "late": dies})
    assert sorted(os.listdir(f"{tmp_path}/out/all/batch=000000000")) == written
    for sink in ("all", "late"):
        rows, at = fanout.listen(spark, f"{tmp_path}/out", sink)
        assert names(rows) == sorted(f"e{k}" for k in (*range(4), *range(10, 14))) and at == 1


def test_half_written_batch_is_written_anew(spark, tmp_path):
    put(spark, f"{tmp_path}/b", events(0))
    batch = spark.read.parquet(f"{tmp_path}/b")
    fanout.write_batch(batch, 0, f"{tmp_path}/out", fanout.listeners())
    os.remove(f"{tmp_path}/out/all/batch=000000000/_SUCCESS")
    assert fanout.listen(spark, f"{tmp_path}/out") == (None, -1)
    fanout.write_batch(batch, 0, f"{tmp_path}/out", fanout.listeners())
    assert names(fanout.listen(spark, f"{tmp_path}/out")[0]) == ["e0", "e1", "e2", "e3"]


def test_listeners(spark, tmp_path):
    out = f"{tmp_path}/out"
    for first in (0, 10, 20):
        put(spark, f"{tmp_path}/in", events(first))
    fanout.fan_out(source(spark, f"{tmp_path}/in"), out, f"{tmp_path}/cp")
    rows, at = fanout.listen(spark, out, "by_job", "job1")
    assert names(rows) == ["e1", "e11", "e21"] and at == 2
    assert names(fanout.listen(spark, out, "ended")[0]) == ["e13", "e23", "e3"]
    assert fanout.listen(spark, out, "all", after=at) == (None, 2)
    put(spark, f"{tmp_path}/in", events(30))
    fanout.fan_out(source(spark, f"{tmp_path}/in"), out, f"{tmp_path}/cp")
    assert names(fanout.listen(spark, out, "all", after=at)[0]) == ["e30", "e31", "e32", "e33"]
    assert fanout.drop_batches(spark, out, "all", 3) == 3 and fanout.batches(spark, out, "all") == [3]
    assert fanout.listen(spark, out, "nothing") == (None, -1)
