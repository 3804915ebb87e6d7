import pytest
from pyspark.sql import functions as F

from quire.streaming import jobs


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)


def test_windows_equal_the_batch(spark, folder):
    got = drain(spark, jobs.windowed_counts(stream(spark, folder), size="1 hour"), "windows")
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
    assert got.count() > 0 and got.select("start", "event_type", "n").exceptAll(batch).count() == 0


def test_sessions_equal_the_batch(spark, folder):
    got = drain(spark, jobs.busy_sessions(stream(spark, folder)), "sessions")
    batch = spark.read.parquet(folder).groupBy("user_id", F.session_window("ts", jobs.IDLE).alias("s")).agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")
    assert got.count() > 0 and got.exceptAll(batch).count() == 0


def test_runner_states_equal_the_batch(spark, folder):
    ok = lambda df: df.select(F.col("user_id").cast("string").alias("runner_id"), "ts", F.col("event_type").isin("view", "purchase").alias("ok"))
    got = drain(spark, jobs.stream_runner_states(ok(stream(spark, folder))), "states", "append")
    batch = jobs.runner_states(ok(spark.read.parquet(folder)))
    assert sorted(map(tuple, got.select("runner_id", "ts", "state", "errors").collect())) == sorted(map(tuple, batch.select("runner_id", "ts", "state", "errors").collect()))


def test_job_status_and_once(spark, folder):
    rows = stream(spark, folder).select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_type").alias("status"))
    got = {r.job_id: (r.status, r.n) for r in drain(spark, jobs.job_status(rows), "status", "append").collect()}
    batch = spark.read.parquet(folder).groupBy(F.col("user_id").cast("string").alias("j")).agg(F.max_by("event_type", "ts").alias("s"), F.count("*").alias("n"))
    assert got == {r.j: (r.s, r.n) for r in batch.collect()}
    once = drain(spark, jobs.once(stream(spark, folder).withColumn("k", F.col("event_id") % 10), "k", "40 days"), "once")
    assert once.count() == 10


def test_progress_in_update_mode(spark, folder):
    rows = stream(spark, folder).select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_type").alias("event"), F.col("event_type").alias("status"), F.col("value").alias("progress"), F.lit("s").alias("stage"))
    got = drain(spark, jobs.job_progress(rows), "progress", "update")
    assert got.select("job_id").distinct().count() == spark.read.parquet(folder).select("user_id").distinct().count()
