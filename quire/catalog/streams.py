"""Queries on events that run as streams: the timed life of runners, and the fan-out to listeners."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.base import table
from quire.catalog.records import LIFE
from quire.streaming import fanout, life

#: Seconds: six hours to cool down, twelve to be idle, two days to be forgotten.
LIMITS = (21_600, 43_200, 172_800)


def _stream(spark, sf_dir, name="events"):
    """A table as a stream. Sources of streams take folders, so a table of one file is taken from its folder by name."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _life(events):
    """A user's events as those of a runner's life, by their numbers."""
    event = F.element_at(F.array(*(F.lit(e) for e in LIFE)), (F.col("event_id") % 9 + 1).cast("int"))
    return events.select(F.col("user_id").cast("string").alias("runner_id"), "ts", F.col("event_id").alias("seq"), event.alias("event"))


def runner_timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return life.runner_timeline(_life(e), *LIMITS).withColumn("ts", F.col("ts").cast(e.schema["ts"].dataType))


def runner_timeline_stream(spark, sf_dir):
    e = _stream(spark, sf_dir)
    return life.told_by_now(life.stream_timeline(_life(e), "0 seconds", *LIMITS)).withColumn("ts", F.col("ts").cast(e.schema["ts"].dataType))


def job_fan_out(spark, sf_dir):
    """A user's events as those of a job; what each listener is dealt, by job."""
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"))
    folder = fanout.dealt_by_now(e)
    dealt = [fanout.listen(spark, folder, sink)[0] for sink in ("all", "by_job", "ended")]
    rows = [d.groupBy("job_id", "status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.max("ts").alias("last")).withColumn("sink", F.lit(s)) for d, s in zip(dealt, ("all", "by_job", "ended"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {f.__name__: f for f in (runner_timeline, runner_timeline_stream, job_fan_out)}

_TIMELINE = f"""WITH e AS (SELECT user_id::VARCHAR AS runner_id, ts, event_id AS seq, {list(LIFE)}[event_id % 9 + 1] AS event FROM events),
            l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY runner_id ORDER BY ts, seq)) > 172800000000 AS far FROM e),
            p AS (SELECT *, count(*) FILTER (far) OVER (PARTITION BY runner_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS spell FROM l),
            r AS (SELECT *, count(*) FILTER (event NOT IN ('error', 'start')) OVER (PARTITION BY runner_id, spell ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM p),
            c AS (SELECT *, count(*) FILTER (event = 'error') OVER (PARTITION BY runner_id, spell, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS errors FROM r),
            t AS (SELECT *, max(CASE WHEN event = 'error' AND errors = 3 THEN floor(epoch(ts)) END) OVER (PARTITION BY runner_id, spell ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS third FROM c),
            f AS (SELECT *, event = 'start' AND coalesce(floor(epoch(ts)) - third < 21600, false) AS refused FROM t),
            b AS (SELECT *, CASE WHEN event = 'error' THEN CASE WHEN errors >= 3 THEN 'stopping' ELSE 'error' END WHEN NOT refused THEN CASE event WHEN 'start' THEN 'starting' WHEN 'alive' THEN 'warming' WHEN 'ready' THEN 'up' WHEN 'infer_ok' THEN 'up' WHEN 'shutdown' THEN 'stopping' ELSE 'cold' END END AS brings FROM f),
            d AS (SELECT *, CASE WHEN event = 'error' AND errors >= 3 THEN ts + INTERVAL 21600 SECOND WHEN brings IN ('starting', 'warming', 'up', 'error') THEN ts + INTERVAL 43200 SECOND END AS due FROM b),
            k AS (SELECT *, lead(ts) OVER (PARTITION BY runner_id ORDER BY ts, seq) AS nx FROM d WHERE brings IS NOT NULL)
        SELECT d.runner_id, d.ts, d.event, CASE WHEN k.due < d.ts THEN 'cold' ELSE coalesce(k.brings, 'cold') END AS state, d.errors, d.refused
        FROM d LEFT JOIN k ON k.runner_id = d.runner_id AND k.spell = d.spell AND (k.ts, k.seq) <= (d.ts, d.seq) AND (k.nx IS NULL OR k.nx > d.ts OR NOT EXISTS (SELECT 1 FROM k z WHERE z.runner_id = d.runner_id AND z.spell = d.spell AND (z.ts, z.seq) <= (d.ts, d.seq) AND (z.ts, z.seq) > (k.ts, k.seq)))
        UNION ALL SELECT runner_id, due, CASE WHEN event = 'error' AND errors >= 3 THEN 'cooled' ELSE 'idle_exit' END, 'cold', errors, false FROM k WHERE due < nx OR nx IS NULL AND due <= (SELECT max(ts) FROM events)"""
_DEALT = "SELECT user_id::VARCHAR AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, max(ts) AS last FROM events GROUP BY ALL"

ORACLE_SQL = {
    "runner_timeline": _TIMELINE,
    "runner_timeline_stream": _TIMELINE,
    "job_fan_out": f"WITH d AS ({_DEALT}) SELECT *, unnest(['all', 'by_job']) AS sink FROM d UNION ALL SELECT *, 'ended' FROM d WHERE status <> 'running'",
}
