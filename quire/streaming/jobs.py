"""Job and runner events as streams; each operator works on a static table too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Limits of the runner.
IDLE, FAILURES, QUEUE, COOLDOWN = "900 seconds", 3, 8, 120
#: The state that an event brings; errors are counted.
STATE_OF = {"start": "starting", "alive": "warming", "ready": "up", "infer_ok": "up", "shutdown": "stopping", "down": "cold"}
TERMINAL = ("completed", "failed", "cancelled")
EVENTS = "job_id string, ts timestamp, event string, status string, progress double, stage string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, fmt: str = "json", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def job_progress(events: DataFrame) -> DataFrame:
    """job_id, ts, status, progress, stage: the last of each job; for a stream, in update mode."""
    last = F.max_by(F.struct("ts", "status", "progress", "stage"), F.struct("ts", "event"))
    return events.groupBy("job_id").agg(last.alias("l")).select("job_id", "l.*")


def for_job(events: DataFrame, job_id: str) -> DataFrame:
    return events.filter(F.col("job_id") == job_id)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps of the session's time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None, kind: str = "event_type") -> DataFrame:
    """start, end, kind, n, value of event-time windows; events later than `late` are dropped by the watermark. An extension."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", kind, "n", "value")


def once(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark. An extension."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def busy_sessions(events: DataFrame, key: str = "user_id", idle: str = IDLE, late: str = "10 minutes") -> DataFrame:
    """key, start, end, n: spells of activity; a runner goes down at the end of one."""
    return _timed(events).withWatermark("ts", late).groupBy(key, F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")


def runner_states(events: DataFrame) -> DataFrame:
    """runner_id, ts, state, errors: batch form. Each error adds to the errors in a row, any success ends them; three mean stopping, a cool-down."""
    order = Window.partitionBy("runner_id").orderBy("ts", "ok")
    rows = events.withColumn("_run", F.sum(F.col("ok").cast("int")).over(order))
    inside = Window.partitionBy("runner_id", "_run").orderBy("ts", "ok")
    rows = rows.withColumn("errors", F.sum((~F.col("ok")).cast("int")).over(inside))
    return rows.select("runner_id", "ts", F.when(F.col("errors") >= FAILURES, "stopping").when(F.col("errors") > 0, "error").otherwise("up").alias("state"), "errors")


def runner_life(events: DataFrame, cooldown: int = COOLDOWN, keys: tuple[str, ...] = ("runner_id",)) -> DataFrame:
    """runner_id (or other keys), ts, seq, event, state, errors, refused: batch form of a runner's life. events: runner_id, ts, seq, event (start, alive, ready, infer_ok, error, shutdown or down).

    A runner is cold until it's started, and what the last event made of it. Errors in a row make it error, three stopping; a start less than `cooldown` seconds after the third is refused and changes nothing.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col("event") == "error"
    # a start is no answer of the runner, so it doesn't end a row of errors by itself
    rows = events.withColumn("_run", F.sum((~bad & (F.col("event") != "start")).cast("int")).over(so_far))
    inside = Window.partitionBy(*keys, "_run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("errors", F.sum(bad.cast("int")).over(inside))
    rows = rows.withColumn("_third", F.max(F.when(bad & (F.col("errors") == FAILURES), F.unix_timestamp("ts"))).over(before))
    rows = rows.withColumn("refused", (F.col("event") == "start") & F.coalesce(F.unix_timestamp("ts") - F.col("_third") < cooldown, F.lit(False)))
    table = F.create_map(*(F.lit(x) for pair in STATE_OF.items() for x in pair))
    brings = F.when(bad, F.when(F.col("errors") >= FAILURES, "stopping").otherwise("error")).when(~F.col("refused"), F.try_element_at(table, F.col("event")))
    return rows.select(*keys, "ts", "seq", "event", F.coalesce(F.last(brings, ignorenulls=True).over(so_far), F.lit("cold")).alias("state"), "errors", "refused")


def stream_runner_states(events: DataFrame) -> DataFrame:
    """The same of a stream of runner_id, ts, ok, in the order it comes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (errors,) = state.get if state.exists else (0,)
        for batch in batches:
            out = []
            for r in batch.sort_values(["ts", "ok"]).itertuples(index=False):
                errors = 0 if r.ok else errors + 1
                out.append((key[0], r.ts, "stopping" if errors >= FAILURES else "error" if errors else "up", errors))
            yield pd.DataFrame(out, columns=["runner_id", "ts", "state", "errors"])
        state.update((errors,))

    return events.groupBy("runner_id").applyInPandasWithState(step, "runner_id string, ts timestamp, state string, errors long", "errors long", "append", GroupStateTimeout.NoTimeout)


def job_status(events: DataFrame) -> DataFrame:
    """job_id, status, n of a stream: the status a job has, whatever it was before; a job that has ended leaves the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        for batch in batches:
            for r in batch.sort_values("ts").itertuples(index=False):
                status, n = r.status, n + 1
        yield pd.DataFrame([(key[0], status, n)], columns=["job_id", "status", "n"])
        state.remove() if status in TERMINAL else state.update((status, n))

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, n long", "status string, n long", "append", GroupStateTimeout.NoTimeout)


def queue_depth(events: DataFrame, key: str, change: Column, most: int = QUEUE) -> DataFrame:
    """events with in_flight, the sum of changes so far, and refused where it is over the limit."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("in_flight", F.sum(change).over(order)).withColumn("refused", F.col("in_flight") > most)


def too_soon(announcements: DataFrame, seconds: int = 5) -> DataFrame:
    """announcements (runner_id, url, ts) with limited: less than so many seconds after the one before, unless that had the same address."""
    order = Window.partitionBy("runner_id").orderBy("ts")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    return announcements.withColumn("limited", F.coalesce((gap < seconds) & (F.lag("url").over(order) != F.col("url")), F.lit(False)))
