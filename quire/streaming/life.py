"""A runner's life with its timers: idle exit, end of the cool-down, and forgetting; as a stream with state and as a batch.

A runner is cold, starting, warming, up, error or stopping. What an event brings is in jobs.STATE_OF; an error brings error, or stopping from the third in a row on. A start within the cool-down after a third error is refused: it changes nothing.
Each event that brings a state winds a clock anew: in starting, warming, up and error the runner exits after `idle` seconds, and after errors that stopped it, it has cooled down after `cooldown` seconds; either way it's cold. The row of a clock has the errors of the event that wound it. An event at the very time of a clock comes first. After `forget`
seconds without any event a runner is forgotten, its errors too, and its state goes from the store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.storage import new_path
from quire.streaming.jobs import COOLDOWN, FAILURES, STATE_OF, _timed, runner_life

#: Seconds without a request after which a runner exits; states in which it runs.
IDLE_SECONDS = 900
RUNNING = ("starting", "warming", "up", "error")
FORGET = 86_400  # seconds


def _checked(cooldown: int, idle: int, forget: int) -> None:
    if min(cooldown, idle) <= 0 or forget <= max(cooldown, idle):
        raise ValueError("idle and cool-down must be positive, and forgetting must come after both")


def runner_timeline(events: DataFrame, cooldown: int = COOLDOWN, idle: int = IDLE_SECONDS, forget: int = FORGET, until: str | None = None) -> DataFrame:
    """runner_id, ts, event, state, errors, refused: a row for each event, and one, idle_exit or cooled, for each clock that rang before the next event that brings a state, or by `until` (default: the last event of all).

    events: runner_id, ts, seq, event. Null ids are one runner, an unknown or null event brings nothing; rows without a time are left out. An empty table gives no rows.
    """
    _checked(cooldown, idle, forget)
    events = _timed(events).filter("ts IS NOT NULL").withColumn("event", F.coalesce("event", F.lit("")))
    order = Window.partitionBy("runner_id").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    rows = events.withColumn("_spell", F.sum(F.coalesce((gap > forget * 1_000_000).cast("int"), F.lit(0))).over(order))
    life = runner_life(rows, cooldown, ("runner_id", "_spell"))
    table = F.create_map(*(F.lit(x) for pair in STATE_OF.items() for x in pair))
    bad = F.col("event") == "error"
    brings = bad | (~F.col("refused") & F.try_element_at(table, F.col("event")).isNotNull())
    wait = F.when(bad & (F.col("errors") >= FAILURES), cooldown).when(F.col("state").isin(*RUNNING), idle)
    life = life.withColumn("_brings", F.coalesce(brings, F.lit(False))).withColumn("_due", F.when(F.col("_brings"), F.col("ts") + F.make_dt_interval(secs=wait)))
    so_far = Window.partitionBy("runner_id", "_spell").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    due = F.last(F.when(F.col("_brings"), F.struct("_due")), ignorenulls=True).over(so_far)["_due"]
    told = life.withColumn("state", F.when(due < F.col("ts"), "cold").otherwise(F.col("state")))
    rung = life.filter("_brings").withColumn("_next", F.lead("ts").over(order))
    rung = rung.withColumn("_until", F.lit(until).cast("timestamp") if until else events.agg(F.max("ts")).scalar())
    rung = rung.filter(F.col("_due").isNotNull() & F.when(F.col("_next").isNull(), F.col("_due") <= F.col("_until")).otherwise(F.col("_due") < F.col("_next")))
    rung = rung.select("runner_id", F.col("_due").alias("ts"), F.when(bad & (F.col("errors") >= FAILURES), "cooled").otherwise("idle_exit").alias("event"), F.lit("cold").alias("state"), "errors", F.lit(False).alias("refused"))
    return told.select("runner_id", "ts", "event", "state", "errors", "refused").unionByName(rung)


@dataclass
class _Runner:
    """A runner's state between events; times are microseconds."""

    state: str = "cold"
    errors: int = 0
    third: int | None = None
    due: int | None = None
    wound: int = 0  # errors when the clock was wound
    seen: int | None = None

    def ring(self, before: int) -> list[tuple]:
        """The row of the clock, if it's due before this time."""
        if self.due is None or self.due >= before:
            return []
        event = "idle_exit" if self.state in RUNNING else "cooled"
        at, self.state, self.due = self.due, "cold", None
        return [(at, event, "cold", self.wound, False)]

    def take(self, at: int, event: str | None, cooldown: int, idle: int, forget: int) -> list[tuple]:
        """The row of an event, after that of a clock that rang before it."""
        rows = self.ring(at)
        if self.seen is not None and at - self.seen > forget:
            self.__init__()
        self.seen = at
        refused = event == "start" and self.third is not None and at // 1_000_000 - self.third // 1_000_000 < cooldown // 1_000_000
        if event == "error":
            self.errors += 1
            self.third = at if self.errors == FAILURES else self.third
            self.state = "stopping" if self.errors >= FAILURES else "error"
        else:
            self.errors = self.errors if event == "start" else 0
            self.state = self.state if refused else STATE_OF.get(event, self.state)
        if event == "error" or event in STATE_OF and not refused:
            wait = cooldown if event == "error" and self.state == "stopping" else idle if self.state in RUNNING else None
            self.due, self.wound = None if wait is None else at + wait, self.errors
        return [*rows, (at, event, self.state, self.errors, refused)]


class _Life(StatefulProcessor):
    """Events wait until the watermark has passed them, so that those that come out of order within the delay are told in order."""

    def __init__(self, cooldown: int, idle: int, forget: int):
        self.limits = tuple(1_000_000 * s for s in (cooldown, idle, forget))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, event string")
        self.life = handle.getValueState("life", "state string, errors long, third long, due long, wound long, seen long")

    def _arm(self, *times: int | None) -> None:
        """One timer, at the first of these times."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at := [t for t in times if t is not None]:
            self.handle.registerTimer(min(at) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows:
            fresh += [(int(at), int(seq), event) for at, seq, event in zip(batch["at"], batch["seq"], batch["event"])]
        self.waiting.appendList(fresh)
        armed = [1000 * t for t in self.handle.listTimers()]
        self._arm(*armed, min(at for at, _, _ in fresh))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * timerValues.getCurrentWatermarkInMs() + 999
        held = sorted(self.waiting.get() if self.waiting.exists() else [], key=lambda r: r[:2])
        ready, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        runner, out = _Runner(*self.life.get()) if self.life.exists() else _Runner(), []
        for at, _, event in ready:
            out += runner.take(at, event, *self.limits)
        out += runner.ring(min([now + 1, *(at for at, _, _ in later)]))
        forgotten = runner.seen is not None and runner.due is None and runner.seen + self.limits[2] < now
        self.life.clear() if forgotten else self.life.update(astuple(runner))
        self.waiting.put(later) if later else self.waiting.clear()
        end = None if forgotten or runner.seen is None else runner.due if runner.due is not None else runner.seen + self.limits[2] + 2000
        self._arm(end, *(at for at, _, _ in later[:1]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["runner_id", "at", "event", "state", "errors", "refused"])

    def close(self) -> None:
        pass


def stream_timeline(events: DataFrame, late: str = "10 minutes", cooldown: int = COOLDOWN, idle: int = IDLE_SECONDS, forget: int = FORGET) -> DataFrame:
    """runner_timeline() of a stream, in append mode: rows come once the watermark, `late` behind the newest event, has passed them. Later events are dropped.

    Equal times are told apart by seq, within the millisecond too. Needs the RocksDB state store (see run()); a restart goes on from the checkpoint.
    """
    _checked(cooldown, idle, forget)
    rows = _timed(events).filter("ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("runner_id").cast("string").alias("runner_id"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("event", F.lit("")).alias("event"))
    told = rows.groupBy("runner_id").transformWithStateInPandas(_Life(cooldown, idle, forget), "runner_id string, at long, event string, state string, errors long, refused boolean", "append", "eventTime")
    return told.select("runner_id", F.timestamp_micros("at").alias("ts"), "event", "state", "errors", "refused")


def run(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes what a stream has by now to Parquet files in the folder, and ends; a next call with the same checkpoint goes on."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def told_by_now(stream: DataFrame) -> DataFrame:
    """The rows of a stream over what its source has by now, by way of files in the shared folder."""
    spark = stream.sparkSession
    run(stream, folder := new_path(spark, "stream-out"), new_path(spark, "stream-state"))
    return spark.read.schema(stream.schema).parquet(folder)
