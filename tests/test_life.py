"""The timed life of runners: batch and stream against a plain simulation, restarts, late order, expiry of state."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quire.catalog import ORACLE_SQL
from quire.streaming import life

COOL, IDLE, FORGET = 120, 900, 5000
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "runner_id string, ts timestamp, seq long, event string"


def simulated(events, until):
    """Second by second facts of each runner, told again in plain loops."""
    brings = {"start": "starting", "alive": "warming", "ready": "up", "infer_ok": "up", "shutdown": "stopping", "down": "cold"}
    out = []
    for runner in {e[0] for e in events}:
        state, errors, third, clock, last = "cold", 0, None, None, None
        for _, ts, _, event in sorted((e for e in events if e[0] == runner), key=lambda e: e[1:3]) + [(runner, None, 0, None)]:
            if clock and (clock[0] < ts if ts else clock[0] <= until):
                state = "cold"
                out.append((runner, clock[0], clock[1], "cold", clock[2], False))
                clock = None
            if ts is None:
                break
            if last and ts - last > timedelta(seconds=FORGET):
                state, errors, third = "cold", 0, None
            last = ts
            refused = event == "start" and third is not None and (ts - third).total_seconds() < COOL
            if event == "error":
                errors += 1
                if errors == 3:
                    third = ts
                state, clock = ("stopping", (ts + timedelta(seconds=COOL), "cooled", errors)) if errors >= 3 else ("error", (ts + timedelta(seconds=IDLE), "idle_exit", errors))
            else:
                errors = errors if event == "start" else 0
                if event in brings and not refused:
                    state = brings[event]
                    clock = (ts + timedelta(seconds=IDLE), "idle_exit", errors) if state in ("starting", "warming", "up") else None
            out.append((runner, ts, event, state, errors, refused))
    return sorted(out, key=str)


def made(n=400, seed=1):
    rng, at, rows = random.Random(seed), {}, []
    for seq in range(n):
        runner = rng.choice("abcdef")
        at[runner] = at.get(runner, START) + timedelta(seconds=rng.choice([0, 1, 30, 119, 120, 121, 400, 899, 900, 901, 2000, 4999, 5001, 9000]))
        rows.append((runner, at[runner], seq, rng.choice(["start", "alive", "ready", "infer_ok", "error", "error", "error", "error", "shutdown", "down", "other"])))
    return sorted(rows, key=lambda r: r[1:3])


def told(df):
    rows = df.withColumn("us", F.unix_micros("ts")).collect()
    return sorted(((r.runner_id, START + timedelta(microseconds=r.us - int(START.timestamp() * 1e6)), r.event, r.state, r.errors, r.refused) for r in rows), key=str)


def test_batch_equals_simulation(spark):
    rows = made()
    got = told(life.runner_timeline(spark.createDataFrame(rows, SCHEMA), COOL, IDLE, FORGET))
    assert got == simulated(rows, rows[-1][1])
    assert {r[3] for r in got} == {"cold", "starting", "warming", "up", "error", "stopping"} and {"cooled", "idle_exit"} <= {r[2] for r in got}


def test_stream_with_a_restart_equals_simulation(spark, tmp_path):
    """Files come in turn, shuffled within the delay, and the stream ends and goes on from its checkpoint after each."""
    rows = made(300, 2)
    rng = random.Random(5)
    flush = ("z", rows[-1][1] + timedelta(days=1), 10**6, "down")
    late = [sorted(rows[k : k + 60], key=lambda _: rng.random()) for k in range(0, len(rows), 60)]
    source = f"{tmp_path}/in"
    for files in (late[:2], late[2:4], [late[4]], [[flush]]):
        for part in files:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        life.run(life.stream_timeline(stream, "3 days", COOL, IDLE, FORGET), f"{tmp_path}/out", f"{tmp_path}/state")
    spark.createDataFrame([("z", flush[1] + timedelta(days=4), 10**6 + 1, "down")], SCHEMA).write.mode("append").parquet(source)
    life.run(life.stream_timeline(spark.readStream.schema(SCHEMA).parquet(source), "3 days", COOL, IDLE, FORGET), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [r for r in told(spark.read.parquet(f"{tmp_path}/out")) if r[0] != "z"]
    assert got == [r for r in simulated([*rows, flush], flush[1] + timedelta(days=4)) if r[0] != "z"]


def test_forgetting_must_come_last(spark):
    with pytest.raises(ValueError):
        life.runner_timeline(spark.createDataFrame([], SCHEMA), 100, 200, 200)


def test_empty_and_odd_rows(spark):
    assert life.runner_timeline(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, START, 1, "start"), (None, START + timedelta(seconds=1), 2, None), ("a", None, 3, "start")]
    got = told(life.runner_timeline(spark.createDataFrame(rows, SCHEMA)))
    assert [(r[0], r[2], r[3]) for r in got] == [(None, "", "starting"), (None, "start", "starting")]
