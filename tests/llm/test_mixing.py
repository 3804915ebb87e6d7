from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefghij"), st.floats(0.01, 10), min_size=1), st.integers(100, 700))
def test_schedule_meets_windows_and_deviation(weights, period):
    units = mixing.units_of(weights, period)
    assert sum(units.values()) == period and min(units.values()) >= 1
    done = Counter()
    for k, i, slot, release, deadline in mixing.schedule(units):
        assert release <= slot < deadline and i == done[k]
        done[k] += 1
        for s, u in units.items():
            assert abs(done[s] - (slot + 1) * u / period) < 1
    assert done == units


def frame(spark):
    return spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit("x").alias("Slot"))


def test_mix_follows_targets(spark):
    df = frame(spark)
    rows = mixing.pfair_mix(df, ["doc_id"], weights={"hot": 3, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1, None: 0.2}, block_rows=4, period=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    mix = sorted((r.slot, r.in_block, r.source) for r in rows if r.in_mix)
    horizon = mix[-1][0] + 1
    assert [(s, i) for s, i, _ in mix] == [(s, i) for s in range(horizon) for i in range(4)], "whole blocks, no gaps"
    units = mixing.units_of({"nhot": 3, "ss0": 1, "ss1": 1, "ss2": 1, "ss3": 1, "ss4": 1, "n": 0.2}, 200)
    done = Counter()
    for slot, i, source in mix:
        done[source] += i == 3
        if i == 3:
            assert abs(done["hot"] - (slot + 1) * units["nhot"] / 200) < 1
    beyond = [r for r in rows if not r.in_mix]
    assert all(r.slot >= horizon for r in beyond)
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_blocks_hold_block_rows_in_any_layout(spark):
    rows = mixing.pfair_mix(frame(spark), ["doc_id"], block_rows=8).collect()
    sizes = Counter((r.source, r.block) for r in rows)
    total = Counter(r.source for r in rows)
    assert all(n == 8 or b == total[s] // 8 for (s, b), n in sizes.items())
    again = mixing.pfair_mix(frame(spark).repartition(3), ["doc_id"], block_rows=8).collect()
    assert {(r.doc_id, r.slot, r.in_block) for r in rows} == {(r.doc_id, r.slot, r.in_block) for r in again}


def test_sources_without_weight_are_left_out(spark):
    rows = mixing.pfair_mix(frame(spark), ["doc_id"], weights={"hot": 1, "s1": 1, "absent": 5}).collect()
    assert len(rows) == 3000 and all((r.slot is None) == (r.source not in ("hot", "s1")) for r in rows) and not any(r.in_mix for r in rows if r.slot is None)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a")] * 20 + [(1, "b")] * 20, "doc_id long, source string")
    rows = mixing.pfair_mix(df, ["doc_id"], block_rows=2).collect()
    assert len({(r.slot, r.in_block) for r in rows}) == 40


def test_empty_table_and_too_many_sources(spark):
    out = mixing.pfair_mix(spark.createDataFrame([], "doc_id long, source string"), ["doc_id"])
    assert out.count() == 0 and {"doc_id", "source", "slot", "in_mix"} <= set(out.columns)
    with pytest.raises(ValueError):
        mixing.pfair_mix(frame(spark), ["doc_id"], max_sources=2)


def test_mix_keeps_all_rows_when_sources_run_out(spark):
    sizes = {"a": 330, "b": 330, "c": 95, "tiny": 5, None: 1}
    df = spark.createDataFrame([(i, k) for k, n in sizes.items() for i in range(n)], "doc_id long, source string")
    rows = mixing.pfair_mix(df, ["doc_id"]).collect()
    assert len(rows) == sum(sizes.values()) and all(r.in_mix and r.release <= r.slot < r.deadline for r in rows)
    source = {r.slot: r.source for r in rows}
    assert sorted(source) == list(range(sum(-(-n // 16) for n in sizes.values())))
    assert len({(r.slot, r.in_block) for r in rows}) == len(rows)
    fluid, done, goal = Counter(), Counter(), {k: n**0.7 for k, n in sizes.items()}
    for slot in sorted(source):  # each slot is shared out among the sources that have blocks left
        room = 1.0
        while room > 1e-9:
            alive = {k: w for k, w in goal.items() if -(-sizes[k] // 16) - fluid[k] > 1e-9}
            step = min(room, *((-(-sizes[k] // 16) - fluid[k]) * sum(alive.values()) / w for k, w in alive.items()))
            for k, w in alive.items():
                fluid[k] += step * w / sum(alive.values())
            room -= step
        done[source[slot]] += 1
        assert all(abs(done[k] - fluid[k]) < 1 + 1e-6 for k in sizes)


def test_pipeline_stage_loses_no_document(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i, "x", "big" if i % 2 else "large") for i in range(400)] + [(400 + i, "y", "tiny") for i in range(10)], "doc_id long, text string, source string")
    out = corpus_pipeline.mix_sources(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == list(range(410))


@pytest.mark.parametrize("goal", [{"big": 0.5, **{f"s{k:02d}": 0.5 / 19 for k in range(19)}}, {"big": 1.0, "rare": 1e-5}, {f"s{k:03d}": 1.0 + k for k in range(120)}])
def test_whole_mix_stays_within_a_block_of_the_given_weights(goal):
    total, n = sum(goal.values()), 20_000
    units = mixing.whole(goal)
    done, seen = Counter(), 0
    for k, i, slot, release, deadline in mixing.schedule(units, dict.fromkeys(goal, n)):
        if slot >= n:  # no source runs out before
            break
        assert i == done[k] and release <= slot < deadline
        done[k] += 1
        seen += 1
        if slot % 97 == 0 or slot == n - 1:
            assert all(abs(done[s] - (slot + 1) * w / total) < 1 + 1e-6 for s, w in goal.items())
    assert seen == n


def test_rows_follow_the_given_weights(spark):
    goal = {"big": 0.5, **{f"s{k:02d}": 0.5 / 19 for k in range(19)}}
    df = spark.createDataFrame([(i, k) for k, w in goal.items() for i in range(round(1520 * w))], "doc_id long, source string")
    at = {r.slot: r.source for r in mixing.pfair_mix(df, ["doc_id"], weights=goal, block_rows=1).collect()}
    done = Counter()
    for slot in range(1520):
        done[at[slot]] += 1
        assert all(abs(done[k] - (slot + 1) * w) < 1 + 1e-6 for k, w in goal.items())


def test_hundred_thousand_sources():
    goal = {f"s{k}": 1.0 + k % 5 for k in range(100_000)}
    seen = [x for x in mixing.schedule(mixing.whole(goal), dict.fromkeys(goal, 2))]
    assert len(seen) == 200_000 and all(release <= slot < deadline for _, _, slot, release, deadline in seen)


def test_rows_alike_in_the_keys_and_names_that_clash(spark):
    names = ["src", "key", "tie", "row", "sub", "n", "start", "no", "k", "i", "s", "r", "d", "at", "in", "_k", "_s", "_units", "count"]
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), *(F.lit(j).alias(n) for j, n in enumerate(names)))
    seen = []
    for layout in (df, df.repartition(3)):
        out = mixing.pfair_mix(layout, ["doc_id"], hot=500)
        assert out.columns == [*df.columns, "block", "slot", "release", "deadline", "in_block", "in_mix"]
        rows = out.collect()
        assert all([r[n] for n in names] == list(range(len(names))) for r in rows) and len({(r.slot, r.in_block) for r in rows}) == 9000
        seen.append(sorted((r.slot, r.in_block, r.source, r.doc_id or -1) for r in rows))
    assert seen[0] == seen[1]


def test_query_keeps_to_its_uneven_targets(spark):
    from quire.llm import queries

    rows = queries.op10_mix(spark, "/root/testdata/sf0.01").collect()
    total = Counter(r.source for r in rows)
    goal = {k: queries.target(k, n) for k, n in total.items()}
    assert all(r.in_mix for r in rows) and max(goal.values()) > 3 * min(goal.values())
    at, done, fluid = {r.slot: r.source for r in rows}, Counter(), Counter()
    for slot in range(len(at)):
        room = 1.0
        while room > 1e-9:
            alive = {k: w for k, w in goal.items() if -(-total[k] // 16) - fluid[k] > 1e-9}
            step = min(room, *((-(-total[k] // 16) - fluid[k]) * sum(alive.values()) / w for k, w in alive.items()))
            for k, w in alive.items():
                fluid[k] += step * w / sum(alive.values())
            room -= step
        done[at[slot]] += 1
        assert all(abs(done[k] - fluid[k]) < 1 + 1e-6 for k in goal)
