"""Mixing sources to target weights by Pfair scheduling (operator 10).

The documents of a source, in the order of a seeded hash, form blocks; the last one may be smaller. Block i of a source with weight w has the release
time floor(i / w) and the deadline ceil((i + 1) / w), in slots of one block, as long as all sources have blocks. When a source runs out, the weights of the others grow by the same
factor, to a sum of 1 again, and the times of their blocks from there on follow these weights. In each slot the released block with the earliest deadline
goes next. The weights are exact fractions and sum up to 1, so every block meets its window and a source is never a block or more from its target
at any time. Every slot has a block, and every block a slot.

The slots are worked out on the driver, from the weights and the numbers of blocks alone, and go to the shared folder by pieces of PIECE blocks. Its time grows with the
number of blocks, about 5 seconds a million, so a table of more than MOST blocks of 16 rows has larger blocks.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import HOT, apart, packed, text_folder, unpacked

SEED = 42
PIECE, BROADCAST = 200_000, 2_000_000  # blocks of a piece of the plan; blocks of a plan that is broadcast, at most
ROWS, MOST = 16, 20_000_000  # rows of a block, at least; blocks of a table, at most


def units_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of each source in a period: in all the period, each one at least, by largest remainders."""
    spare, total = period - len(weights), sum(weights.values())
    exact = {k: spare * v / total for k, v in weights.items()}
    units = {k: 1 + math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[: period - sum(units.values())]:
        units[k] += 1
    return units


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * scale) for k, x in exact.items()}


def schedule(units: dict[str, int], blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) by slot: earliest deadline first among the released blocks. units: the weights in any whole unit; blocks: how
    many each source has, None for as many as units.

    Shared out evenly, each source has u * v blocks at a time v of its own, or all it has. So block i is due while v goes from i / u to (i + 1) / u, and the slot
    of a v is the sum of what the sources have by then."""
    blocks = units if blocks is None else blocks
    ends = sorted(((blocks[k], units[k]) for k in units), key=lambda e: Fraction(*e))  # a source ends at v = blocks / unit
    done, left = [0], [sum(units.values())]  # after so many ends: blocks of the sources that ended, units of the others
    for n, u in ends:
        done.append(done[-1] + n)
        left.append(left[-1] - u)
    ended = dict.fromkeys(units, 0)

    def slot_of(k: str, i: int) -> tuple[int, int]:
        """The slot of v = i / u, as a fraction. i never falls."""
        u, e = units[k], ended[k]
        if e < len(ends) and ends[e][0] * u < i * ends[e][1]:
            e = ended[k] = bisect_right(ends, 0, e, key=lambda x: x[0] * u - i * x[1] + 1)
        return done[e] * u + left[e] * i, u

    def first(k: str, i: int) -> tuple[int, str, int]:
        x, u = slot_of(k, i)
        return x // u, k, i

    waiting = [first(k, 0) for k in sorted(units) if blocks[k]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            x, u = slot_of(k, i + 1)
            heapq.heappush(ready, (-(-x // u), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        yield k, i, slot, release, deadline
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, first(k, i + 1))


def _plan(spark: SparkSession, number: dict[str, int], slots: Iterator[tuple[str, int, int, int, int]]) -> DataFrame:
    """k (the source's number), i, s, r, d of the schedule."""

    def pieces() -> Iterator[str]:
        while (piece := list(islice(slots, PIECE))) or first:
            yield "".join(f"{number[k]},{i},{s},{r},{d}\n" for k, i, s, r, d in piece)
            first.clear()

    first = [True]  # a folder without a file can't be read
    return spark.read.schema("k int, i int, s long, r long, d long").csv(text_folder(spark, pieces(), "slots"))


def pfair_mix(
    df: DataFrame, keys: list[str], source_col: str = "source", weights: dict[str | None, float] | Callable[[str | None, int], float] | None = None,
    temper: float = 0.7, block_rows: int | None = None, period: int | None = None, max_sources: int = 1_000_000, hot: int = HOT,
) -> DataFrame:
    """df with block, slot, release, deadline, in_block and in_mix; by (slot, in_block) it's in the order of the mix.

    weights: target of each source, in any unit, or a function of its name and number of rows; None takes each source's number of rows to the power `temper`. Sources without a weight
    are left out of the mix (in_mix false, the other new columns null); null is a source, named None. keys: the columns that order a
    source's rows; rows alike in them may change places with each other, and are dealt out by number if they are more than `hot`. block_rows: None takes 16, or more where that
    makes more than MOST blocks. Over max_sources sources is an error: the schedule is made for all of them on the driver. period: None follows the weights exactly, and all rows of the
    sources with a weight are in the mix; a number rounds the weights to whole parts of so many slots, and in_mix is true only as long as each source has full blocks for them.
    Columns of df with the names of the new ones make way. An empty table gives no rows.
    """
    spark = df.sparkSession
    source = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = packed(df, src=source, key=F.xxhash64(F.lit(SEED), F.col(source_col), *(F.col(k) for k in keys)), tie=F.xxhash64(F.lit(SEED + 1), F.col(source_col), *(F.col(k) for k in keys)))
    found = rows.groupBy("src").count().limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    count = {r[0]: r[1] for r in found}
    name = lambda k: None if k == "n" else k[1:]
    if weights is None:
        target = {k: n**temper for k, n in count.items()}
    elif callable(weights):
        target = {k: w for k, n in count.items() if (w := weights(name(k), n)) > 0}
    else:
        target = {k: w for k in count if (w := weights.get(name(k), 0)) > 0}
    block_rows = block_rows or max(ROWS, math.ceil(sum(count.values()) / MOST))
    if period and target:
        target = units_of(target, max(period, 10 * len(target)))
    units = whole(target)
    blocks = {k: -(-count[k] // block_rows) for k in units}
    number = {k: n for n, k in enumerate(sorted(units))}
    plan = _plan(spark, number, schedule(units, blocks))
    plan = F.broadcast(plan) if sum(blocks.values()) <= BROADCAST else plan
    horizon = min((count[k] // block_rows * sum(units.values()) // u for k, u in units.items()), default=0) if period else sum(blocks.values())
    each = spark.read.schema("named string, no int").json(text_folder(spark, ["".join(json.dumps({"named": k, "no": n}) + "\n" for k, n in number.items())], "sources"))

    n_sub = max(256, math.ceil(sum(count.values()) / 500_000))  # a large source is numbered in so many parts
    rows = apart(rows, SEED, hot).withColumn("sub", F.pmod("key", F.lit(n_sub)))
    before = Window.partitionBy("s0").orderBy("b0").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("src").alias("s0"), F.col("sub").alias("b0")).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("src", "sub").orderBy("key", "tie"))
    placed = rows.withColumn("n", place).join(starts, (F.col("src") == F.col("s0")) & (F.col("sub") == F.col("b0")))
    placed = placed.join(F.broadcast(each), F.col("src") == F.col("named"), "left")
    nth = F.col("start") + F.col("n") - 1
    placed = placed.withColumn("at", F.floor(nth / block_rows)).withColumn("in", nth % block_rows)
    placed = placed.join(plan, (F.col("no") == F.col("k")) & (F.col("at").cast("int") == F.col("i")), "left")
    due = F.col("k").isNotNull()
    return unpacked(
        placed,
        block=F.when(due, F.col("at")),
        slot=F.col("s"),
        release=F.col("r"),
        deadline=F.col("d"),
        in_block=F.when(due, F.col("in")),
        in_mix=F.coalesce(F.col("s") < horizon, F.lit(False)),
    )
