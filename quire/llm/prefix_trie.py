"""The trie of conversations' prefixes, by smallest-member ownership (operator 12).

Each distinct sequence of first turns is a node, and its owner is the smallest conversation that starts with it. An owner of a node owns the nodes below it on its own path too, so every conversation owns a suffix of its path,
and (owner, depth) names a node. A prefix is known by sums of hashes of its turns and their places, which add up in parts, so a long conversation is no single task's. One group-by of the prefixes finds the owners; windows over each path mark what is owned and sum up, from each
place to the end, the words of all turns, those of owned nodes, and the flag of an owned leaf. One group-by of the nodes then adds up its members' sums: words said less words owned is what sharing saves
below it, and flags are leaves. The whole needs no walk up the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import staged

WORDS = r"[^\x20\x09-\x0D]+"
PART = 4096  # turns of a conversation that a window takes at once
ENDS = 4096  # ids of a node's ends that are joined at once
_HALF = 0xFFFFFFFF


def _numbered(rows: DataFrame, by: list[Column], label: str) -> DataFrame:
    """rows with `n`, their place from 0 in their conversation, by these columns. A conversation is ranked in ranges of rows, so that none is one task's."""
    order = [F.col("conv").asc(), *by]
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*by)) - 1
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("conv").alias("c"), F.col("part").alias("p")).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return dealt.withColumn("n", place).join(starts, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))).withColumn("n", F.col("n") + F.col("start")).drop("part", "c", "p", "start")


def _running(rows: DataFrame, sums: list[str], order: str, backwards: bool = False) -> DataFrame:
    """rows with each of these columns replaced by its sum over the conversation up to the row, or from the row on, in parts of PART rows."""
    part = F.floor(F.col(order) / PART)
    within = Window.partitionBy("conv", "_part").orderBy(F.col(order).desc() if backwards else F.col(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_part", part)
    before = Window.partitionBy("c").orderBy(F.col("p").desc() if backwards else F.col("p")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("conv").alias("c"), F.col("_part").alias("p")).agg(*(F.sum(s).alias(f"t_{s}") for s in sums))
    totals = totals.select("c", "p", *(F.coalesce(F.sum(f"t_{s}").over(before), F.lit(0)).alias(f"b_{s}") for s in sums))
    summed = rows.withColumns({s: F.sum(s).over(within) for s in sums})
    joined = summed.join(totals, (F.col("conv") == F.col("c")) & (F.col("_part") == F.col("p")))
    return joined.withColumns({s: F.col(s) + F.col(f"b_{s}") for s in sums}).drop("_part", "c", "p", *(f"b_{s}" for s in sums))


def rebuilt(conversations: DataFrame, every: int = 20, shared: int = 4, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of conversation c - c % every: its first h turns, h = crc32(c) % shared, then c's own after its first h.

    Returns the ids (conv) and the turns (conv, n from 0, role, text). Turns go by `turn`, null first, ties by role and text; null roles and texts are empty. Rows without a conversation are left out.
    """
    said = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = staged(_numbered(said, [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "turns").drop("turn"), "own-turns")
    ids = staged(own.select("conv").distinct(), "conversations")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    first = own.filter(F.col("n") < shared - 1).select(F.col("conv").alias("base"), "n", "role", "text")
    taken = ids.withColumn("h", h).filter("h > 0").withColumn("b", F.col("conv") - F.col("conv") % every)
    lent = taken.join(first, F.col("b") == F.col("base")).filter("n < h").select("conv", "n", "role", "text")
    kept = own.filter(F.col("n") >= h).select("conv", "n", "role", "text")
    turns = kept.unionByName(lent)
    # a conversation whose base has fewer than h turns has a gap: its places close up
    n_lent = lent.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n_lent"))
    gap = ids.withColumn("h", h).join(n_lent, F.col("conv") == F.col("c"), "left").select(F.col("conv").alias("g"), (F.col("h") - F.coalesce("n_lent", F.lit(0))).alias("gap"), "h").filter("gap > 0")
    turns = turns.join(gap, F.col("conv") == F.col("g"), "left").withColumn("n", F.when(F.col("n") >= F.col("h"), F.col("n") - F.col("gap")).otherwise(F.col("n")))
    return ids, turns.select("conv", "n", "role", "text")


def _ends_hash(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 from a row for each conversation that ends at a node; ids are joined in runs of ENDS neighbours, and a node of many runs is hashed run by run."""
    order = [F.col("owner"), F.col("depth"), F.col("conv")]
    dealt = staged(ends.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ends")
    place = F.row_number().over(Window.partitionBy("owner", "depth", "part").orderBy("conv")) - 1
    runs = dealt.withColumn("run", F.floor(place / ENDS)).groupBy("owner", "depth", "part", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    runs = staged(runs, "runs-of-ends")
    many = runs.groupBy(F.col("owner").alias("o"), F.col("depth").alias("d")).agg(F.count("*").alias("k"))
    told = runs.join(many, (F.col("owner") == F.col("o")) & (F.col("depth") == F.col("d")))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        out = ([], [], [])

        def close() -> None:
            for column, value in zip(out, (*key, state.hexdigest())):
                column.append(value)

        for batch in batches:
            for owner, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (owner, depth) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        close()
                    key, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
        if key is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["owner", "depth", "ends_sha256"])

    alone = told.filter("k = 1").select("owner", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    large = told.filter("k > 1").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part", "run").select("owner", "depth", "ids")
    return alone.unionByName(large.mapInArrow(streamed, "owner long, depth long, ends_sha256 string"))


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its owner), depth, parent_conv_id (the parent's owner; null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ids: conv, a row for each conversation, those without turns too. turns: conv, n (place from 0), role, text, without nulls. n_leaves and saved_tokens are over the node and all below: childless nodes, and
    each node's (n_convs - 1) times the words of its last text. ends_sha256: the conversations that are no longer than the node, as decimals in ascending order joined by commas. No conversation gives no node.
    """
    spread = lambda seed: F.xxhash64(F.lit(seed), "n", "role", "text")
    steps = turns.select("conv", (F.col("n") + 1).cast("long").alias("depth"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), spread(1).alias("x"), spread(2).alias("y"))
    halves = {"h0": F.col("x").bitwiseAND(_HALF), "h1": F.shiftrightunsigned("x", 32), "h2": F.col("y").bitwiseAND(_HALF), "h3": F.shiftrightunsigned("y", 32)}  # sums of halves can't overflow
    steps = steps.withColumns(halves).drop("x", "y")
    top = ids.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *(F.lit(0).cast("long").alias(h) for h in halves))
    paths = staged(_running(steps, list(halves), "depth").unionByName(top), "paths")
    lengths = paths.groupBy(F.col("conv").alias("c")).agg(F.max("depth").alias("length"))
    paths = staged(paths.join(lengths, F.col("conv") == F.col("c")).drop("c"), "paths")
    key = ["depth", *halves]
    owners = paths.groupBy(*(F.col(k).alias(f"o_{k}") for k in key)).agg(F.min("conv").alias("owner"), F.max("length").alias("longest"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"o_{k}"))
    owned = staged(paths.join(staged(owners, "owners"), same).select("conv", "depth", "words", "length", "owner", "longest"), "owned")
    path = Window.partitionBy("conv", "_part").orderBy("depth")
    # each row needs its neighbours on the path: those of a part, and the edges of the parts beside it
    near = owned.withColumn("_part", F.floor(F.col("depth") / PART))
    edges = owned.filter(f"depth % {PART} = 0 or depth % {PART} = {PART - 1}").select(F.col("conv").alias("ec"), F.col("depth").alias("ed"), F.col("owner").alias("eo"))
    near = near.withColumns({"above": F.lag("owner").over(path), "below": F.lead("owner").over(path)}).drop("_part")
    edge = lambda name, step: edges.select(F.col("ec").alias(f"{name}c"), (F.col("ed") + step).alias(f"{name}d"), F.col("eo").alias(name))
    near = near.join(edge("up", 1), (F.col("conv") == F.col("upc")) & (F.col("depth") == F.col("upd")), "left").join(edge("down", -1), (F.col("conv") == F.col("downc")) & (F.col("depth") == F.col("downd")), "left")
    near = near.withColumn("above", F.coalesce("above", "up")).withColumn("below", F.coalesce("below", "down"))
    mine = F.col("owner") == F.col("conv")
    leaf = mine & (F.col("depth") == F.col("length")) & (F.col("longest") == F.col("length"))
    flagged = near.select("conv", "depth", "owner", "length", "above", F.coalesce((F.col("below") == F.col("conv")).cast("long"), F.lit(0)).alias("child"), (F.col("words") - F.when(mine, F.col("words")).otherwise(0)).alias("saved"), leaf.cast("long").alias("leaves"))
    summed = staged(_running(flagged, ["saved", "leaves"], "depth", backwards=True), "sums")
    made = summed.groupBy("owner", "depth").agg(F.min("above").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _ends_hash(summed.filter("depth = length").select("owner", "depth", "conv")).select(F.col("owner").alias("eo"), F.col("depth").alias("ed"), "ends_sha256")
    nodes = made.join(ends, (F.col("owner") == F.col("eo")) & (F.col("depth") == F.col("ed")), "left")
    return nodes.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
