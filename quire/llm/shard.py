"""Shards by an external shuffle in two passes (operator 5).

Pass 1 scatters the records by a seeded hash into buckets that fit in memory; their counts, summed up in bucket order, say where each bucket begins in
the shuffled order. Pass 2 shuffles each bucket: Spark's shuffle() draws a Fisher-Yates permutation of 0 .. n-1 for
it, and the record at place i of the bucket, by hash, goes to the i-th number drawn. The permutations are written to the shared folder,
so that a task that runs again draws nothing anew. The records shuffle once, and sort on disk if they must.

The generator of a permutation is seeded by the number of its partition, so the permutations are dealt by bucket to a number of partitions that follows from the number
of buckets alone: the place of a record hangs on the seed and the keys of all records, not on the cluster or its settings.

Place g of the shuffled order is slot g div n of shard g mod n: the numbers of rows differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import HOT, apart, packed, staged, unpacked

LAW = "rows"
DRAWN_TOGETHER = 16  # buckets to a partition of permutations


def external_shuffle(df: DataFrame, n_shards: int, keys: list[Column], size: Column, seed: int = 42, bucket_bytes: int = 64 << 20, min_buckets: int = 1024, hot: int = HOT) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    keys: what the place of a record hangs on; nulls are values like any other. Records that are alike in all keys may change places with each other; if they are more
    than `hot`, they are numbered and scattered one by one. size: its bytes. There is a bucket for every bucket_bytes of the table, min_buckets at least. Columns of df named
    shard or slot make way for the new ones. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = packed(df, key=F.xxhash64(F.lit(seed), *keys), tie=F.xxhash64(F.lit(seed + 1), *keys), bytes=size)
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n_buckets = max(min_buckets, math.ceil(total / bucket_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (128 << 20)))
    rows = apart(rows.drop("bytes"), seed, hot).withColumn("bucket", F.pmod("key", F.lit(n_buckets)))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    drawn = buckets.repartition(math.ceil(n_buckets / DRAWN_TOGETHER), "b").sortWithinPartitions("b").select("b", "start", F.shuffle(numbers, F.lit(seed)).alias("drawn"))
    drawn = staged(drawn, "permutations").hint("merge")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "tie"))
    placed = rows.repartition(parts, "bucket").withColumn("i", place).join(drawn, F.col("bucket") == F.col("b"))
    at = F.col("start") + F.element_at("drawn", F.col("i"))
    return unpacked(placed, shard=(at % n_shards).cast("int"), slot=F.floor(at / n_shards).cast("long"))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """The shards as folders shard=0, shard=1, ... of Parquet files; files, and rows in a file, follow the slots."""
    spark = placed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


SPAN = 1 << 16  # numbers that a window ranks at once


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """rows (src, and unique numbers) with j, the rank of the number in its source from 0, counted in spans, so that a large source is many tasks'."""
    rows = rows.withColumn("span", F.floor(F.col(by) / SPAN))
    before = Window.partitionBy("s0").orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("src").alias("s0"), F.col("span").alias("p0")).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("src", "span").orderBy(by)) - 1
    return rows.withColumn("place", place).join(starts, (F.col("src") == F.col("s0")) & (F.col("span") == F.col("p0"))).select("src", by, (F.col("start") + F.col("place")).alias("j"))


def shuffle_in_order(df: DataFrame, n_shards: int, position: Column, stratum: Column, keys: list[Column], size: Column, **options) -> DataFrame:
    """df with shard and slot, where the strata (sources) keep their places in an order, and records are shuffled within them.

    position: the place of each record, gapless and unique from 0. Place p is slot p div n_shards of shard p mod n_shards, so as many places in a row as there are shards give one to each. Of a stratum, the record that external_shuffle() draws j-th gets its j-th place. Nulls are a
    stratum. Only numbers are shuffled and ranked; the records themselves move once. Columns of df named shard or slot make way.
    """
    src = F.coalesce(F.concat(F.lit("s"), stratum.cast("string")), F.lit("n"))
    rows = packed(df, pos=position)
    narrow = df.select(position.alias("pos"), src.alias("src"), size.alias("bytes"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    drawn = external_shuffle(narrow, n_shards, [F.col(f"k{i}") for i in range(len(keys))], F.col("bytes"), **options)
    drawn = staged(drawn.select("src", "pos", (F.col("slot") * n_shards + F.col("shard")).alias("g")), "drawn")
    places = _ranked(drawn.select("src", "pos"), "pos").select(F.col("src").alias("ps"), F.col("j").alias("pj"), F.col("pos").alias("at"))
    takes = _ranked(drawn.select("src", "g"), "g").select(F.col("src").alias("ts"), F.col("g").alias("tg"), "j").join(places, (F.col("ts") == F.col("ps")) & (F.col("j") == F.col("pj"))).select("tg", "at")
    taken = drawn.select(F.col("pos").alias("record"), "g").join(takes, F.col("g") == F.col("tg")).select("record", "at")
    placed = rows.join(staged(taken, "places"), F.col("pos") == F.col("record"))
    return unpacked(placed, shard=(F.col("at") % n_shards).cast("int"), slot=F.floor(F.col("at") / n_shards).cast("long"))


def in_file_order(df: DataFrame) -> tuple[DataFrame, str]:
    """A table read from files with a column of each row's place, from 0, in the order of part numbers and rows in them; and the name of that column, which is none of df's."""
    name = next(n for n in ("place", *(f"place {i}" for i in range(len(df.columns) + 1))) if n.lower() not in {c.lower() for c in df.columns})
    meta = df.metadataColumn("_metadata")
    rows = df.withColumns({f"{name} file": meta["file_path"], f"{name} row": meta["row_index"]})
    part = F.regexp_extract(f"{name} file", r"part-(\d+)", 1).try_cast("long")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = rows.groupBy(F.col(f"{name} file").alias("file"), part.alias("part")).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    files = staged(files.select(F.col("file").alias(f"{name} of"), F.col("start").alias(f"{name} start")), "file-starts")
    placed = rows.join(F.broadcast(files), F.col(f"{name} file") == F.col(f"{name} of"))
    return placed.withColumn(name, F.col(f"{name} start") + F.col(f"{name} row")).drop(f"{name} file", f"{name} row", f"{name} of", f"{name} start"), name
