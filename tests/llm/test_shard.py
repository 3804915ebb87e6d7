from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.llm.shard import external_shuffle, write_shards




def shuffled(df, n=7, **more):
    return external_shuffle(df, n, [F.col("doc_id"), F.xxhash64("text")], F.coalesce(F.octet_length("text"), F.lit(0)) + 16, **more)


def check_law(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min([sizes.get(k, 0) for k in range(n)]) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_law_and_wholeness(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("text"), F.lit(-1).alias("SHARD"))
    rows = shuffled(df).collect()
    check_law(rows, 7)
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    again = {r.doc_id: (r.shard, r.slot) for r in shuffled(df.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}, "the place doesn't hang on the layout"
    other = {r.doc_id: (r.shard, r.slot) for r in shuffled(df, seed=1).collect()}
    assert sum(other[k] == v for k, v in again.items()) < 60


def test_order_is_shuffled(spark):
    rows = shuffled(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 1, min_buckets=4).orderBy("slot").collect()
    ids = [r.doc_id for r in rows]
    mean = sum(abs(a - b) for a, b in zip(ids, ids[1:])) / (len(ids) - 1)
    assert abs(mean - 4000 / 3) < 150  # of independent uniform numbers


def test_null_ids_repeated_rows_and_few_rows(spark):
    df = spark.createDataFrame([(None, None)] * 3 + [(1, "a")] * 4, "doc_id long, text string")
    rows = shuffled(df, 3).collect()
    check_law(rows, 3)
    assert Counter(r.doc_id for r in rows) == {None: 3, 1: 4}


def test_empty_table(spark):
    out = shuffled(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "shard", "slot"]


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    write_shards(shuffled(df, 4), str(tmp_path / "out"), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.groupBy("shard").count().filter("count = 50").count() == 4


def test_place_hangs_on_seed_and_keys_alone(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"))
    found, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((r.doc_id, r.shard, r.slot) for r in shuffled(df.repartition(int(parts) + 1)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] == found[2]


def test_many_rows_alike_go_to_all_buckets(spark):
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    counts = []
    for layout in (df, df.repartition(5)):
        out = shuffled(layout, 8, hot=1000)
        counts.append(sorted((r.shard, r["count"], r.top, r.alike) for r in out.groupBy("shard").agg(F.count("*").alias("count"), F.max("slot").alias("top"), F.sum(F.when(F.col("doc_id") == 7, F.col("slot"))).alias("alike")).collect()))
    assert counts[0] == counts[1] and all(c == (k, 125_000, 124_999, c[3]) for k, c in enumerate(counts[0]))


def test_extra_columns_may_have_any_name(spark):
    names = ["key", "tie", "row", "bucket", "b", "n", "start", "drawn", "i", "_key", "_b", "Slot", "bytes", "at", "part"]
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), *(F.lit(k).alias(n) for k, n in enumerate(names)))
    out = shuffled(df, 3, hot=5)
    assert out.columns == ["doc_id", "text", *(n for n in names if n != "Slot"), "shard", "slot"]
    assert all([r[n] for n in names if n != "Slot"] == [k for k, n in enumerate(names) if n != "Slot"] for r in out.collect())
