"""The order of the mix reaches the shards."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quire.llm import shard
from quire.llm.queries import SHARDS

COUNTS = {"large": 3000, "middle": 2200, "small": 1500, None: 900}


def documents(spark, folder):
    rng = random.Random(4)
    rows = [(s, c) for c, n in COUNTS.items() for s in range(n)]
    rng.shuffle(rows)
    made = [(k, f"text {k}", "en", c, 6, "odd") for k, (_, c) in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, SLOT string").repartition(7).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def worst(rows):
    """The largest difference, over prefixes of shards, of a source's rows from its target, until the first source runs out."""
    weights = {c: n**0.7 for c, n in COUNTS.items()}
    total = sum(weights.values())
    until = min(COUNTS[c] * total / w for c, w in weights.items()) / SHARDS
    most = 0.0
    for k in range(SHARDS):
        seen = Counter()
        for n, r in enumerate(sorted((r for r in rows if r.shard == k), key=lambda r: r.slot), 1):
            assert r.slot == n - 1
            seen[r.source] += 1
            if n <= until:
                most = max([most, *(abs(seen[c] - n * w / total) for c, w in weights.items())])
    return most


def run(spark, folder, stages):
    docs = documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        if name in stages:
            docs = corpus_pipeline.staged(stage(spark, docs, str(folder)), name)
    return docs


def test_each_shard_follows_the_weights(spark, tmp_path):
    out = run(spark, tmp_path, ("mix", "shard"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(sum(COUNTS.values())))
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == SHARDS and max(sizes.values()) - min(sizes.values()) <= 1
    assert worst(rows) < 3


def test_shards_without_the_mix_do_not(spark, tmp_path):
    rows = run(spark, tmp_path, ("shard",)).collect()
    assert len({r.doc_id for r in rows}) == sum(COUNTS.values()) and worst(rows) > 6


def test_records_are_shuffled_within_their_source(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).cast("string").alias("source"))
    out = shard.shuffle_in_order(df, 8, F.col("id"), F.col("source"), [F.col("id")], F.lit(10)).collect()
    at = {r.id: r.slot * 8 + r.shard for r in out}
    assert sorted(at.values()) == list(range(4000))
    assert all(i % 3 == p % 3 for i, p in at.items())
    assert sum(abs(i - p) for i, p in at.items()) / 4000 > 800


@pytest.mark.parametrize("rows", [0, 1, 41])
def test_few_rows(spark, tmp_path, rows):
    spark.range(rows).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source")).write.parquet(f"{tmp_path}/d")
    out = corpus_pipeline.shuffle_to_shards(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(rows)) and all(r.slot == (r.slot * 40 + r.shard) // 40 for r in out)
