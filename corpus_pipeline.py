"""From raw documents to shards: quality, near duplicates, decontamination, mix, shards.

STAGES holds (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads
again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, mixing, quality, shard, simhash
from quire.llm.queries import SHARDS
from quire.llm.shared import staged, table


USED = ("doc_id", "text", "source")


def masked(docs: DataFrame) -> DataFrame:
    """docs with numbers for the names of all columns that no stage reads, so that none makes way for a column of an operator."""
    return docs.toDF(*(c if c in USED else f"column {i}" for i, c in enumerate(docs.columns)))


def unmasked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from rows that an operator made of masked(docs)."""
    return rows.select(*(F.col(f"`{m}`").alias(c) for c, m in zip(docs.columns, masked(docs).columns)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as quality 1; it learns from the labels of those not held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return unmasked(quality.scored(masked(docs), model).filter("predicted = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word similarity of 0.8 or more, found by SimHash and then verified, the document with the smallest id."""
    return unmasked(simhash.near_copies(masked(docs)).filter("kept"), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half or more."""
    return unmasked(decontam.decontaminate(masked(docs), table(spark, sf_dir, "benchmark")).filter("NOT contaminated"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mix, by blocks of a row for each shard: the weights are the sources' sizes to the power 0.7, among the sources that still have documents."""
    return unmasked(mixing.pfair_mix(masked(docs), ["doc_id"], block_rows=SHARDS).orderBy("slot", "in_block"), docs)


def shuffle_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot; columns of these names make way. Each shard has the sources in the order of the mix, which is that of the files of docs, and documents in a seeded random order within their source."""
    placed, place = shard.in_file_order(masked(docs))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    source = F.col("source") if "source" in placed.columns else F.lit(None)
    made = shard.shuffle_in_order(placed, SHARDS, F.col(f"`{place}`"), source, [F.col("doc_id"), F.xxhash64("text")], size).drop(place)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return made.select(*(F.col(f"`{m}`").alias(c) for c, m in zip(docs.columns, masked(docs).columns) if c in kept), "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("shard", shuffle_to_shards),
]

#: A fitted ensemble, SimHash components, string tiling and seeded hashes are beyond SQL; tests/llm holds each stage against brute force on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
