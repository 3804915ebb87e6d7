"""What queries share: tables, a document's lines, and node tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.model import CONTAINER, NODE, PARAGRAPH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores, as those of one small file do, are dealt out to all of them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n, line."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))


LINES = "lines AS (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents)"


def filled(rows: DataFrame) -> DataFrame:
    """rows with the columns of a node table; what they lack is as in a fresh node."""
    fresh = {"ext_conf": F.lit(1.0), "cls_conf": F.lit(1.0), "conf": F.lit(1.0), "is_tombstoned": F.lit(False), "is_mono": F.lit(False), "kind": F.lit(PARAGRAPH), "applied": F.array().cast("array<string>"), "attrs": F.create_map().cast("map<string,string>")}
    return rows.select(*((F.col(f.name) if f.name in rows.columns else fresh.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in NODE))


def line_nodes(spark: SparkSession, sf_dir: str, text: Column | None = None, **columns: Column) -> DataFrame:
    """A container a document and a paragraph a line. text and columns: expressions over doc_id, n, line."""
    rows = lines(spark, sf_dir)
    body = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws("/", F.col("doc_id").cast("string"), "n").alias("node_id"), F.concat(F.col("doc_id").cast("string"), F.lit("/root")).alias("parent_id"),
        F.array(F.lit(0), "n").alias("path"), F.array(F.col("line") if text is None else text).alias("spans"), *(v.alias(k) for k, v in columns.items()),
    )
    roots = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit("/root")).alias("node_id"), F.array(F.lit(0)).alias("path"), F.lit(CONTAINER).alias("kind"), F.lit(1).alias("level"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    return filled(body).unionByName(filled(roots))


def number(node_id: str = "node_id") -> Column:
    """The line number in a node's id."""
    return F.substring_index(node_id, "/", -1).try_cast("int")
