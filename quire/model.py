"""The node table: one row a node of a document's tree, in document order by path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("semantic_type", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StringType())),
        T.StructField("page", T.IntegerType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("font_family", T.StringType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("is_mono", T.BooleanType()),
        T.StructField("ext_conf", T.DoubleType()),
        T.StructField("cls_conf", T.DoubleType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("is_tombstoned", T.BooleanType()),
        T.StructField("tombstone_reason", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("applied", T.ArrayType(T.StringType())),
    ]
)

CONTAINER, PARAGRAPH = "container", "paragraph"
PARAGRAPH_LIKE = ("paragraph", "title_page")
FIGURE_LIKE = ("figure", "diagram")
READING_LEAVES = (*PARAGRAPH_LIKE, *FIGURE_LIKE, "code", "formula", "table")
ATOMIC = ("code", "formula", "table", "figure", "diagram", "list", "callout", "footnote", "bib_entry", "toc_entry", "title_page")


def nodes(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A node table from partial rows; text gives one span."""
    full = []
    for r in rows:
        r = dict(r)
        if "text" in r:
            r["spans"] = [r.pop("text")]
        base = {"doc_id": "d", "kind": PARAGRAPH, "ext_conf": 1.0, "cls_conf": 1.0, "conf": 1.0, "is_tombstoned": False, "is_mono": False, "attrs": {}, "applied": []}
        full.append(tuple({**{f.name: None for f in NODE}, **base, **r}[f.name] for f in NODE))
    return spark.createDataFrame(full, NODE)


def text_spaced() -> Column:
    """The spans with spaces between."""
    return F.array_join(F.coalesce("spans", F.array().cast("array<string>")), " ")


def text_joined() -> Column:
    return F.array_join(F.coalesce("spans", F.array().cast("array<string>")), "")


def text_first() -> Column:
    """The first span that isn't empty."""
    return F.coalesce(F.get(F.filter("spans", lambda s: s != ""), F.lit(0)), F.lit(""))


def made_id(operator: str, *parts: Column) -> Column:
    """The id of a node that an operator makes: it hangs on its members alone."""
    return F.sha2(F.concat_ws("/", F.lit(operator), *parts), 256)


def attrs_with(**values: Column) -> Column:
    """attrs with these keys, the new ones winning; null values leave no key."""
    added = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items())), lambda e: e["value"].isNotNull()))
    kept = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*values))
    return F.map_concat(kept, added)


def is_kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def ordinal() -> Column:
    """The place among siblings."""
    return F.element_at("path", -1)


def before(path: Column) -> Column:
    """A path just before this one: the node itself moves to after()."""
    return F.concat(path, F.array(F.lit(0)))


def after(path: Column) -> Column:
    return F.concat(path, F.array(F.lit(1)))


def live(table: DataFrame) -> DataFrame:
    """Nodes that are not tombstoned and not below a container that is."""
    dead = table.filter((F.col("kind") == CONTAINER) & F.col("is_tombstoned")).select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"))
    under = table.alias("n").join(dead, (F.col("doc_id") == F.col("_d")) & (F.slice("path", F.lit(1), F.size("_p")) == F.col("_p")), "left_anti")
    return under.filter(~F.col("is_tombstoned"))


def with_new(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """nodes and the new ones; what these lack is null, or as a fresh node has it."""
    fresh = {"is_tombstoned": F.lit(False), "applied": F.array().cast("array<string>"), "is_mono": F.lit(False)}
    full = made.select(*((F.col(f.name) if f.name in made.columns else fresh.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in NODE))
    return nodes.unionByName(full)
