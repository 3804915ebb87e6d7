"""Column and table helpers of the operators; tables that cut the lineage go to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.storage import discard, staged, text_folder

__all__ = ["UPPER", "apart", "ascii_lower", "discard", "field", "packed", "put", "staged", "table", "text_folder", "unpacked"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT = 10_000  # rows alike, beyond which a group is dealt out by number
FEW = 100_000  # hot groups that are broadcast, at most


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does the same to pure ASCII, at a quarter of the time."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns; an input column of the same name, in any case, makes way."""
    names = {c.lower() for c in columns}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names), *(v.alias(k) for k, v in columns.items()))


def packed(df: DataFrame, leave_out: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The rows of df as one struct `row`, without the columns left out, beside these working columns, which so can't clash with any of df."""
    gone = {c.lower() for c in leave_out}
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone), F.lit(True).alias(_KEEP)).alias("row"), *(v.alias(k) for k, v in columns.items()))


_KEEP = "\x00row"  # a struct needs a field


def field(name: str) -> Column:
    """A column of df in a packed frame."""
    return F.col("row").getField(name)


def unpacked(rows: DataFrame, **columns: Column) -> DataFrame:
    """The columns of df again, and these new ones of the working columns; columns of df with their names, in any case, make way."""
    names = {c.lower() for c in columns} | {_KEEP}
    return rows.select(*(field(c).alias(c) for c in rows.schema["row"].dataType.names if c.lower() not in names), *(v.alias(k) for k, v in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(rows: DataFrame, seed: int, hot: int = HOT) -> DataFrame:
    """rows with new values of the hashes `key` and `tie` where more than `hot` rows are alike in both: hashes of the old ones and a row's number
    in its group. So no group is dealt to one task, and the values hang on the rows alone, not on how they are laid out; only which of the rows that are alike has which number does.
    """
    alike = rows.groupBy(F.col("key").alias("hot_key"), F.col("tie").alias("hot_tie")).count().filter(F.col("count") > hot)
    alike = staged(alike, "alike")
    n = alike.count()
    if not n:
        return rows
    names = rows.columns
    same = (F.col("key") == F.col("hot_key")) & (F.col("tie") == F.col("hot_tie"))
    side = F.broadcast(alike) if n <= FEW else alike
    cold = rows.join(side, same, "left_anti")
    warm = rows.join(side, same).withColumn("at", F.monotonically_increasing_id())
    warm = staged(warm.withColumn("part", F.pmod(F.xxhash64("at"), F.ceil(F.col("count") / hot))), "alike-rows")
    before = Window.partitionBy("k0", "t0").orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)
    starts = warm.groupBy(F.col("key").alias("k0"), F.col("tie").alias("t0"), F.col("part").alias("p0")).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = staged(starts.drop("n"), "alike-starts")
    place = F.row_number().over(Window.partitionBy("key", "tie", "part").orderBy("at"))
    warm = warm.withColumn("place", place).join(starts, (F.col("key") == F.col("k0")) & (F.col("tie") == F.col("t0")) & (F.col("part") == F.col("p0")))
    number = F.col("start") + F.col("place")
    fresh = {"key": F.xxhash64(F.lit(seed), "key", "tie", number), "tie": F.xxhash64(F.lit(seed + 1), "key", "tie", number)}
    return cold.unionByName(warm.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in names)))
