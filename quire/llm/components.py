"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import discard, staged


def _star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: u, v. Each u hands its smallest neighbour, or itself, on to the neighbours above that. The second table is staged and can go once the first is written."""
    low = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
    low = staged(low, "lowest")  # read anew, so that the join has shuffles of its own, of which a hub's can be split
    return links.join(low, F.col("u") == F.col("lu")), low


def roots(links: DataFrame) -> DataFrame:
    """u, root for each node u that isn't the smallest of its component; links: pairs a, b of longs, in any order, repeats and loops allowed.

    Each step is written to the shared folder, so lost executors cost one step at most; the tables of the step before go. Steps grow with the logarithm of the longest chain.
    """
    state = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, last = staged(state, "links"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return state.select("u", F.col("v").alias("root"))
        last = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        found, low = _star(both)
        large = staged(found.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        discard(low, state)
        small, low = _star(large)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        state = staged(small.distinct(), "small-star")
        discard(low, large)
