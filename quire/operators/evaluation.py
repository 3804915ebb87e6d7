"""Quality figures over tables: links, retrieval, calibration, samples, errors, jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.metrics import LINK_BAR, TEDS_BAR, WER_BAR, ndcg_at, recall_at, reciprocal_rank, teds, teds_of_json, wer
from quire.operators import vector_index

#: Severities that block a release.
BLOCKING = ("critical", "blocker")


def link_f1(expected: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """by, precision, recall, f1 over distinct (source_id, target_id, relation). Nothing found: all 0; nothing expected: recall 1, the others 0. A `by` without any link has no row."""
    edge = [by, "source_id", "target_id", "relation"]
    both = expected.select(*edge).distinct().withColumn("e", F.lit(1)).unionByName(found.select(*edge).distinct().withColumn("e", F.lit(2)))
    sides = both.groupBy(*edge).agg(F.sum("e").alias("side"))
    n = sides.groupBy(by).agg(F.count_if(F.col("side") == 3).cast("double").alias("hit"), F.count_if(F.col("side").isin(1, 3)).alias("want"), F.count_if(F.col("side").isin(2, 3)).alias("got"))
    p, r = F.when(F.col("got") > 0, F.col("hit") / F.col("got")).otherwise(0.0), F.when(F.col("want") > 0, F.col("hit") / F.col("want")).otherwise(1.0)
    n = n.withColumn("precision", p).withColumn("recall", r)
    return n.select(by, "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, mrr, ndcg. ranked: query_id, item_id, rank; relevant: query_id, item_id."""
    got = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("got"))
    want = relevant.groupBy("query_id").agg(F.collect_list("item_id").alias("want"))
    both = got.join(want, "query_id", "left").withColumn("want", F.coalesce("want", F.slice("got", 1, 0)))
    return both.select("query_id", recall_at(F.col("got"), F.col("want"), k).alias("recall"), reciprocal_rank(F.col("got"), F.col("want")).alias("mrr"), ndcg_at(F.col("got"), F.col("want"), k).alias("ndcg"))


def retrieval_by_counts(ranked: DataFrame, relevant: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, mrr, ndcg as retrieval_metrics() has them, without gathering what is relevant. ranked: query_id, item_id, rank, each item once a query; relevant: those of (query_id, item_id) that may be ranked; wanted: query_id, want, how many are relevant in all."""
    good = relevant.select("query_id", "item_id").distinct().withColumn("_good", F.lit(True))
    hits = ranked.join(good, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.count_if(F.col("_good") & (F.col("rank") <= k)).alias("hits"),
        F.coalesce(1.0 / F.min(F.when(F.col("_good"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("_good") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("gain"),
    )
    both = hits.join(wanted.select("query_id", "want"), "query_id", "left").withColumn("want", F.coalesce("want", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("want", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return both.select("query_id", F.when(F.col("want") == 0, 0.0).otherwise(F.col("hits") / F.col("want")).alias("recall"), "mrr", F.when(F.col("want") == 0, 0.0).otherwise(F.col("gain") / ideal).alias("ndcg"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_conf, accuracy of every bin, empty ones 0. p = 1 is in the last bin; p beyond 0 and 1 counts as these."""
    df = df.withColumn(p, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p))))
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    seen = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_conf"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").fillna(0).fillna(0.0)


def ece(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: ece, the mean gap of confidence and accuracy over the bins, by their sizes."""
    b = calibration_bins(df, p, y, bins)
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf"))) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("ece"))


def evaluate_samples(samples: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """sample_id, wer, teds, f1, passed. samples: sample_id, reference, hypothesis, expected_grid, found_grid (nested arrays, or texts of JSON of any shape; what is no JSON has teds 0); what isn't expected is perfect. links: sample_id, f1."""
    rows = samples.withColumn("wer", F.when(F.col("reference").isNull(), 0.0).otherwise(wer(F.col("reference"), F.coalesce("hypothesis", F.lit("")))))
    found = teds_of_json(F.col("expected_grid"), F.coalesce("found_grid", F.lit("[]"))) if dict(samples.dtypes)["expected_grid"] == "string" else teds(F.col("expected_grid"), F.coalesce("found_grid", F.array().cast("array<array<string>>")))
    rows = rows.withColumn("teds", F.when(F.col("expected_grid").isNull(), 1.0).otherwise(F.coalesce(found, F.lit(0.0))))
    rows = rows.join(links.select("sample_id", "f1"), "sample_id", "left") if links is not None else rows.withColumn("f1", F.lit(None).cast("double"))
    rows = rows.withColumn("f1", F.coalesce("f1", F.lit(1.0)))
    return rows.select("sample_id", "wer", "teds", "f1", ((F.col("teds") >= TEDS_BAR) & (F.col("f1") >= LINK_BAR) & (F.col("wer") <= WER_BAR)).alias("passed"))


def assert_passed(evaluated: DataFrame, shown: int = 20) -> None:
    failed = evaluated.filter(~F.col("passed"))
    if names := [r.sample_id for r in failed.orderBy("sample_id").limit(shown).collect()]:
        raise AssertionError(f"samples failed: {', '.join(map(str, names))}")


def taxonomy_report(errors: DataFrame, by: list[str]) -> DataFrame:
    """by, total, blocking, counts (map): errors by category. errors: category, severity."""
    each = errors.groupBy(*by, "category").agg(F.count("*").alias("n"), F.count_if(F.lower("severity").isin(*BLOCKING)).alias("b"))
    return each.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("b").alias("blocking"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").count()


def live_node_counts(nodes: DataFrame) -> DataFrame:
    """doc_id, n: live containers and blocks, not what lists and tables hold."""
    return nodes.groupBy("doc_id").agg(F.count_if(~F.col("is_tombstoned") & (F.col("kind") != "list_item")).alias("n"))


def _above(rows: DataFrame, depth: str) -> DataFrame:
    """A row for each node and prefix of its path, shorter than the path and of `depth` elements at least, as _prefix."""
    ends = F.sequence(F.col(depth), F.size("path") - 1)
    return rows.filter(F.size("path") > F.col(depth)).select("*", F.explode(F.transform(ends, lambda k: F.slice("path", F.lit(1), k))).alias("_prefix"))


def page_ranges(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, first_page, last_page of each live container, at any depth; what is below a tombstoned node counts for nothing.

    The last page is the greatest of its own and all below. The first is its own; without one, the least of its children's first pages, so a page below a node that has one itself is not looked at. Each node goes to the containers above it by the
    prefixes of its path, so the work is nodes times depth, and pages are added up before they're shuffled.
    """
    placed = nodes.select("doc_id", "node_id", "path", "page", (F.col("kind") == "container").alias("box"), F.coalesce("is_tombstoned", F.lit(False)).alias("dead"))
    blocked = placed.filter(F.col("dead") | F.col("page").isNotNull()).select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), "dead", F.col("page").isNotNull().alias("paged"))
    each = _above(placed.filter(~F.col("dead")).withColumn("_one", F.lit(1)).drop("dead"), "_one").join(blocked, (F.col("doc_id") == F.col("_d")) & (F.col("_prefix") == F.col("_p")), "left")
    state = each.groupBy("doc_id", "node_id", "path").agg(F.coalesce(F.bool_or("dead"), F.lit(False)).alias("_gone"), F.coalesce(F.max(F.when(F.col("paged"), F.size("_prefix"))), F.lit(0)).alias("_shade"))
    alive = placed.filter(~F.col("dead")).join(state.select(F.col("doc_id").alias("_sd"), F.col("node_id").alias("_sn"), "_gone", "_shade"), (F.col("doc_id") == F.col("_sd")) & (F.col("node_id") == F.col("_sn")), "left").filter(~F.coalesce("_gone", F.lit(False)))
    leaves = _above(alive.filter("page IS NOT NULL").withColumn("_one", F.lit(1)), "_one")
    # a container sees a first page only if no node between has one; the longest paged prefix is the node that casts the shade
    pages = leaves.groupBy(F.col("doc_id").alias("_ld"), F.col("_prefix").alias("_lp")).agg(F.min(F.when(F.size("_prefix") >= F.coalesce("_shade", F.lit(0)), F.col("page"))).alias("_min"), F.max("page").alias("_max"))
    boxes = alive.filter("box")
    both = boxes.join(pages, (F.col("doc_id") == F.col("_ld")) & (F.col("path") == F.col("_lp")), "left")
    return both.select("doc_id", "node_id", F.coalesce("page", "_min").alias("first_page"), F.greatest("page", "_max").alias("last_page"))


def up_seconds(events: DataFrame, state: str = "up") -> DataFrame:
    """runner_id, seconds spent in a state. events: runner_id, ts, state."""
    order = Window.partitionBy("runner_id").orderBy("ts")
    rows = events.withColumn("_next", F.lead("ts").over(order)).filter((F.col("state") == state) & F.col("_next").isNotNull())
    return rows.groupBy("runner_id").agg(F.sum(F.unix_timestamp("_next") - F.unix_timestamp("ts")).alias("seconds"))


def telemetry(requests: DataFrame, key: str) -> DataFrame:
    """key, total, errors, mean_seconds, tasks (JSON of counts by task), high_water: the requests of each manager. requests: key, task, seconds, ok, depth (of the queue)."""
    by_task = requests.groupBy(key, "task").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.sum("seconds").alias("s"), F.max("depth").alias("d"))
    tasks = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "n")))))
    return by_task.groupBy(key).agg(F.sum("n").alias("total"), F.sum("bad").alias("errors"), (F.sum("s") / F.sum("n")).alias("mean_seconds"), tasks.alias("tasks"), F.greatest(F.lit(0), F.max("d")).alias("high_water"))


def memory_in_use(models: DataFrame) -> DataFrame:
    """runner_id, vram_mb of loaded models, and lru: the loaded model used longest ago."""
    loaded = models.filter("loaded")
    return loaded.groupBy("runner_id").agg(F.sum("vram_mb").alias("vram_mb"), F.min_by("model", "last_used").alias("lru"))


def _units(column: pd.Series, width: int) -> np.ndarray:
    """Unit vectors; those without a direction (null, zero, not finite) are not numbers."""
    if any(v is not None and len(v) != width for v in column):
        raise ValueError(f"vectors must all have {width} numbers")
    rows = np.array([np.full(width, np.nan) if v is None else v for v in column], dtype=np.float64).reshape(len(column), width)
    with np.errstate(all="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, part: int = vector_index.PART, held: int = vector_index.QUERIES) -> DataFrame:
    """query_id, item_id, rank by cosine, ties by id, over every vector but the query itself. queries: a stated set; vectors: vec_id, embedding. What has no direction comes last, by id.

    Exact: each part of the vectors meets each part of the queries in a task of its own, which scores them by blocks, and the best k of each task go on. The work is the product of both, memory that of two parts.
    """
    kind, query_kind = vectors.schema["vec_id"].dataType.simpleString(), queries.schema["vec_id"].dataType.simpleString()
    parts, chunks = max(1, -(-vectors.count() // part)), max(1, -(-queries.count() // held))
    dealt = lambda df, name, n, other, m: df.filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(F.col("vec_id").cast("string")), F.lit(n)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    rows, asked = dealt(vectors, "part", parts, "chunk", chunks), dealt(queries, "chunk", chunks, "part", parts)

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        left = left.sort_values("id")
        ids, query_ids = left["id"].to_numpy(), right["id"].to_numpy()
        width = max((len(v) for side in (left, right) for v in side["v"] if v is not None), default=0)
        q, at, score = vector_index.best_rows(ids, _units(left["v"], width), query_ids, _units(right["v"], width), k)
        return pd.DataFrame({"query_id": query_ids[q], "item_id": ids[at], "score": score})

    keys = ["part", "chunk"]
    return vector_index.ranked(rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(scored, f"query_id {query_kind}, item_id {kind}, score double"), k)


def running_total(df: DataFrame, key: str, order: str, change: Column) -> DataFrame:
    """df with in_flight: the sum of changes so far."""
    return df.withColumn("in_flight", F.sum(change).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
