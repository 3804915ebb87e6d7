"""Nearest vectors by an inverted index: cells around fitted centres, of which a query probes the nearest.

Centres are fitted on a bounded sample of distinct rows; every row of the table is in one cell. A cell with many rows is dealt out in parts, and cells and parts stand on shelves of fewer than two times PART rows. A query goes once to each shelf
with a cell that it probes, so no task holds more than a shelf against QUERIES queries, and it scores them by blocks. How many cells a query must probe for a recall is measured against the exact result on a bounded sample of queries (probes_for). With all cells probed the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.storage import staged

SAMPLE = 20_000  # rows that centres are fitted on, at most
TRIED = 200  # queries that probes are chosen by, at most
PART, QUERIES = 20_000, 10_000  # rows of a part, and queries, that one task holds at once
BLOCK = 512, 4096  # queries and rows that are scored at once, 16 MB
SENT = 20_000  # rows of queries that are sent on at once
ROUNDS = 10


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of numbers that isn't zero; others have no cosine."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce((sound > 0) & (sound < float("inf")), F.lit(False)))


def centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centres of cells, unit vectors, by spherical k-means over at most `sample` rows, taken in an order by hash. cells: by default the root of the number of rows, 4096 at most."""
    usable = _usable(vectors)
    if cells is None:
        cells = max(1, min(4096, round(usable.count() ** 0.5)))
    order = F.xxhash64(F.lit(seed), F.col("vec_id").cast("string"))
    taken = usable.orderBy(order, "vec_id").limit(sample).toPandas()
    if not len(taken):
        return np.zeros((0, 0))
    rows = _unit(np.array(taken["v"].tolist()))
    rows = np.unique(rows, axis=0)
    at = np.random.default_rng(seed).choice(len(rows), min(cells, len(rows)), replace=False)
    found = rows[at]
    for _ in range(ROUNDS):
        near = (rows @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        empty = ~np.isin(np.arange(len(found)), near)
        found = np.where(empty[:, None], found, _unit(sums))
    return found


def _near(rows: pd.DataFrame, found: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of some rows, and their nearest cells."""
    width = found.shape[1]
    if any(len(v) != width for v in rows["v"]):
        raise ValueError(f"vectors must have {width} numbers, as those of the index")
    v = _unit(np.array(rows["v"].tolist()))
    return v, np.argsort(-(v @ found.T), axis=1, kind="stable")[:, :probes]


def _celled(vectors: DataFrame, found: np.ndarray) -> DataFrame:
    """id, v (unit), cell: the nearest one."""

    def deal(batches):
        for rows in batches:
            if len(rows):
                v, near = _near(rows, found, 1)
                yield pd.DataFrame({"id": rows["vec_id"].to_numpy(), "v": list(v), "cell": near[:, 0]})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return _usable(vectors).mapInPandas(deal, f"id {kind}, v array<double>, cell int")


def build(vectors: DataFrame, found: np.ndarray, part: int = PART) -> DataFrame:
    """The index: id, v, cell, part, parts, shelf; written to the shared folder. vectors: vec_id, embedding. Rows without a direction (null, zero, not finite) aren't in it."""
    rows = staged(_celled(vectors, found), "cells")
    n = rows.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / part).cast("int").alias("parts"))  # a row for each cell
    each = n.select("c", "parts", (F.col("n") / F.col("parts")).alias("n"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    before = F.sum("n").over(Window.orderBy("c", "p")) - F.col("n")
    shelves = each.select("c", "p", "parts", F.floor(before / part + 1e-9).cast("int").alias("shelf"))
    shelves = shelves.groupBy("c", "parts").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "shelf"))), lambda x: x["shelf"]).alias("shelves"))
    dealt = rows.join(F.broadcast(shelves), F.col("cell") == F.col("c")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return staged(dealt.select("id", "v", "cell", "part", "parts", F.get("shelves", F.col("part")).alias("shelf")), "vector-index")


def best_rows(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row, score: for each query the k rows of the greatest products, rounded to 9 places, ties by id, but for rows of its own id. ids ascend. Rows and queries that aren't finite have -inf.

    Blocks of BLOCK are scored one after another, and of each only what beats the k best so far is kept. allowed: gives, for places of queries and of rows, which pairs count.
    """
    low, high = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    odd_rows, odd_queries = ~np.isfinite(rows).all(axis=1), ~np.isfinite(queries).all(axis=1)
    rows, queries = np.where(odd_rows[:, None], 0.0, rows), np.where(odd_queries[:, None], 0.0, queries)
    out = []
    for a in range(0, len(queries), BLOCK[0]):
        some = slice(a, min(a + BLOCK[0], len(queries)))
        n = some.stop - a
        q, at, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        bar, full = np.full(n, -np.inf), np.zeros(n, dtype=bool)
        for c in range(0, len(rows), BLOCK[1]):
            these = slice(c, min(c + BLOCK[1], len(rows)))
            z = queries[some] @ rows[these].T
            z[:, odd_rows[these]] = -np.inf
            z[odd_queries[some]] = -np.inf
            if allowed is not None:
                z[~allowed(some, these)] = np.nan
            for i in np.flatnonzero((low[some] < high[some]) & (low[some] < these.stop) & (high[some] > c)):
                z[i, max(low[a + i] - c, 0) : max(high[a + i] - c, 0)] = np.nan
            open_ = np.flatnonzero(~full)
            if len(open_):
                last = min(k, z.shape[1]) - 1
                least = -np.partition(-z[open_], last, axis=1)[:, last]  # what is left out comes last
                bar[open_] = np.where(np.isnan(least), -np.inf, least - 1e-9)
            new_q, new_at = np.nonzero(z >= bar[:, None])
            if not len(new_q):
                continue
            q, at, score = np.concatenate((q, new_q)), np.concatenate((at, new_at + c)), np.concatenate((score, np.round(z[new_q, new_at], 9)))
            order = np.lexsort((at, -score, q))
            q, at, score = q[order], at[order], score[order]
            starts = np.searchsorted(q, np.arange(n))
            kept = np.arange(len(q)) - starts[q] < k
            q, at, score = q[kept], at[kept], score[kept]
            ends = np.searchsorted(q, np.arange(n), "right")
            full = np.bincount(q, minlength=n) >= k
            bar[full] = score[ends[full] - 1] + 2.5e-10  # an equal score of a later id loses
        out.append((q + a, at, score))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def ranked(made: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, rank of query_id, item_id, score."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return made.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "item_id", "rank")


def search(index: DataFrame, found: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, item_id, rank: the k nearest by cosine among the rows of the probed cells, ties by id, but for the query itself. queries: vec_id, embedding.

    Scores are rounded to 9 places, as in nearest_neighbours(). Each shelf gives k rows for each of its queries, which come with the cells they probe as bits.
    """
    kind, query_kind = index.schema["id"].dataType.simpleString(), queries.schema["vec_id"].dataType.simpleString()
    stands = index.select("cell", "shelf").distinct().collect()  # a row for each cell and part
    member = np.zeros((len(found), 1 + max((r.shelf for r in stands), default=0)), dtype=np.float32)
    for r in stands:
        member[r.cell, r.shelf] = 1

    def deal(batches):
        for batch in batches:
            size = max(1, SENT // member.shape[1])
            for i in range(0, len(batch), size):
                rows = batch.iloc[i : i + size]
                v, near = _near(rows, found, probes)
                probed = np.zeros((len(rows), len(found)), dtype=bool)
                np.put_along_axis(probed, near, True, axis=1)
                bits = np.array([x.tobytes() for x in np.packbits(probed, axis=1)], dtype=object)
                q, shelf = np.nonzero(probed.astype(np.float32) @ member)
                yield pd.DataFrame({"id": rows["vec_id"].to_numpy()[q], "v": list(v[q]), "probed": bits[q], "shelf": shelf.astype(np.int32)})

    asked = _usable(queries).mapInPandas(deal, f"id {query_kind}, v array<double>, probed binary, shelf int")
    chunks = max(1, -(-queries.count() // QUERIES))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int"))
    rows = index.select("id", "v", "cell", "shelf", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        left = left.sort_values("id")
        ids, query_ids, cell = left["id"].to_numpy(), right["id"].to_numpy(), left["cell"].to_numpy()
        bits = np.frombuffer(b"".join(right["probed"]), dtype=np.uint8).reshape(len(right), -1)
        allowed = lambda some, these: np.unpackbits(bits[some], axis=1)[:, cell[these]].astype(bool)
        q, at, score = best_rows(ids, np.array(left["v"].tolist()), query_ids, np.array(right["v"].tolist()), k, None if probes >= len(found) else allowed)
        return pd.DataFrame({"query_id": query_ids[q], "item_id": ids[at], "score": score})

    keys = ["shelf", "chunk"]
    return ranked(rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(scored, f"query_id {query_kind}, item_id {kind}, score double"), k)


def recall_of(got: DataFrame, exact: DataFrame) -> float:
    """The share of the exact result (query_id, item_id) that is in the other."""
    both = exact.select("query_id", "item_id").join(got.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return both.agg(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0))).first()[0]


def probes_for(index: DataFrame, found: np.ndarray, queries: DataFrame, k: int, recall: float = 0.95, tried: int = TRIED, seed: int = 7) -> int:
    """The least number of cells, by halving, at which at most `tried` of the queries reach the recall. Their exact neighbours come from probing every cell."""
    some = staged(queries.orderBy(F.xxhash64(F.lit(seed), F.col("vec_id").cast("string")), "vec_id").limit(tried), "tried-queries")
    exact = staged(search(index, found, some, k, len(found)), "exact-neighbours")
    low, high = 1, max(1, len(found))
    while low < high:
        middle = (low + high) // 2
        if recall_of(search(index, found, some, k, middle), exact) >= recall:
            high = middle
        else:
            low = middle + 1
    return high
