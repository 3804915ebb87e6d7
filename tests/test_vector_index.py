"""The inverted index: exact with all cells, recall with some, hot cells, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import evaluation, vector_index as vi

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


def triples(df):
    return sorted((r.query_id, r.rank, r.item_id) for r in df.collect())


def test_all_cells_are_exact_and_fewer_reach_the_recall(spark, vectors):
    found = vi.centres(vectors)
    index = vi.build(vectors, found, part=15)
    assert index.count() == vectors.count() and index.agg(F.max("parts")).first()[0] > 1
    queries = vectors.filter("vec_id % 20 = 0")
    exact = evaluation.nearest_neighbours(vectors, queries, 10)
    assert triples(vi.search(index, found, queries, 10, len(found))) == triples(exact)
    probes = vi.probes_for(index, found, queries, 10)
    assert probes < len(found)
    assert vi.recall_of(vi.search(index, found, queries, 10, probes), exact) >= 0.9


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(1)
    groups = rng.normal(size=(30, 16))
    rows = [(k, (groups[k % 30] + rng.normal(size=16) * 0.05).tolist()) for k in range(1500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vi.centres(v, 60)
    index = vi.build(v, found)
    queries = v.filter("vec_id % 20 = 0")
    probes = vi.probes_for(index, found, queries, 10)
    assert probes <= 8 and vi.recall_of(vi.search(index, found, queries, 10, probes), evaluation.nearest_neighbours(v, queries, 10)) >= 0.9


def test_one_hot_cell_is_split_and_odd_rows_have_no_direction(spark, monkeypatch):
    monkeypatch.setattr(vi, "QUERIES", 7)
    rows = [(k, [1.0, 0.0]) for k in range(90)] + [(k, [0.0, 1.0 + k]) for k in range(100, 110)] + [(200, None), (201, [0.0, 0.0]), (None, [1.0, 1.0]), (202, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vi.centres(v, 2)
    index = vi.build(v, found, part=10)
    assert index.count() == 100
    sizes = [r["count"] for r in index.groupBy("cell", "part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 40
    got = triples(vi.search(index, found, v.filter("vec_id < 40"), 3, 1))
    assert got == [(q, rank + 1, i) for q in range(40) for rank, i in enumerate([i for i in range(4) if i != q][:3])]


def test_empty_and_other_widths(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vi.centres(none).shape == (0, 0)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    found = vi.centres(v, 1)
    index = vi.build(v, found)
    assert vi.search(index, found, none, 3, 1).collect() == []
    with pytest.raises(Exception, match="must have 2 numbers"):
        vi.search(index, found, spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<double>"), 3, 1).collect()


def test_exact_neighbours_by_parts_equal_plain_sorting(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) if k % 3 else np.eye(8)[k % 2]).tolist()) for k in range(300)] + [(400, None), (401, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = evaluation.nearest_neighbours(v, v.filter("vec_id % 20 = 0"), 7, part=90, held=6)
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in rows[:300]}
    score = lambda q, k: round(float(unit[q] @ unit[k]), 9) if q in unit and k in unit else -np.inf
    want = [(q, n + 1, k) for q in [*range(0, 300, 20), 400] for n, k in enumerate(sorted((k for k, _ in rows if k != q), key=lambda k: (-score(q, k), k))[:7])]
    assert triples(found) == sorted(want)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_scores_are_held_by_blocks_and_queries_go_once_to_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", (3, 5))
    rng = np.random.default_rng(6)
    rows, queries = rng.normal(size=(40, 4)), rng.normal(size=(11, 4))
    q, at, score = vi.best_rows(np.arange(40), rows, np.arange(100, 111), queries, 4)
    exact = np.round(queries @ rows.T, 9)
    assert at.reshape(11, 4).tolist() == np.argsort(-exact, axis=1, kind="stable")[:, :4].tolist() and q.tolist() == np.repeat(np.arange(11), 4).tolist()
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    index = vi.build(v, vi.centres(v, 20), part=10)
    shelves = index.groupBy("shelf").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("n")).collect()
    assert len(shelves) <= 5 and max(r.cells for r in shelves) > 1 and max(r.n for r in shelves) < 20
