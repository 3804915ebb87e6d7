"""Cycles of reading tracks and the steps that are accepted, against plain searches."""

import random
import time

import pytest

from quire.operators import graph

EDGES = "track string, source_id string, target_id string"


def left_over(edges):
    rows = list(edges)
    while True:
        starts, ends = {(t, s) for t, s, _ in rows}, {(t, e) for t, _, e in rows}
        kept = [(t, s, e) for t, s, e in rows if (t, e) in starts and (t, s) in ends]
        if len(kept) == len(rows):
            return sorted(rows)
        rows = kept


@pytest.mark.parametrize("bound", [0, 1000])
def test_cycles_equal_peeling(spark, bound):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(70)] + [("w", "a", "b"), ("w", "b", "c"), ("v", "a", "a")]
    got = graph.on_cycles(spark.createDataFrame(rows, EDGES), bound).collect()
    assert sorted(map(tuple, got)) == left_over(rows) and ("v", "a", "a") in map(tuple, got)


def test_a_chain_of_fifty_thousand_edges(spark):
    n = 50_000
    chain = spark.range(n).selectExpr("'t' AS track", "concat('n', id) AS source_id", "concat('n', id + 1) AS target_id")
    graph.assert_acyclic(chain)
    with pytest.raises(ValueError, match="cyclic"):
        graph.assert_acyclic(chain.unionByName(spark.createDataFrame([("t", f"n{n}", "n0")], EDGES)))


def accepted(edges):
    after, out = {}, []
    for s, t in edges:
        seen, waiting = set(), [t]
        while waiting:
            x = waiting.pop()
            if x not in seen:
                seen.add(x)
                waiting += after.get(x, ())
        out.append(s not in seen)
        if out[-1]:
            after.setdefault(s, []).append(t)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_order_accepts_what_a_search_accepts(seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(rng.randint(1, 120))]
    order = graph._Order()
    assert [order.accept(s, t) for s, t in edges] == accepted(edges)


def test_a_dense_track_is_quick():
    rng = random.Random(9)
    edges = [(rng.randint(0, 2000), rng.randint(0, 2000)) for _ in range(10_000)]
    order, began = graph._Order(), time.process_time()
    kept = [order.accept(s, t) for s, t in edges]
    assert time.process_time() - began < 20 and all(order.at[s] < order.at[t] for (s, t), k in zip(edges, kept) if k)
