"""Sections, chunk packing and page ranges of deep and long documents, against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from quire.model import nodes
from quire.operators import chunks, evaluation

LEAVES = "doc_id string, path array<int>, node_id string, section string, is_atomic boolean, tokens int"


def folded(leaves, limit):
    out, state = {}, {}
    for doc, path, node, section, atomic, tokens in sorted(leaves, key=lambda r: (r[0], r[1], r[2])):
        chunk, first, total, is_open = state.get(doc, (-1, None, 0, False))
        joins = is_open and not atomic and first == section and total + tokens <= limit
        state[doc] = (chunk, first, total + tokens, True) if joins else (chunk + 1, section, tokens, not atomic)
        out[doc, node] = state[doc][0]
    return out


def leaves_at_random(seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(12):
        section = None
        for n in range(rng.randint(0, 120)):
            section = rng.choice([section] * 12 + ["a", "b", None])
            rows.append((f"d{d}", [n], f"n{n}", section, rng.random() < 0.05, rng.choice([1, 5, 20, 49, 50, 51, 200])))
    return rows


@pytest.mark.parametrize("fold", [0, 5, 4096])
def test_packing_equals_the_fold(spark, fold):
    rows = leaves_at_random()
    got = {(r.doc_id, r.node_id): r.chunk for r in chunks.pack(spark.createDataFrame(rows, LEAVES), 50, fold).collect()}
    assert got == folded(rows, 50)


def test_a_document_of_many_nodes(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("d").alias("doc_id"), F.array(F.col("id").cast("int")).alias("path"), F.col("id").cast("string").alias("node_id"), F.lit("s").alias("section"), F.lit(False).alias("is_atomic"), (F.col("id") % 7 + 1).cast("int").alias("tokens"))
    got = {int(r.node_id): r.chunk for r in chunks.pack(df, 100).select("node_id", "chunk").collect()}
    chunk, total = 0, 0
    for k in range(n):
        t = k % 7 + 1
        chunk, total = (chunk, total + t) if total + t <= 100 else (chunk + 1, t)
        assert got[k] == chunk


def chain(depth, **leaf):
    rows = [{"node_id": f"c{k}", "parent_id": f"c{k - 1}" if k else None, "path": [0] * (k + 1), "kind": "container", "title": f"t{k}" if k % 5 else None} for k in range(depth)]
    return [*rows, {"node_id": "leaf", "parent_id": f"c{depth - 1}", "path": [0] * (depth + 1), **leaf}]


def test_sections_of_twenty_levels(spark):
    got = {r.node_id: r.sections for r in chunks.section_paths(nodes(spark, chain(20))).collect()}
    assert got["leaf"] == [f"t{k}" for k in range(20) if k % 5] and got["c0"] == [] and got["c7"] == ["t1", "t2", "t3", "t4", "t6"]


def test_sections_that_run_in_a_circle_end(spark):
    rows = [{"node_id": "a", "parent_id": "b", "path": [0], "kind": "container", "title": "A"}, {"node_id": "b", "parent_id": "a", "path": [1], "kind": "container", "title": "B"}, {"node_id": "x", "parent_id": "gone", "path": [2]}]
    got = {r.node_id: r.sections for r in chunks.section_paths(nodes(spark, rows)).collect()}
    assert got["x"] == [] and set(got) == {"a", "b", "x"}


def test_chunks_show_all_sections(spark):
    docs = spark.createDataFrame([("d", "Book")], "doc_id string, title string")
    (only,) = chunks.build_chunks(nodes(spark, chain(12, text="words of the leaf")), docs).collect()
    assert only.header == "[Context: Book | " + " > ".join(f"t{k}" for k in range(12) if k % 5) + " | Pages: [1]]"


def ranges(rows):
    """The pages of each live container by recursion."""
    kids = {}
    for r in rows:
        kids.setdefault(r["parent_id"], []).append(r)

    def first(r):
        found = [p for k in kids.get(r["node_id"], []) if not k["is_tombstoned"] and (p := first(k)) is not None]
        return r["page"] if r["page"] is not None else min(found, default=None)

    def last(r):
        found = [p for k in kids.get(r["node_id"], []) if not k["is_tombstoned"] and (p := last(k)) is not None]
        return max([*found, *([r["page"]] if r["page"] is not None else [])], default=None)

    def walk(r):
        if not r["is_tombstoned"]:
            if r["kind"] == "container":
                yield r["node_id"], first(r), last(r)
            for k in kids.get(r["node_id"], []):
                yield from walk(k)

    return sorted((x for r in kids.get(None, []) for x in walk(r)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_page_ranges_equal_recursion(spark, seed):
    rng = random.Random(seed)
    rows = [{"node_id": "r", "parent_id": None, "path": [0], "kind": "container", "page": None, "is_tombstoned": False}]
    for k in range(150):
        up = rng.choice([r for r in rows if r["kind"] == "container" or rng.random() < 0.1])
        rows.append({"node_id": f"n{k}", "parent_id": up["node_id"], "path": [*up["path"], k], "kind": rng.choice(["container", "paragraph", "list"]), "page": rng.choice([None, rng.randint(0, 30)]), "is_tombstoned": rng.random() < 0.1})
    got = sorted(((r.node_id, r.first_page, r.last_page) for r in evaluation.page_ranges(nodes(spark, rows)).collect()), key=str)
    assert got == ranges(rows)


def test_tables_that_grow_with_the_nodes_are_not_broadcast(spark, monkeypatch):
    plans, staged = [], chunks.staged

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(chunks, "staged", seen)
    table = nodes(spark, chain(20))
    docs = table.select("doc_id").distinct().withColumn("title", F.lit("Book"))
    plans.append(chunks.section_paths(table)._jdf.queryExecution().executedPlan().toString())
    plans.append(chunks.build_chunks(table, docs)._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans[:-2]) and not any("Broadcast" in p for p in plans)
