"""Small operators by their results."""

import hashlib

from pyspark.sql import functions as F

from quire.model import nodes
from quire.operators import analyzers, artifacts, review, rules
from quire.streaming import jobs


def test_audit_for_takes_one_target(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, None)], "log_id string, seq int, target string")
    assert [r.seq for r in artifacts.audit_for(log, "y").collect()] == [2]


def test_badge_is_below_the_bar(spark):
    df = spark.createDataFrame([(0.1,), (review.BADGE,), (0.99,), (None,)], "c double")
    assert [r.b for r in df.select(review.badge(F.col("c")).alias("b")).collect()] == [True, False, False, None]


def test_approved_suggestions_become_terms(spark):
    asked = spark.createDataFrame([(1, "alpha", "Альфа", "pending"), (2, "beta", "", "pending"), (3, "gamma", None, "pending"), (4, "delta", "d", "pending")], "suggestion_id int, term string, context string, status string")
    terms, judged = rules.approve(asked, spark.createDataFrame([(1, True), (2, True), (3, False)], "suggestion_id int, ok boolean"))
    assert sorted((r.term, r.translation, r.category, r.seq) for r in terms.collect()) == [("alpha", "Альфа", "general", 1), ("beta", "beta", "general", 2)]
    assert {r.suggestion_id: r.status for r in judged.collect()} == {1: "approved", 2: "approved", 3: "rejected", 4: "pending"}


def test_lineage_is_in_order_of_time(spark):
    rows = nodes(spark, [{"node_id": "n", "path": [0], "text": "t"}, {"node_id": "m", "path": [1], "text": "t"}])
    step = lambda name, at: review.lineage_step(rows, name, "bot", F.lit("a"), F.lit("b"), F.lit(at))
    found = review.lineage(step("second", 2).unionByName(step("first", 1)), "n").collect()
    assert [(r.entity_id, r.step) for r in found] == [("n", "first"), ("n", "second")]
    assert found[0].in_hash == hashlib.sha256(b"a").hexdigest() and found[0].out_hash == hashlib.sha256(b"b").hexdigest()


def test_digest_mark(spark):
    got = spark.range(1).select(artifacts.digest_mark(F.lit("id"), F.lit("key"))).first()[0]
    assert got == hashlib.sha256(b"id:key").hexdigest()


def test_tasks_of_more_than_one_loader(spark):
    loaders = spark.createDataFrame([("ocr", "a"), ("ocr", "b"), ("embed", "c")], "task string, loader string")
    assert [(r.task, r.n) for r in rules.one_loader_a_task(loaders).collect()] == [("ocr", 2)]


def test_events_of_one_job(spark):
    events = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "job_id string, n int")
    assert sorted(r.n for r in jobs.for_job(events, "a").collect()) == [1, 3]


def test_title_scores_add_up(spark):
    """Capitals 2; copyright 3, publisher 2 and a year 1; ISBN 3 and capitals 2; an edition 2; three short lines or more 1."""
    texts = {0: ["COMPUTER ARCHITECTURE", "John Smith", "© 1998 Springer Press", "ISBN 0-13-1"], 1: ["words of plain text " * 9], 2: ["A handbook, 2nd edition"], 3: ["COPYRIGHT 2001"]}
    rows = nodes(spark, [{"node_id": f"{p}-{k}", "path": [p, k], "text": t, "page": p} for p, ts in texts.items() for k, t in enumerate(ts)])
    got = {r.page: (r.score, r.long, r.strong) for r in analyzers.title_scores(rows).collect()}
    assert got == {0: (2 + 0 + 6 + 5 + 1, False, True), 1: (0, True, False), 2: (2, False, True)}


def test_title_page_is_made_of_its_lines(spark):
    lines = ["COMPUTER ARCHITECTURE", "John Smith", "Springer Press", "2nd edition"]
    rows = nodes(spark, [{"node_id": "r", "path": [0], "kind": "container"}] + [{"node_id": f"n{k}", "parent_id": "r", "path": [0, k], "text": t, "page": 0} for k, t in enumerate(lines)])
    (made,) = analyzers.title_pages(rows).filter("kind = 'title_page'").collect()
    a = made.attrs
    assert (a["book_title"], a["authors"], a["publisher"], a["edition"], a["page_role"]) == ("COMPUTER ARCHITECTURE", "COMPUTER ARCHITECTURE; John Smith", "Springer Press", "2nd edition", "title")
    assert made.spans == ["\n".join(lines)]


def test_cells_of_tables_enter_the_queue(spark):
    grid = '[["fine", "  too   much \\t white   space  "], ["also fine", null], []]'
    rows = nodes(spark, [{"node_id": "t", "path": [0], "kind": "table", "attrs": {"grid": grid}, "ext_conf": 0.95, "conf": 0.95}, {"node_id": "u", "path": [1], "kind": "table", "attrs": {"grid": "no list"}}, {"node_id": "v", "path": [2], "kind": "table"}, {"node_id": "w", "path": [3], "kind": "table", "attrs": {"grid": grid}, "is_tombstoned": True}])
    parts = {r.part: (r.node_id, r.conf) for r in review.cell_parts(rows).collect()}
    assert set(parts) == {"cell/0/0", "cell/0/1", "cell/1/0", "cell/1/1"} and {n for n, _ in parts.values()} == {"t"}
    assert parts["cell/0/0"][1] == 0.95 and parts["cell/0/1"][1] < 0.95
    flagged = {r.node_id for r in review.flag(rows, threshold=0.95, parts=review.cell_parts(rows)).collect()}
    assert "t/cell/0/1" in flagged and "t/cell/0/0" not in flagged
