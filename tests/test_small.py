"""Operators that no query shows whole: hand-made rows."""

import json
import re

from pyspark.sql import functions as F

from quire import catalog
from quire.functions import metrics
from quire.model import nodes
from quire.operators import analyzers, artifacts, chunks, evaluation, graph, review, rules
from quire.sources import files
from quire.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_entities_and_edges_of_a_node(spark):
    rows = spark.createDataFrame([("a", "A", "register", 1), ("a", "B", "signal", 2), ("c", "C", "table", 1)], "entity_id string, name string, entity_type string, seq int")
    assert {tuple(r) for r in graph.upsert_entities(rows).collect()} == {("a", "B", "signal"), ("c", "C", "table")}
    edges = spark.createDataFrame([("a", "b", "r", "main_flow"), ("a", "c", "s", "main_flow"), ("a", "c", "s", "footnote_flow"), ("b", "a", "r", "main_flow")], "source_id string, target_id string, relation string, track string")
    assert graph.edges_of(edges, "a").count() == 3 and graph.edges_of(edges, "a", outgoing=False).count() == 1
    assert graph.edges_of(edges, "a", relation="s").count() == 2 and graph.edges_of(edges, "a", track="footnote_flow").count() == 1
    made = graph.graph_json(edges.withColumn("doc_id", F.lit("d")).withColumn("seq", F.monotonically_increasing_id()), ("source_id", "target_id")).first()
    assert json.loads(made.edges)[0] == {"source_id": "a", "target_id": "b"}


def test_boxes_near_a_larger_one_go(spark):
    rows = [("r", "big", 0, 0, 100, 50), ("r", "near", 5, 5, 100, 50), ("r", "chain", 16, 5, 104, 50), ("r", "far", 300, 0, 380, 40), ("q", "near", 5, 5, 100, 50)]
    boxes = spark.createDataFrame([(a, b, *map(float, c)) for a, b, *c in rows], "region string, box_id string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.region, r.box_id) for r in graph.distinct_boxes(boxes).collect()} == {("r", "big"), ("r", "chain"), ("r", "far"), ("q", "near")}


def test_lists_and_maps_merge(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, rules.list_merged(arr("b", "a", "b"), arr("c", "a")), rules.list_merged(F.lit(None).cast("array<string>"), arr("x")), rules.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert got == (["b", "a", "c"], ["x"], {"a": 1, "b": 3})


def test_agents_and_manifests(spark):
    schema = "host string, name string, active_model string, roles array<string>"
    agents = spark.createDataFrame([("h1", "A", "m", ["x"]), ("h2", "B", "m", [])], schema)
    more, refused = rules.add_agents(agents, spark.createDataFrame([("h2", "Z", "z", []), ("h3", "C", "n", [])], schema))
    assert sorted(r.host for r in more.collect()) == ["h1", "h2", "h3"] and [r.host for r in refused.collect()] == ["h2"]
    now, unknown = rules.update_agents(more, spark.createDataFrame([("h1", "AA", None, ["y"]), ("h9", "?", "", [])], schema))
    assert {r.host: (r.name, r.active_model, r.roles) for r in now.collect()}["h1"] == ("AA", None, ["y"]) and unknown.first().host == "h9"
    left, absent = rules.delete_agents(now, spark.createDataFrame([("h1",), ("h8",)], "host string"))
    assert sorted(r.host for r in left.collect()) == ["h2", "h3"] and [r.host for r in absent.collect()] == ["h8"]
    made = rules.chapter_manifests(spark.createDataFrame([(1,), (2,)], "chapter int"), spark.createDataFrame([(2, '{"a":1}', 1), (2, '{"a":2}', 2)], "chapter int, manifest string, seq int"))
    got = {r.chapter: json.loads(r.manifest) for r in made.collect()}
    assert got[2] == {"a": 2} and got[1]["pages"]["count"] == 30 and got[1]["chapter"] == 1 and got[1]["element_order"] == {}


def test_runner_life(spark):
    events = ["start", "alive", "ready", "infer_ok", "error", "infer_ok", "error", "error", "error", "start", "start", "down"]
    at = [0, 10, 20, 30, 40, 50, 60, 70, 80, 100, 300, 400]
    rows = spark.createDataFrame([("r", t, i, e) for i, (t, e) in enumerate(zip(at, events))], "runner_id string, t long, seq int, event string").withColumn("ts", F.timestamp_seconds("t"))
    got = [(r.state, r.errors, r.refused) for r in jobs.runner_life(rows).orderBy("ts").collect()]
    assert [g[0] for g in got] == ["starting", "warming", "up", "up", "error", "up", "error", "error", "stopping", "stopping", "starting", "cold"]
    assert [g[1] for g in got] == [0, 0, 0, 0, 1, 0, 1, 2, 3, 3, 3, 0] and [i for i, g in enumerate(got) if g[2]] == [9]


def test_telemetry_and_totals(spark):
    rows = spark.createDataFrame([("m", "ocr", 2.0, True, 1), ("m", "ocr", 4.0, False, 5), ("m", "llm", 6.0, True, 3)], "k string, task string, seconds double, ok boolean, depth int")
    r = evaluation.telemetry(rows, "k").first()
    assert (r.total, r.errors, r.mean_seconds, json.loads(r.tasks), r.high_water) == (3, 1, 4.0, {"llm": 1, "ocr": 2}, 5)
    models = spark.createDataFrame([("r", "a", 100, 5, True), ("r", "b", 200, 3, True), ("r", "c", 900, 1, False)], "runner_id string, model string, vram_mb int, last_used int, loaded boolean")
    assert tuple(evaluation.memory_in_use(models).first()) == ("r", 300, "b")
    steps = spark.createDataFrame([("k", 1, 2), ("k", 2, -1), ("k", 3, 4)], "key string, at int, d int")
    assert [r.in_flight for r in evaluation.running_total(steps, "key", "at", F.col("d")).orderBy("at").collect()] == [2, 1, 5]


def test_spans_and_cells_are_flagged(spark):
    rows = nodes(spark, [{"node_id": "a", "path": [0], "spans": ["fine", "a          b"]}, {"node_id": "t", "path": [1], "kind": "table", "conf": 0.5}, {"node_id": "x", "path": [2], "spans": ["a         b"], "is_tombstoned": True}])
    cells = spark.createDataFrame([("d", "t", "cell/0/1", 0.2), ("d", "t", "cell/1/1", 0.9)], "doc_id string, node_id string, part string, conf double")
    got = review.flag(rows, parts=review.span_parts(rows).unionByName(cells)).collect()
    assert {r.node_id for r in got} == {"t", "a/span/1", "t/cell/0/1"} and len({r.task_id for r in got}) == 3


def test_segments_carry_box_and_settings(spark):
    rows = nodes(spark, [{"node_id": "b", "path": [0], "text": "second page", "page": 1, "x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": 0.4}, {"node_id": "a", "path": [1], "text": "first page", "page": 0}, {"node_id": "c", "path": [2], "text": "no page"}])
    blocks = review.translatable(rows)
    assert [r.node_id for r in review.translation_order(blocks).orderBy("place").collect()] == ["a", "b", "c"]
    made = {r.node_id: r for r in review.translate(blocks, "ru", name="m").collect()}
    assert made["b"].box.x1 == 0.3 and made["a"].box is None and tuple(made["a"].settings) == ("translator", "m", 0.0, 42)
    p = review.translation_progress(blocks, review.translate(blocks.filter("node_id = 'a'"), "ru"), "ru").first()
    assert (p.done, p.total, p.percent) == (1, 3, 33)


def test_pages_are_rebuilt_by_role(spark):
    book = [{"node_id": "r", "path": [0], "kind": "container", "title": "Book"}]
    for k, text in enumerate(["Section 2 Memory .... 12 2.1 Banks 15", "", "A Title", "by Nobody", "box one", "1 2 3"]):
        book.append({"node_id": f"n{k}", "parent_id": "r", "path": [0, k], "text": text, "page": (0, 0, 1, 1, 2, 3)[k], "x0": 0.2, "y0": 0.1 * k, "x1": 0.5, "y1": 0.1 * k + 0.05})
    roles = spark.createDataFrame([("d", 0, "toc"), ("d", 1, "title"), ("d", 2, "diagram"), ("d", 3, "table")], "doc_id string, page int, role string")
    out = review.rebuild_pages(nodes(spark, book), roles)
    got = {r.node_id: r for r in out.collect()}
    toc = next(r for r in got.values() if r.semantic_type == "toc")
    entries = sorted((r for r in got.values() if r.kind == "toc_entry"), key=lambda r: r.path)
    assert (toc.title, toc.level, toc.conf, toc.parent_id) == ("Оглавление", 2, 0.95, "r") and abs(toc.x0 - 0.18) < 1e-9 and toc.y0 == 0.0
    assert [(r.parent_id, r.attrs["entry_text"], r.attrs["chapter_number"], r.attrs["target_page"], r.attrs["level"]) for r in entries] == [(toc.node_id, "Section 2. Memory … 12", "Section 2", "11", "1"), (toc.node_id, "2.1. Banks … 15", "2.1", "14", "2")]
    title, diagram = (next(r for r in got.values() if r.kind == k) for k in ("title_page", "diagram"))
    assert title.spans == ["A Title\nby Nobody"] and title.conf == 0.9 and json.loads(diagram.attrs["labels"])[0]["text"] == "box one"
    assert got["n0"].is_tombstoned and got["n0"].tombstone_reason == f"page_rebuilt:toc:{toc.node_id}" and got["n4"].is_tombstoned
    assert not got["n5"].is_tombstoned and got["n5"].attrs["table_cell"] == "true"
    order = [r.node_id for r in sorted(got.values(), key=lambda r: r.path)]
    assert order.index(toc.node_id) < order.index(entries[0].node_id) < order.index("n0") < order.index("n1") < order.index(title.node_id) < order.index("n2")
    again = review.rebuild_pages(out, roles.filter("role = 'toc'"))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_mentions_that_repeat_have_places_of_their_own(spark):
    text = "R10 then R1 and R1, MOV R1"
    once, found = analyzers.entities(nodes(spark, [{"node_id": "a", "path": [0], "spans": [text, text]}]))
    names = {r.entity_id: r.name for r in once.collect()}
    got = sorted((r.source_id, r.start, names[r.entity_id]) for r in found.collect())
    want = sorted((f"a:{s}", m.start(), m.group()) for s in (0, 1) for m in re.finditer(r"R10|R1|MOV", text))
    assert got == want


def test_chunks_carry_language_and_graph(spark):
    rows = [{"node_id": "r", "path": [0], "kind": "container", "title": "One"}, {"node_id": "c", "path": [0, 0], "kind": "code", "attrs": {"language": "c", "code_text": "x"}, "page": 0}, {"node_id": "f", "path": [0, 1], "kind": "figure", "attrs": {"caption": "A figure"}, "text": "A figure", "page": 0}, {"node_id": "p", "path": [0, 2], "text": "See it there", "page": 0}]
    edges = spark.createDataFrame([("p", "fig-9", "references", 1.0), ("p", "fig-8", "next_to", 1.0), ("p", "tbl-1", "caption_for", 1.0), ("p", "figment", "references", 1.0), ("e2", "p", "about", 1.0)], "source_id string, target_id string, relation string, confidence double")
    entities = spark.createDataFrame([("figment", "Figment", "concept_term"), ("e2", "Two", "signal")], "entity_id string, name string, entity_type string")
    got = {tuple(r.node_ids): r for r in chunks.build_chunks(nodes(spark, rows), spark.createDataFrame([("d", "Book")], "doc_id string, title string"), edges, entities).collect()}
    assert got[("c",)].language == "c" and got[("p",)].language is None
    assert (got[("p",)].related_figures, got[("p",)].related_tables, got[("p",)].mentioned) == (["fig-9"], ["tbl-1"], ["Figment", "Two"])
    assert ("f",) not in got or got[("f",)].related_figures == ["f"]


def test_small_columns(spark):
    pages = one(spark, rules.layered(F.lit(None).cast("string"), F.lit("b"), F.lit("c")), rules.page_flags(F.lit("MOV |--- x")), rules.replaced(F.lit("aab"), [("a", "b"), ("bb", "c")]))
    assert pages[0] == "b" and tuple(pages[1]) == (True, True, False) and pages[2] == "cb"
    assert one(spark, metrics.axis_overlap(*map(F.lit, (0.0, 2.0, 1.0, 5.0))), metrics.axis_overlap(*map(F.lit, (0.0, 0.0, 1.0, 5.0))), metrics.calibrated(F.lit(0.2), F.lit(0.5))) == (0.5, 0.0, 0.0)
    box = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], ", ".join(f"{p}_{k} double" for p in "ab" for k in ("x0", "y0", "x1", "y1")))
    assert abs(box.select(metrics.box_iou("a", "b")).first()[0] - 1 / 7) < 1e-12
    assert one(spark, files.reader_of(F.lit("a/b.MD")), files.reader_of(F.lit("x.pdf")), files.reader_of(F.lit("noext"))) == ("markdown", "pdf", None)
    assert one(spark, artifacts.granted(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("z")))) == (["a"],)
    assert one(spark, graph.tikz_of_reply(F.lit("x \\begin{tikzpicture}a\\end{tikzpicture} y")), graph.tikz_of_reply(F.lit("none"))) == ("\\begin{tikzpicture}a\\end{tikzpicture}", None)


def test_queues_caches_and_imports(spark):
    todo = spark.createDataFrame([("a", 1, "pending"), ("b", 2, "failed"), ("c", 2, "pending")], "job_id string, created_at int, status string")
    assert [r.job_id for r in rules.queue_order(todo).collect()] == ["c", "b", "a"] and sorted(r.status for r in rules.claim(todo).collect()) == ["failed", "running", "running"]
    cache = spark.createDataFrame([("k", "v", 0, 10), ("k2", "w", 0, None), ("k3", "x", 0, 5)], "key string, value string, t long, ttl int").withColumn("stored_at", F.timestamp_seconds("t"))
    keys = spark.createDataFrame([("k",), ("k2",), ("k3",), ("k4",)], "key string")
    assert sorted(r.value for r in artifacts.cache_hits(cache, keys, F.timestamp_seconds(F.lit(8))).collect()) == ["v", "w"]
    r = files.import_jobs(spark.createDataFrame([("disk", "/a/b.md")], "provider string, path string")).first()
    assert (r.source_uri, r.status, len(r.job_id)) == ("sep://disk/a/b.md", "queued", 64)
    locked = artifacts.lock(spark.createDataFrame([("b1", "z", "1"), ("b1", "a", "2")], "build_id string, part string, content string")).first()
    assert list(locked.hashes) == ["a", "z"]


def test_review_helpers(spark):
    rows = nodes(spark, [{"node_id": "a", "path": [0], "text": "unsure", "cls_conf": 0.4}, {"node_id": "b", "path": [1], "text": "sure", "cls_conf": 0.9}, {"node_id": "c", "path": [2], "text": " ", "cls_conf": 0.1}])
    assert [r.node_id for r in review.model_candidates(rows).collect()] == ["a"]
    step = review.lineage_step(rows, "s", "me", F.col("kind"), F.col("node_id"), F.lit(3)).filter("entity_id = 'a'").first()
    assert (step.step, step.actor, step.at) == ("s", "me", 3) and step.in_hash != step.out_hash


def test_events_are_read_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"job_id":"j","ts":"2024-01-01T00:00:00","event":"e1","status":"running","progress":0.5,"stage":"s"}\n')
    stream = jobs.job_progress(jobs.read_events(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.job_id, r.status, r.progress) for r in spark.table("progress").collect()] == [("j", "running", 0.5)]


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_wer_of_passages(spark):
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    want = {item: words_apart(text.split(), other.split()) / len(text.split()) for (_, other), (item, text) in zip(items, items[1:])}
    got = {r.item_id: r.wer for r in catalog.QUERIES["wer_of_passages"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_chunk_queries_agree(spark):
    q = catalog.QUERIES
    made = q["semantic_chunks"](spark, SF).collect()
    by_doc = {}
    for r in made:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + 1
        assert r.tokens >= 1 and r.header.startswith("[Context: Book ") and r.chunk_type == "narrative"
    assert {r.doc_id: r.total_chunks for r in q["chunk_manifest"](spark, SF).collect()} == by_doc
    texts = sorted(r.text_hash for r in made)
    assert sorted(r.output_hash for r in q["instruction_dataset"](spark, SF).collect()) == texts == sorted(r.answer_hash for r in q["qa_dataset"](spark, SF).collect())


def test_glued_lines_are_cut_and_read(spark):
    kinds = "Section|Chapter|Appendix|Part|Глава|Раздел|Приложение"
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for n, line in enumerate(r.text.split("\n")):
            glued = f"Section 2 {line} .... 12 2.{n + 1} Second 15 Appendix A Tables xii"
            parts = [p.strip() for p in re.split(rf"\s+(?=(?:{kinds})\b|\d+\.\d)", glued.strip(), flags=re.I) if p.strip()]
            want.update({(r.doc_id, n, k): p for k, p in enumerate(parts)})
    got = {(r.doc_id, r.n, r.k): r for r in catalog.QUERIES["glued_toc_lines"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for key, part in want.items():
        if re.fullmatch(r"2\.\d+ Second 15", part):
            assert (got[key].level, got[key].number, got[key].page) == (2, part.split()[0], 15)
        if part == "Appendix A Tables xii":
            assert (got[key].level, got[key].number, got[key].page) == (1, "Appendix A", None)


def test_title_scores_tables_contents_and_latex_cover_their_documents(spark):
    q, docs = catalog.QUERIES, {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lines = {d: t.split("\n") for d, t in docs.items()}
    scores = {(r.doc_id, r.page): r for r in q["title_page_scores"](spark, SF).collect()}
    assert {d for d, _ in scores} == {d for d, ls in lines.items() if any(x.strip() for x in ls)}
    for (d, page), r in scores.items():
        assert r.is_long == any(len(x.strip()) > 150 for x in lines[d][page * 4 : page * 4 + 4])
    for r in q["toc_sections"](spark, SF).collect():
        assert r.entries >= 4 and 0.6 < r.confidence <= 0.9
    for r in q["table_blocks"](spark, SF).collect():
        assert r.rows >= 2 and 0 <= r.first < len(lines[r.doc_id])
    tex = {r.doc_id: r.chars for r in q["latex_documents"](spark, SF).collect()}
    assert tex.keys() == docs.keys() and all(tex[d] > sum(len(x.strip()) for x in lines[d]) for d in docs)
