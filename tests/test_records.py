import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quire.model import live, nodes
from quire.operators import artifacts, chunks, evaluation, graph, review, rules
from quire.sinks.documents import document_json, latex, read_document_json
from quire.sources import files, skills
from quire.sources.spans import span_nodes


def edges(spark, rows):
    return spark.createDataFrame([("d", "main_flow", *r, i) for i, r in enumerate(rows)], "doc_id string, track string, source_id string, target_id string, confidence double, seq int")


def test_edges_upsert(spark):
    rows = [("a", "b", "r", "x", 0.5, {"k": "1", "l": "1"}, 1), ("a", "b", "r", "x", 0.9, {"k": "2"}, 2), ("a", "b", "r", None, 0.1, None, 3)]
    got = {r.analyzer: r for r in graph.upsert_edges(spark.createDataFrame(rows, "source_id string, target_id string, relation string, analyzer string, confidence double, metadata map<string,string>, seq int")).collect()}
    assert (got["x"].confidence, got["x"].metadata, got["x"].seq) == (0.9, {"k": "2", "l": "1"}, 1) and got[None].metadata == {}


def test_cycles(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    graph.assert_acyclic(e)
    with pytest.raises(ValueError):
        graph.assert_acyclic(e.unionByName(edges(spark, [("c", "a", 1.0)])))
    got = {(r.source_id, r.target_id): r.accepted for r in graph.accept_steps(edges(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 1.0), ("b", "c", 1.0)])).collect()}
    assert got == {("a", "b"): True, ("b", "a"): False, ("a", "a"): False, ("b", "c"): True}


def test_greedy_walk(spark):
    e = edges(spark, [("a", "b", 0.5), ("a", "c", 0.9), ("c", "a", 1.0), ("c", "b", 0.4), ("c", "d", 0.4)])
    roots = spark.createDataFrame([("d", "main_flow", "a")], "doc_id string, track string, node_id string")
    assert [r.node_id for r in graph.reading_sequence(e, roots).orderBy("step").collect()] == ["a", "c", "b"]


def test_boxes(spark):
    boxes = spark.createDataFrame([("p", "outer", 0.0, 0.0, 1.0, 1.0), ("p", "in", 0.1, 0.1, 0.4, 0.3)], "region string, box_id string, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("p", "w", 0.2, 0.15, 0.3, 0.2), ("p", "far", 0.8, 0.8, 0.9, 0.9)], "region string, word_id string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.word_id, r.box_id) for r in graph.boxes_to_labels(boxes, words).collect()} == {("w", "in"), ("far", "outer")}
    assert [r.box_id for r in graph.innermost_boxes(boxes).collect()] == ["in"]
    labels = words.withColumn("text", F.lit("T")).withColumnRenamed("word_id", "box_id")
    tex = graph.tikz(boxes, labels, boxes.select("region", F.col("box_id").alias("from_id"), "x0", "y0", "x1", "y1")).first().tikz
    assert tex.startswith("\\begin{tikzpicture}") and "\\node at (3.75,18.97) {T};" in tex


def book(spark):
    rows = [{"node_id": "c", "path": [0], "kind": "container", "level": 1, "title": "Intro"}]
    rows += [{"node_id": f"p{k}", "parent_id": "c", "path": [0, k], "text": "word " * 20, "page": k // 2} for k in range(4)]
    rows += [{"node_id": "code", "parent_id": "c", "path": [0, 4], "kind": "code", "text": "x = 1\n" * 300, "page": 2}, {"node_id": "t", "parent_id": "c", "path": [0, 5], "kind": "table", "attrs": {"grid": json.dumps([["a", "b"], ["c", "d"]])}}]
    rows += [{"node_id": "l", "parent_id": "c", "path": [0, 6], "kind": "list", "attrs": {"list_style": "ordered"}}] + [{"node_id": f"i{k}", "parent_id": "l", "path": [0, 6, k], "kind": "list_item", "text": f"item {k}", "is_tombstoned": k == 1} for k in range(3)]
    rows += [{"node_id": "dead", "path": [1], "kind": "container", "title": "Gone", "is_tombstoned": True}, {"node_id": "under", "parent_id": "dead", "path": [1, 0], "text": "hidden"}]
    return nodes(spark, rows)


def test_chunks(spark):
    docs = spark.createDataFrame([("d", "Book")], "doc_id string, title string")
    got = chunks.build_chunks(book(spark), docs, max_tokens=50).orderBy("chunk").collect()
    assert [c.chunk_type for c in got] == ["narrative", "narrative", "code", "table", "list"]
    assert got[0].node_ids == ["p0", "p1"] and got[0].header == "[Context: Book | Intro | Pages: [1]]" and got[2].tokens == 1800 // 4
    assert got[3].text == "a | b\nc | d" and got[3].pages == [1] and got[4].text == "1. item 0\n3. item 2"
    assert [c.prev_id for c in got] == [None] + [c.chunk_id for c in got[:-1]] and got[-1].next_id is None
    assert live(book(spark)).filter("node_id in ('dead', 'under')").count() == 0


def test_graph_rag_and_datasets(spark):
    docs = spark.createDataFrame([("d", "Book")], "doc_id string, title string")
    ents = spark.createDataFrame([("ax", "AX", "register")], "entity_id string, name string, entity_type string")
    e = spark.createDataFrame([("p0", "ax", "uses_register", 0.9), ("p0", "fig-1", "references", 1.0)], "source_id string, target_id string, relation string, confidence double")
    made = chunks.build_chunks(book(spark), docs, e, ents)
    first = made.orderBy("chunk").first()
    assert first.mentioned == ["AX"] and first.related_figures == ["fig-1"]
    n, links = chunks.graph_rag(made, ents, e)
    assert {r.id for r in n.filter("type <> 'chunk'").collect()} == {"ax"} and {(r.target, r.relation) for r in links.collect()} == {("ax", "MENTIONS_ENTITY"), ("ax", "uses_register"), ("fig-1", "references")}
    qa = chunks.qa_dataset(made, docs).filter(F.col("chunk_id") == first.chunk_id).first()
    assert qa.question == "What information is described in Book regarding narrative?" and qa.answer == first.text
    assert chunks.instruction_dataset(made).first().instruction.startswith("Analyze and extract key knowledge from: [Context: Book")
    assert json.loads(chunks.manifest(made).first().manifest)["total_chunks"] == made.count()


def test_json_and_latex(spark):
    back = read_document_json(document_json(book(spark)))
    assert {r.node_id for r in back.collect()} == {r.node_id for r in live(book(spark)).collect()}
    docs = spark.createDataFrame([("d", "A & B")], "doc_id string, title string")
    tex = latex(book(spark), docs).first().tex
    assert "\\title{A \\& B}" in tex and "\\chapter{Intro}" in tex and "\\begin{enumerate}\n\\item item 0\n\\item item 2\n\\end{enumerate}" in tex and "a & b \\\\ \\hline" in tex and "hidden" not in tex
    said = spark.createDataFrame([("d", "p0", "ru", "слово")], "doc_id string, node_id string, lang string, text string")
    assert "слово" in latex(book(spark), docs, said, "ru").first().tex


def test_review(spark):
    df = nodes(spark, [{"node_id": "a", "path": [0], "text": "x", "conf": 0.95}, {"node_id": "b", "path": [1], "text": "old", "conf": 0.45}, {"node_id": "c", "path": [2], "kind": "list_item", "text": "y", "conf": 0.1}, {"node_id": "e", "path": [3], "text": "z", "conf": 0.1, "is_tombstoned": True}])
    (task,) = review.flag(df, 0.70).collect()
    assert task.node_id == "b" and task.status == "pending"
    fix = spark.createDataFrame([("d", "b", "t", {"text": "new", "note": "n"}, "ann", "rejected", 2), ("d", "b", "t0", {"text": "first"}, "ann", "approved", 1)], "doc_id string, node_id string, task_id string, payload map<string,string>, reviewer string, decision string, at int")
    out, history, steps = review.apply_corrections(df, fix)
    b = out.filter("node_id = 'b'").first()
    assert (b.spans, b.conf, b.attrs) == (["new"], 1.0, {"note": "n"}) and (history.first().before, history.first().after) == ("old", "new") and steps.count() == 1
    ids = spark.createDataFrame([("d", "b")], "doc_id string, node_id string")
    r = review.refine_by_hand(df, ids).filter("node_id = 'b'").first()
    assert (r.ext_conf, r.cls_conf, r.conf) == (1.0, 1.0, 0.45)
    assert [x.batch for x in review.batches(df).orderBy("path").collect()] == [0, 0, 0, 1]


def test_artifacts(spark):
    new = spark.createDataFrame([(bytearray(b"x"), "t", "first", 1), (bytearray(b"x"), "t", "second", 2), (bytearray(b"y"), "t", "p", 3), (bytearray(b"z"), "t", "p", 4)], "content binary, type string, producer string, seq int")
    got = artifacts.put_artifacts(new)
    ids = {bytes(r.content): r.artifact_id for r in got.collect()}
    assert len(ids) == 3 and got.filter("producer = 'second'").count() == 0 and ids[b"x"] == hashlib.sha256(b"x").hexdigest()
    snaps = spark.createDataFrame([("s", [ids[b"x"], "gone"])], "snapshot_id string, refs array<string>")
    pins = spark.createDataFrame([(ids[b"y"],)], "artifact_id string")
    assert [r.artifact_id for r in artifacts.garbage(got, snaps, pins).collect()] == [ids[b"z"]] and [r.artifact_id for r in artifacts.missing_refs(snaps, got).collect()] == ["gone"]
    assert artifacts.corrupted(got).count() == 0 and artifacts.corrupted(got.withColumn("content", F.lit(b"bad"))).count() == 3
    ev = spark.createDataFrame([("l", str(k), "a", "do", "t", f"p{k}") for k in range(5)], "log_id string, at string, actor string, action string, target string, payload string")
    log = artifacts.audit_rows(ev)
    assert log.count() == 5 and artifacts.broken_links(log).count() == 0
    broken = log.withColumn("line", F.when(F.col("seq") == 2, "x").otherwise(F.col("line")))
    assert [r.seq for r in artifacts.broken_links(broken).collect()] == [3]
    a = spark.createDataFrame([("k", "1", None)], "key string, x string, y string")
    assert artifacts.same_build(a, a, ("x", "y")).first().reproducible and not artifacts.same_build(a, a.withColumn("y", F.lit("2")), ("x", "y")).first().reproducible
    jobs = spark.createDataFrame([(1, 2), (9, 2)], "cpu int, memory_mb int")
    assert [r[0] for r in jobs.select(artifacts.fits({"cpu": 4, "memory_mb": 4})).collect()] == [True, False]


def test_evaluation(spark):
    e = spark.createDataFrame([("s", "a", "b", "r"), ("s", "a", "c", "r"), ("t", "a", "b", "r")], "by string, source_id string, target_id string, relation string")
    got = {r["by"]: r for r in evaluation.link_f1(e, e.filter("target_id = 'b' and by = 's'"), "by").collect()}
    assert (got["s"].precision, got["s"].recall) == (1.0, 0.5) and got["s"].f1 == pytest.approx(2 / 3) and got["t"].f1 == 0.0
    p = spark.createDataFrame([(0.0, True), (0.19, False), (0.5, True), (1.0, True), (0.99, False)], "p double, y boolean")
    bins = {r.bin: r for r in evaluation.calibration_bins(p, "p", "y", 5).collect()}
    assert [bins[k].n for k in range(5)] == [2, 0, 1, 0, 2] and bins[4].accuracy == 0.5
    assert evaluation.ece(p, "p", "y", 5).first().ece == pytest.approx((2 * abs(0.5 - 0.095) + abs(1 - 0.5) + 2 * abs(0.5 - 0.995)) / 5)
    samples = spark.createDataFrame([("a", "x y", "x y", [["1"]], [["1"]]), ("b", "x y", "x z", None, None)], "sample_id string, reference string, hypothesis string, expected_grid array<array<string>>, found_grid array<array<string>>")
    out = evaluation.evaluate_samples(samples)
    assert {r.sample_id: r.passed for r in out.collect()} == {"a": True, "b": False}
    with pytest.raises(AssertionError, match="b"):
        evaluation.assert_passed(out)


def test_rules(spark):
    t = spark.createDataFrame([("Buy MOV now",), ("plain",)], "text string")
    assert [r.skills for r in rules.match_skills(t, [{"name": "s", "keywords": ["mov"], "patterns": ["("]}]).collect()] == [["s"], []]
    url = spark.createDataFrame([("http://host.org:80/x",), ("http://10.1.1.1:80/",), ("ftp://a.b:1/",), ("http://host.org/",)], "u string")
    assert [r[0] for r in url.select(rules.runner_origin(F.col("u"))).collect()] == ["http://host.org:80", None, None, None]
    assert [r[0] for r in spark.createDataFrame([("running",), ("odd",)], "k string").select(rules.backend_state(F.col("k"))).collect()] == ["up", "error"]
    pages = spark.createDataFrame([(1, 1, "# Title\nExample text", None, False), (1, 2, "", "fallback", False)], "chapter int, page int, final string, original string, has_debug boolean")
    assert "\\section{Title}" in rules.chapter_latex(pages).first().tex


def test_markdown_and_text(spark, tmp_path):
    md = "intro\n\n# Book\n\npara one\nline two\n\n## Sec\n```python\nx = 1\n\ny\n```\n### Sub\nend\n## Sec2\nlast\n```\nopen"
    (tmp_path / "b.md").write_text(md, encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    got = files.whole_files(spark, str(tmp_path / "*.md"))
    assert files.parse_errors(got).count() == 1
    good = got.filter("is_valid")
    n = files.markdown_nodes(good)
    rows = n.orderBy("path").collect()
    assert [(r.kind, r.level, r.title) for r in rows if r.kind == "container"] == [("container", 1, "b"), ("container", 1, "Book"), ("container", 2, "Sec"), ("container", 3, "Sub"), ("container", 2, "Sec2")]
    assert [r.spans for r in rows if r.kind == "paragraph"] == [["intro"], ["para one", "line two"], ["end"], ["last"]]
    assert [(r.attrs.get("language"), r.attrs["code_text"]) for r in rows if r.kind == "code"] == [("python", "x = 1\n\ny"), (None, "open")]
    assert files.markdown_titles(n, good).first().title in ("Book", "b")
    text = spark.createDataFrame([("d", "/a/t.txt", "one\ntwo\n\n\n\n  three \n\n")], "doc_id string, source_uri string, text string")
    assert [r.spans for r in files.text_nodes(text).filter("kind = 'paragraph'").orderBy("path").collect()] == [["one", "two"], ["three"]]
    assert [files.reader_for(".MD"), files.reader_for(mime="Text/Plain; charset=x"), files.reader_for("xyz")] == ["markdown", "text", None]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.txt").write_text("x")
    assert [(r.name, r.is_dir) for r in files.list_files(spark, str(tmp_path)).collect()] == [("sub", True), ("b.md", False), ("bad.md", False)]


def test_pdf_spans(spark):
    shape = "doc_id string, page int, page_w double, page_h double, block int, line int, span int, text string, font string, size double, flags int, bx0 double, by0 double, bx1 double, by1 double"
    rows = [("d", 0, 100.0, 200.0, 0, 0, 0, "A heading here", "Times", 20.0, 16, 10.0, 20.0, 50.0, 40.0), ("d", 0, 100.0, 200.0, 1, 0, 0, "print code value", "Courier", 9.0, 0, 0.0, 0.0, 10.0, 10.0), ("d", 0, 100.0, 200.0, 2, 0, 0, "1;;..!!", "Times", 9.0, 0, 0.0, 0.0, 10.0, 10.0)]
    pages = spark.createDataFrame([("d", 0, 0), ("d", 1, 2), ("d", 60, 0)], "doc_id string, page int, n_images int")
    got = {r.node_id: r for r in span_nodes(spark.createDataFrame(rows, shape), pages, spark.createDataFrame([("d", "T")], "doc_id string, title string")).collect()}
    assert set(got) == {"d/root", "d/0/0", "d/0/1", "d/1/empty"} and got["d/0/1"].kind == "code" and got["d/1/empty"].attrs == {"needs_ocr": "true"}
    h = got["d/0/0"]
    assert (h.x0, h.y0, h.x1, h.y1, h.font_size, h.attrs["bold"]) == (0.1, 0.1, 0.5, 0.2, 20.0, "true") and h.ext_conf == pytest.approx(0.8)


def test_skill_files(tmp_path):
    (tmp_path / "s.md").write_text("---\nname: asm\nversion: 1.5\nactive: true\ntriggers:\n  keywords: [mov, add]\n---\n## Patterns\n### Regs\n- `R\\d`\n## Rules\n1. Keep code\n- Keep names\n")
    (tmp_path / "bad.md").write_text("no front matter")
    (skill,) = skills.load_skills(str(tmp_path))
    assert (skill["name"], skill["keywords"], skill["patterns"], skill["rules"]) == ("asm", ["mov", "add"], ["R\\d"], ["Keep code", "Keep names"]) and skill["meta"]["version"] == 1.5 and skill["meta"]["active"] is True
