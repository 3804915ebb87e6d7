import json
import random
import time

import glob

import pytest
from pyspark.sql import functions as F

from quire.model import nodes
from quire.operators import analyzers as a
from quire import storage
from quire.plans.runner import DEFAULT, Operator, parts_for, run_pipeline, validate


def tree(spark, children, **more):
    """A root container and its children: dicts or texts."""
    rows = [{"node_id": "root", "path": [0], "kind": "container", "level": 1, "title": "Root", **more}]
    for i, c in enumerate(children):
        c = {"text": c} if isinstance(c, str) else c
        rows.append({"node_id": f"n{i}", "parent_id": "root", "path": [0, i], **c})
    return nodes(spark, rows)


def by_id(df):
    return {r.node_id: r for r in df.collect()}


def kinds(df):
    return [r.kind for r in df.orderBy("path").collect()]


def test_normalize(spark):
    got = by_id(a.normalize(tree(spark, ["  two\t words ", "same"])))
    assert got["n0"].spans == ["two words"] and got["n0"].attrs["span_confidence"] == str(1.0 - 4 / 13) and "span_confidence" not in got["n1"].attrs


def test_lists(spark):
    rows = ["• one", "• two", "• three", "prose", "- single", "prose", {"text": "• dead", "is_tombstoned": True}, "1. first", "2. second", "a) third"]
    got = a.lists(tree(spark, rows))
    r = by_id(got)
    lists = got.filter("kind = 'list'").orderBy("path").collect()
    assert [x.attrs["list_style"] for x in lists] == ["bullet", "ordered"]
    assert [r[f"n{k}"].kind for k in range(10)] == ["list_item"] * 3 + ["paragraph"] * 4 + ["list_item"] * 3
    assert r["n0"].spans == ["one"] and r["n4"].spans == ["single"] and r["n6"].spans == ["• dead"] and r["n0"].attrs["marker"] == "•"
    order = [x.node_id for x in got.orderBy("path").collect()]
    assert order.index(lists[0].node_id) == order.index("n0") - 1 and r["n0"].parent_id == lists[0].node_id


def test_headings_nest_and_flag_jumps(spark):
    sizes = [12, 30, 12, 16, 12, 18, 12]
    texts = ["body text", "Chapter One", "body text", "Sub Sub", "body", "Section", "body"]
    got = a.headings(tree(spark, [{"text": t, "font_size": float(s)} for t, s in zip(texts, sizes)]))
    r = by_id(got)
    assert [(r[k].kind, r[k].level, r[k].parent_id) for k in ("n1", "n3", "n5")] == [("container", 1, "root"), ("container", 3, "n1"), ("container", 2, "n1")]
    assert r["n2"].parent_id == "n1" and r["n4"].parent_id == "n3" and r["n6"].parent_id == "n5" and r["n0"].parent_id == "root"
    assert r["n3"].attrs.get("heading_violation") == "true" and r["n3"].conf == 0.5 and "heading_violation" not in r["n5"].attrs
    edges = {(e.source_id, e.target_id) for e in a.continuation_edges(got).collect()}
    assert edges == {("root", "n1")} and {e.name for e in a.concept_entities(got).collect()} == {"Root", "Chapter One", "Sub Sub", "Section"}


def test_body_size_tie_goes_to_the_first(spark):
    got = a.body_sizes(tree(spark, [{"text": "x", "font_size": s} for s in (14.0, 10.0, 10.0, 14.0)]), F.col("kind") == "paragraph").collect()
    assert [r.body for r in got] == [14.0]


def test_footnotes(spark):
    rows = [{"text": "Body of the page", "font_size": 12.0, "y0": 0.1}, {"text": "More body", "font_size": 12.0, "y0": 0.3}, {"text": "¹² A note", "font_size": 8.5, "y0": 0.92}, {"text": "1. A step", "font_size": 12.0, "y0": 0.2}, {"text": "2. small but high", "font_size": 8.5, "y0": 0.2}, "† no layout"]
    got = by_id(a.footnotes(tree(spark, rows)))
    assert [got[f"n{k}"].kind for k in range(6)] == ["paragraph", "paragraph", "footnote", "paragraph", "paragraph", "footnote"]
    assert got["n2"].attrs["footnote_number"] == "12" and got["n2"].attrs["rest"] == "A note" and got["n2"].cls_conf == 0.75


def test_formulas_callouts_bibliography(spark):
    got = by_id(a.formulas(tree(spark, ["∑αβ = γ (2.1)", {"text": "x", "font_family": "CMMI10"}, "Plain prose."])))
    assert (got["n0"].kind, got["n0"].attrs["formula_number"], got["n0"].cls_conf) == ("formula", "2.1", 0.60) and got["n1"].cls_conf == 0.75 and got["n2"].kind == "paragraph"
    got = by_id(a.callouts(tree(spark, ["Note: read", {"text": "Note: title", "kind": "title_page"}])))
    assert got["n0"].kind == "callout" and got["n0"].attrs["callout_kind"] == "note" and got["n1"].kind == "title_page"
    got = by_id(a.bibliography(tree(spark, ["[1] Knuth, D. The Art. 1968.", "short"], title="References")))
    assert got["root"].semantic_type == "bibliography" and got["n0"].kind == "bib_entry" and got["n0"].attrs["cite_key"] == "1" and got["n1"].kind == "paragraph"


def test_title_pages(spark):
    rows = [{"text": "THE GREAT BOOK", "page": 0}, {"text": "Jane Austen", "page": 0}, {"text": "Oxford University Press", "page": 0}, {"text": "2nd edition 1999", "page": 0}, {"text": "", "page": 5}, {"text": "CONTENTS", "page": 1}, {"text": "Plain text", "page": 6}]
    got = a.title_pages(tree(spark, rows))
    r = by_id(got)
    (page,) = got.filter("kind = 'title_page'").collect()
    assert page.attrs["book_title"] == "THE GREAT BOOK" and page.attrs["authors"] == "THE GREAT BOOK; Jane Austen" and page.attrs["publisher"] == "Oxford University Press" and page.attrs["edition"] == "2nd edition"
    assert all(r[f"n{k}"].is_tombstoned for k in range(4)) and r["n4"].kind == "blank_page" and not r["n5"].is_tombstoned
    order = [x.node_id for x in got.orderBy("path").collect()]
    assert order[:3] == ["root", page.node_id, "n0"]
    cover = by_id(a.title_pages(tree(spark, [{"text": " ", "page": 0}])))["n0"]
    assert cover.kind == "title_page" and cover.attrs["page_role"] == "cover"


def brute_table_runs(boxes):
    """boxes: (x0, x1, y0) in document order; runs of indexes."""
    columns = []
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][0]):
        for c in columns:
            a0, a1, _ = boxes[c[0]]
            b0, b1, _ = boxes[i]
            width = min(a1 - a0, b1 - b0)
            if width > 0 and (min(a1, b1) - max(a0, b0)) / width >= 0.3:
                c.append(i)
                break
        else:
            columns.append([i])
    runs = []
    for c in columns:
        c = sorted(c, key=lambda i: boxes[i][2])
        run, step = [c[0]], None
        for p, i in zip(c, c[1:]):
            gap = boxes[i][2] - boxes[p][2]
            if gap < 0.005:
                continue
            if step is None or abs(gap - step) < 0.008:
                step = step or gap
                run.append(i)
            else:
                runs.append(run)
                run, step = [i], None
        runs.append(run)
    return sorted(r for r in runs if len(r) >= 5)


def test_table_runs_equal_brute_force(spark):
    rng = random.Random(1)
    boxes = [(x, x + rng.choice([0.1, 0.2]), round(0.02 * k + (rng.random() < 0.15) * 0.012, 4)) for k in range(30) for x in rng.sample([0.1, 0.15, 0.5, 0.8], 2)]
    df = tree(spark, [{"text": f"c{i}", "page": 0, "x0": x0, "x1": x1, "y0": y0, "y1": y0 + 0.01} for i, (x0, x1, y0) in enumerate(boxes)])
    got = {}
    for r in a.table_runs(df).collect():
        got.setdefault(r.run, []).append((r.place, int(r.node_id[1:])))
    assert sorted([i for _, i in sorted(v)] for v in got.values()) == brute_table_runs(boxes)


def test_tables(spark):
    rows = [{"text": f"cell {k}", "page": 0, "x0": 0.1, "x1": 0.3, "y0": 0.1 + 0.02 * k, "y1": 0.11 + 0.02 * k, "ext_conf": 0.8} for k in range(6)] + ["after"]
    got = a.tables(tree(spark, rows))
    (t,) = got.filter("kind = 'table'").collect()
    assert json.loads(t.attrs["grid"]) == [[f"cell {k}"] for k in range(6)] and t.cls_conf == pytest.approx(0.8) and t.conf == pytest.approx(0.8)
    assert kinds(got)[:2] == ["container", "table"] and got.filter("tombstone_reason = 'merged_into_table'").count() == 6


def test_diagrams(spark):
    rows = [{"text": f"box {k}", "page": 3, "x0": 0.1 * k, "x1": 0.1 * k + 0.1, "y0": 0.2, "y1": 0.25} for k in range(6)] + [{"text": "Figure 2-11 Modes", "page": 3, "x0": 0.1, "x1": 0.8, "y0": 0.5, "y1": 0.52}]
    got = a.diagrams(tree(spark, rows))
    (d,) = got.filter("kind = 'diagram'").collect()
    assert (d.x0, d.y0, d.y1) == pytest.approx((0.0, 0.17, 0.28)) and d.x1 == pytest.approx(0.77) and d.attrs["caption_text"] == "Figure 2-11 Modes" and len(json.loads(d.attrs["labels"])) == 6
    assert got.filter("is_tombstoned").count() == 6 and kinds(got)[1] == "diagram"
    assert a.diagrams(tree(spark, rows[:6])).filter("kind = 'diagram'").count() == 0


def test_captions_link_to_the_nearest(spark):
    rows = [{"text": "", "kind": "table"}, "x", "Table 1 first", "x", {"text": "", "kind": "table"}, "Figure 2-1 none before", {"text": "", "kind": "figure"}]
    got = a.captions(tree(spark, rows))
    caps = {r.attrs["label_number"]: r for r in got.filter("kind = 'caption'").collect()}
    assert caps["1"].attrs["target_block_id"] == "n0" and caps["2-1"].attrs["target_block_id"] == "n6" and caps["1"].node_id != "n2"
    assert by_id(got)["n0"].attrs["caption_id"] == caps["1"].node_id and "caption_id" not in by_id(got)["n4"].attrs
    flow = {(e.source_id, e.target_id, e.track) for e in a.main_flow(got).collect()}
    assert ("n0", caps["1"].node_id, "caption_flow") in flow and ("n0", "n1", "main_flow") in flow


def test_toc(spark):
    lines = ["1. First steps .... 3", "2. Second part .... 9", "Preface 1", "Closing words 12", "Index of names 14"]
    rows = [{"text": t, "page": 1} for t in lines] + ["Plain prose of the book."]
    df = tree(spark, rows).unionByName(nodes(spark, [{"node_id": "h1", "path": [1], "kind": "container", "level": 1, "title": "1.  First steps"}, {"node_id": "h2", "path": [2], "kind": "container", "level": 1, "title": "Closing  Words"}]))
    got = a.classify_blocks(df)
    entries = got.filter("kind = 'toc_entry'").orderBy("path").collect()
    assert [e.attrs.get("anchor_id") for e in entries] == ["h1", None, None, "h2", None] and [e.attrs["target_page"] for e in entries] == ["2", "8", "0", "11", "13"]
    (toc,) = got.filter("semantic_type = 'toc'").collect()
    assert toc.level == 2 and toc.cls_conf == pytest.approx(0.60 + 0.30 * 2 / 5 + 0.05) and got.filter("tombstone_reason = 'merged_into_toc'").count() == 5
    assert [r.cls_conf for r in got.filter("node_id = 'n5'").collect()] == [pytest.approx(0.8)]
    middle = tree(spark, [{"text": t, "page": 50} for t in lines])
    assert a.classify_blocks(middle).filter("kind = 'toc_entry'").count() == 0


def test_entities(spark):
    once, found = a.entities(tree(spark, ["MOV R1, r1", "MOV 0xFF"]))
    assert sorted((r.entity_type, r.name) for r in once.collect()) == [("concept_term", "0xFF"), ("instruction", "MOV"), ("register", "R1")]
    assert sorted((r.node_id, r.start) for r in found.collect()) == [("n0", 0), ("n0", 4), ("n1", 0), ("n1", 4)]


def test_pages(spark):
    df = tree(spark, [{"text": "a", "page": 1}, {"text": "b"}, {"text": "c", "page": 2}, {"text": "d"}]).filter("kind = 'paragraph'")
    assert [r.page for r in a.page_fill(df).orderBy("path").collect()] == [1, 1, 2, 2]
    assert [r.page_group for r in a.page_groups(df).orderBy("path").collect()] == [1, 2, 3, 4]
    numeric = tree(spark, [{"text": t, "page": 0} for t in ("10 20", "30%", "4.5", "long words in a line of text that is no number at all", "99")])
    assert [r.page for r in a.table_pages(numeric).collect()] == [0]


def test_model_refinement(spark):
    df = tree(spark, [{"text": "unsure", "cls_conf": 0.4}, {"text": "sure", "cls_conf": 0.8}])
    got = by_id(a.refine_with_model(df, lambda frames: (f.assign(confidence=0.99)[["node_id", "confidence"]] for f in frames)))
    assert got["n0"].cls_conf == 0.9 and got["n1"].cls_conf == 0.8
    assert by_id(a.refine_with_model(df))["n0"].cls_conf == 0.4


def test_runner(spark):
    validate(DEFAULT)
    with pytest.raises(ValueError):
        validate((Operator("x", lambda t: t, ("y",)),))
    df = tree(spark, ["• one", "• two"])
    steps = (Operator("normalize", a.normalize), Operator("bad", lambda t: t.withColumn("conf", F.raise_error(F.lit("no")).cast("double"))), Operator("lists", a.lists, ("normalize",)))
    out = run_pipeline(df, steps, isolate=True)
    assert set(out.failed) == {"bad"} and out.nodes.filter("kind = 'list'").count() == 1 and by_id(out.nodes)["n0"].applied == ["normalize", "lists"]
    with pytest.raises(PermissionError):
        run_pipeline(df, (Operator("drop", lambda t: t.drop("conf")),))
    held = Operator("greedy", lambda t: t.withColumn("conf", F.lit(0.1)).withColumn("title", F.lit("x")), writes=("title",))
    assert {(r.conf, r.title) for r in run_pipeline(df, (held,)).nodes.collect()} == {(1.0, "x")}


def test_layout_does_not_matter(spark):
    df = tree(spark, ["• one", "• two", "Note: x", "Figure 1-2 y", {"text": "", "kind": "figure"}])
    one = a.captions(a.callouts(a.lists(df)))
    two = a.captions(a.callouts(a.lists(df.orderBy(F.desc("path")).repartition(3))))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_runner_leaves_the_last_table_alone(spark):
    def folders():
        return set(glob.glob(f"{storage.shared_folder(spark)}/quire-{spark.sparkContext.applicationId}/*"))

    df, before = tree(spark, ["• one", "• two", "Note: x", "Figure 1-2 y"]), folders()
    out = run_pipeline(df, DEFAULT)
    assert [f.split("/")[-1].rsplit("-", 1)[0] for f in folders() - before] == [DEFAULT[-1].name] and out.nodes.count() == df.count() + 1


def test_runner_leaves_no_shuffle_files(spark):
    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    disk, settings = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.getAll
    df = tree(spark, ["• one", "• two", "Note: x", "Figure 1-2 y"])
    before = files()
    run_pipeline(df, (Operator("once", lambda t: t.dropDuplicates(["doc_id", "node_id"])),))
    for _ in range(10):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.getAll == settings


def test_runner_takes_documents_in_parts(spark):
    def folders():
        return set(glob.glob(f"{storage.shared_folder(spark)}/quire-{spark.sparkContext.applicationId}/*"))

    rows = [r.asDict() | {"doc_id": f"d{k}"} for k in range(12) for r in tree(spark, ["• one", "• two", "Note: x", "Figure 1-2 y", "prose"][: 2 + k % 4]).collect()]
    df, seen = nodes(spark, rows), []

    def look(t):
        seen.append({r.doc_id for r in t.select("doc_id").distinct().collect()})
        return t

    def fail(t):
        if len(seen) > 4:
            raise ValueError("late")
        return look(t)

    whole, before = run_pipeline(df, DEFAULT[:4]).nodes, folders()
    out = run_pipeline(df, DEFAULT[:4], parts=3)
    assert sorted(map(str, out.nodes.collect())) == sorted(map(str, whole.collect())) and len(folders() - before) == 3
    out = run_pipeline(df, (Operator("look", look), Operator("fail", fail)), isolate=True, parts=3)  # fails at the last part
    assert [len(s) for s in seen[:3]] != [12] * 3 and sum(map(len, seen[:3])) == 12 and set().union(*seen[:3]) == {f"d{k}" for k in range(12)}
    assert out.failed == {"fail": "late"} and {tuple(r.applied) for r in out.nodes.collect()} == {("look",)} and out.nodes.count() == df.count()
    assert parts_for(0) == 1 and parts_for(600, 256) == 3 and parts_for(10**6, 256) == 8
