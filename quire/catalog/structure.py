"""Queries on trees, graphs and chunks, over documents whose lines are the blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.catalog.base import LINES, filled, line_nodes, lines, number, table
from quire.functions.text import token_estimate
from quire.model import CONTAINER, live
from quire.operators import analyzers, chunks, evaluation, graph, review, rules
from quire.plans.runner import DEFAULT, parts_for, run_pipeline
from quire.sinks import documents as sink
from quire.sources import files
from quire.storage import n_bytes


def _doc():
    return F.col("doc_id").cast("long").alias("doc_id")


def main_flow_edges(spark, sf_dir):
    edges = analyzers.main_flow(line_nodes(spark, sf_dir))
    return edges.select(_doc(), number("source_id").alias("source"), number("target_id").alias("target"), "track", "confidence")


def page_fill(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.when(F.col("n") % 7 == 2, F.floor(F.col("n") / 7).cast("int"))).filter("kind = 'paragraph'")
    return analyzers.page_fill(nodes).select(_doc(), number().alias("n"), "page")


def _levels(spark, sf_dir):
    level = F.when(F.col("n") % 3 == 0, ((F.col("n") * 4 + F.col("doc_id")) % 5 + 1).cast("int"))
    return lines(spark, sf_dir).select(F.col("doc_id"), "n", level.alias("level"))


def heading_tree(spark, sf_dir):
    return files._nest(_levels(spark, sf_dir)).select("doc_id", "n", "level", "parent_n")


def _headings_as_nodes(spark, sf_dir):
    rows = _levels(spark, sf_dir).filter("level is not null")
    return filled(rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws("/", F.col("doc_id").cast("string"), "n").alias("node_id"), F.array("n").alias("path"), F.lit(CONTAINER).alias("kind"), "level"))


def continuation_edges(spark, sf_dir):
    edges = analyzers.continuation_edges(_headings_as_nodes(spark, sf_dir))
    return edges.select(_doc(), number("source_id").alias("source"), number("target_id").alias("target"))


def heading_violations(spark, sf_dir):
    rows = analyzers.heading_violations(_headings_as_nodes(spark, sf_dir)).filter("attrs['heading_violation'] = 'true'")
    return rows.select(_doc(), number().alias("n"), "conf")


def html_heading_tree(spark, sf_dir):
    return files.html_headings(table(spark, sf_dir, "pages")).select(F.col("doc_id").cast("long").alias("page_id"), "n", "level", F.sha2("title", 256).alias("title_hash"), "parent_n")


def list_runs(spark, sf_dir):
    text = F.concat(F.when(F.col("n") % 8 < 3, "• ").when(F.col("n") % 8 == 5, "1. ").when(F.col("n") % 8 == 6, "2) ").otherwise(""), "line")
    nodes = analyzers.lists(line_nodes(spark, sf_dir, text))
    made = nodes.filter("kind = 'list'").select("doc_id", F.col("node_id").alias("id"), F.col("attrs")["list_style"].alias("style"))
    items = nodes.filter("kind = 'list_item'").select("doc_id", F.col("parent_id").alias("id"), number().alias("n"))
    return items.join(made, ["doc_id", "id"]).groupBy("doc_id", "id", "style").agg(F.min("n").alias("first"), F.count("*").alias("items")).select(_doc(), "first", "items", "style")


def heading_blocks(spark, sf_dir):
    size = F.when(F.col("n") % 11 == 0, 22.0).when(F.col("n") % 5 == 0, 18.0).when(F.col("n") % 4 == 0, 15.5).otherwise(12.0)
    nodes = analyzers.headings(line_nodes(spark, sf_dir, F.concat(F.lit("Part "), "line"), font_size=size))
    return nodes.filter("kind = 'container' and size(path) > 1").select(_doc(), number().alias("n"), "level", number("parent_id").alias("parent"))


def footnote_blocks(spark, sf_dir):
    text = F.concat(F.when(F.col("n") % 4 == 0, "¹ ").when(F.col("n") % 4 == 1, "3. ").otherwise(""), "line")
    size, low = F.when(F.col("n") % 3 == 0, 8.5).otherwise(12.0), F.when(F.col("n") % 2 == 0, 0.9).otherwise(0.3)
    nodes = analyzers.footnotes(line_nodes(spark, sf_dir, text, font_size=size, y0=low))
    return nodes.filter("kind = 'footnote'").select(_doc(), number().alias("n"), F.col("attrs")["marker"].alias("marker"))


def caption_targets(spark, sf_dir):
    kind = F.when(F.col("n") % 9 == 4, "caption").when(F.col("n") % 5 == 0, "figure").when(F.col("n") % 7 == 1, "table").otherwise("paragraph")
    nodes = line_nodes(spark, sf_dir, kind=kind, attrs=F.when(F.col("n") % 9 == 4, F.create_map(F.lit("target_type"), F.when(F.col("n") % 2 == 0, "figure").otherwise("table"))))
    return analyzers.link_captions(nodes).select(_doc(), number("caption_id").alias("caption"), number("target_id").alias("target"))


def toc_sections(spark, sf_dir):
    """Contents at both ends of a document of 100 pages; each line of a page of five, pages jump by 3 at every 20th line."""
    text = F.when(F.col("n") % 10 < 6, F.concat(F.lit("Part of "), "line", F.lit(" 12"))).otherwise(F.lit("Plain text without a page."))
    page = (F.floor(F.col("n") / 5) + 3 * F.floor(F.col("n") / 20)).cast("int")
    nodes = analyzers.classify_blocks(line_nodes(spark, sf_dir, text, page=page))
    entries = nodes.filter("kind = 'toc_entry'").groupBy("doc_id", "parent_id").agg(F.min(F.element_at("path", -1)).alias("first"), F.count("*").alias("entries"), F.round(F.max("cls_conf"), 6).alias("confidence"))
    return entries.select(_doc(), "first", "entries", "confidence")


def table_blocks(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.floor(F.col("n") / 40).cast("int"), x0=F.lit(0.1), x1=F.lit(0.4), y0=(F.col("n") % 40) * 0.02 + F.when(F.col("n") % 13 == 0, 0.012).otherwise(0.0), y1=(F.col("n") % 40) * 0.02 + 0.015)
    return analyzers.table_runs(nodes).groupBy("doc_id", "page", "run").agg(F.count("*").alias("rows"), F.min(number()).alias("first")).select(_doc(), "page", "run", "rows", "first")


def diagram_regions(spark, sf_dir):
    text = F.when(F.col("n") % 30 == 29, "Figure 2-11 Modes").when(F.col("n") % 3 == 0, F.concat(F.lit("box "), F.col("n").cast("string"))).otherwise(F.concat(F.lit("Some running text here "), F.col("line")))
    x = (F.col("n") % 5) * 0.1
    nodes = analyzers.diagrams(line_nodes(spark, sf_dir, text, page=F.floor(F.col("n") / 30).cast("int"), x0=x, x1=x + 0.2, y0=(F.col("n") % 30) * 0.03, y1=(F.col("n") % 30) * 0.03 + 0.02))
    made = nodes.filter("kind = 'diagram'")
    return made.select(_doc(), "page", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def bibliography_blocks(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir).withColumn("title", F.when((F.col("kind") == CONTAINER) & (F.col("doc_id").cast("long") % 5 == 0), "References").otherwise(F.col("title")))
    return analyzers.bibliography(nodes).filter("kind = 'bib_entry'").groupBy("doc_id").agg(F.count("*").alias("entries")).select(_doc(), "entries")


def title_page_scores(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.floor(F.col("n") / 4).cast("int")).filter("kind = 'paragraph'")
    return analyzers.title_scores(nodes).select(_doc(), "page", F.col("score").cast("long").alias("score"), F.col("long").alias("is_long"), "strong")


def table_like_pages(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, F.when(F.col("n") % 2 == 0, F.concat(F.col("n").cast("string"), F.lit(" 100 20%"))).otherwise(F.col("line")), page=F.floor(F.col("n") / 8).cast("int")).filter("kind = 'paragraph'")
    return analyzers.table_pages(nodes).select(_doc(), "page")


def rebuilt_pages(spark, sf_dir):
    """Pages of six lines by turns as contents, title, diagram and table, and the contents asked for twice."""
    text = F.concat(F.lit("Section "), F.col("n").cast("string"), F.lit(" A title .... "), (F.col("n") + 3).cast("string"), F.lit(" 2.1 More "), (F.col("n") + 4).cast("string"))
    nodes = line_nodes(spark, sf_dir, text, page=F.floor(F.col("n") / 6).cast("int"))
    role = F.element_at(F.array(*(F.lit(r) for r in ("toc", "title", "diagram", "table"))), F.col("page") % 4 + 1)
    roles = nodes.filter("page is not null").select("doc_id", "page", role.alias("role")).distinct()
    out = review.rebuild_pages(review.rebuild_pages(nodes, roles), roles.filter("role = 'toc'"))
    kind = F.when(F.col("semantic_type") == "toc", "toc").otherwise(F.col("kind"))
    return out.filter("page is not null").groupBy("doc_id", "page").agg(
        F.count_if(kind == "toc").alias("contents"), F.count_if((F.col("kind") == "toc_entry") & (F.col("conf") == 0.95)).alias("entries"), F.sum(F.when(F.col("kind") == "toc_entry", F.col("attrs")["target_page"].cast("long"))).alias("targets"), F.sum(F.when(F.col("kind") == "toc_entry", F.col("attrs")["level"].cast("long"))).alias("levels"),
        F.count_if(F.col("kind") == "title_page").alias("titles"), F.count_if(F.col("kind") == "diagram").alias("diagrams"), F.count_if("is_tombstoned").alias("tombstoned"), F.count_if(F.col("attrs")["table_cell"] == "true").alias("cells"),
    ).select(_doc(), "page", "contents", "entries", "targets", "levels", "titles", "diagrams", "tombstoned", "cells")


def page_groups(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.when(F.col("n") % 9 < 7, F.floor(F.col("n") / 3).cast("int"))).filter("kind = 'paragraph'")
    return analyzers.page_groups(nodes).select(_doc(), number().alias("n"), F.col("page_group").cast("long").alias("page_group"))


def page_texts(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.floor(F.col("n") / 6).cast("int"), is_tombstoned=F.col("n") % 5 == 0)
    return rules.page_texts(nodes).select(_doc(), "page", F.sha2("text", 256).alias("text_hash"))


def live_counts(spark, sf_dir):
    return evaluation.live_node_counts(line_nodes(spark, sf_dir, is_tombstoned=F.col("n") % 5 == 0)).select(_doc(), "n")


def page_ranges(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.floor(F.col("n") / 6).cast("int"), is_tombstoned=F.col("n") % 5 == 0)
    return evaluation.page_ranges(nodes).select(_doc(), "first_page", "last_page")


def _nested(spark, sf_dir):
    """Twelve containers inside each other a document, every fifth without a title; line n is in container n % 12. Every fifth line, and container 7 of every third document, is tombstoned."""
    deep = lambda k: F.array_repeat(F.lit(0), (k + 1).cast("int"))
    at = F.concat(F.lit("c"), F.col("k").cast("string"))
    boxes = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    boxes = boxes.select(F.col("doc_id").cast("string").alias("doc_id"), at.alias("node_id"), F.when(F.col("k") > 0, F.concat(F.lit("c"), (F.col("k") - 1).cast("string"))).alias("parent_id"), deep(F.col("k")).alias("path"), F.lit("container").alias("kind"), F.when(F.col("k") % 5 > 0, F.concat(F.lit("t"), F.col("k").cast("string"))).alias("title"), ((F.col("doc_id") % 3 == 0) & (F.col("k") == 7)).alias("is_tombstoned"))
    rows = lines(spark, sf_dir).withColumn("k", F.col("n") % 12)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("n/"), F.col("n").cast("string")).alias("node_id"), at.alias("parent_id"), F.concat(deep(F.col("k")), F.array(F.col("n") + 1)).alias("path"), F.array("line").alias("spans"), F.floor(F.col("n") / 6).cast("int").alias("page"), (F.col("n") % 5 == 0).alias("is_tombstoned"))
    return filled(boxes).unionByName(filled(rows))


def nested_page_ranges(spark, sf_dir):
    return evaluation.page_ranges(_nested(spark, sf_dir)).select(_doc(), F.substring("node_id", 2, 9).cast("int").alias("level"), "first_page", "last_page")


def nested_sections(spark, sf_dir):
    rows = chunks.section_paths(_nested(spark, sf_dir)).filter("node_id LIKE 'n/%'")
    return rows.select(_doc(), number().alias("n"), F.array_join("sections", " > ").alias("sections"))


def nested_chunks(spark, sf_dir):
    """Chunks of lines in the order of the tree; a chunk's header shows all its sections."""
    nodes = _nested(spark, sf_dir).filter(~F.col("node_id").startswith("n/") | F.get("spans", F.lit(0)).rlike(r"[A-Za-z]"))
    rows = chunks.build_chunks(nodes, _docs(spark, sf_dir))
    return rows.groupBy("doc_id", F.regexp_extract("header", r"\| (t[^|]*) \|", 1).alias("sections")).agg(F.sum(F.size("node_ids")).alias("nodes"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")).select(_doc(), "sections", "nodes", chunks.page_list(F.col("pages")).alias("pages"))


def _leaves(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select(
        "doc_id", F.array("n").alias("path"), F.concat_ws("/", F.col("doc_id").cast("string"), "n").alias("node_id"), F.floor(F.col("n") / 25).cast("string").alias("section"), (F.col("n") % 17 == 16).alias("is_atomic"), F.greatest(F.lit(1), token_estimate(F.col("line"))).alias("tokens")
    )


def chunk_pack(spark, sf_dir):
    return chunks.pack(_leaves(spark, sf_dir)).select("doc_id", number().alias("n"), "chunk")


def chunk_links(spark, sf_dir):
    packed = chunks.pack(_leaves(spark, sf_dir)).groupBy("doc_id", "chunk").agg(F.sum("tokens").cast("long").alias("tokens"))
    order = Window.partitionBy("doc_id").orderBy("chunk")
    return packed.select("doc_id", "chunk", "tokens", F.lag("chunk").over(order).alias("prev"), F.lead("chunk").over(order).alias("next"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Book "), "source").alias("title"))


def _chunks(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, page=F.floor(F.col("n") / 20).cast("int"))
    return chunks.build_chunks(nodes, _docs(spark, sf_dir))


def semantic_chunks(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    return rows.select(_doc(), "chunk", "chunk_type", "header", F.sha2("text", 256).alias("text_hash"), F.col("tokens").cast("long").alias("tokens"))


def instruction_dataset(spark, sf_dir):
    return chunks.instruction_dataset(_chunks(spark, sf_dir)).select("chunk_id", "instruction", F.sha2("input", 256).alias("input_hash"), F.sha2("output", 256).alias("output_hash"))


def qa_dataset(spark, sf_dir):
    return chunks.qa_dataset(_chunks(spark, sf_dir), _docs(spark, sf_dir)).select("chunk_id", "question", F.sha2("answer", 256).alias("answer_hash"))


def chunk_manifest(spark, sf_dir):
    return chunks.manifest(_chunks(spark, sf_dir)).select(_doc(), F.get_json_object("manifest", "$.total_chunks").cast("long").alias("total_chunks"))


def breadcrumb_header(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sections = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    pages = F.array((F.col("doc_id") % 7).cast("int"), F.lit(12))
    return docs.select("doc_id", chunks.breadcrumb(F.concat(F.lit("Book "), "source"), sections, pages).alias("header"))


def kg_upsert(spark, sf_dir):
    """A user's events of a type are updates of one edge: the last value is its confidence."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_id"), F.concat(F.lit("type:"), "event_type").alias("target_id"), F.lit("did").alias("relation"), F.lit("events").alias("analyzer"), F.col("value").alias("confidence"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"), F.col("event_id").alias("seq"))
    return graph.upsert_edges(rows).select("source_id", "target_id", "confidence", F.col("metadata")["k"].alias("k"), "seq")


def _order_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("has").alias("relation"), F.col("l_orderkey").alias("seq"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size <= 25").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"))


def dangling_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return graph.dangling(_order_edges(spark, sf_dir), nodes, _parts(spark, sf_dir)).groupBy("missing").agg(F.count("*").alias("edges"))


def named_edges(spark, sf_dir):
    edges = graph.named_edges(_order_edges(spark, sf_dir).select("source_id", "target_id"), _parts(spark, sf_dir))
    return edges.groupBy("source_name", "target_name").agg(F.count("*").alias("edges"))


def _talk(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn")
    steps = rows.withColumn("next", F.lead("turn").over(Window.partitionBy("doc_id").orderBy("turn"))).filter("next is not null")
    edges = steps.select("doc_id", F.lit("main_flow").alias("track"), F.col("turn").cast("string").alias("source_id"), F.col("next").cast("string").alias("target_id"), F.lit(0.9).alias("confidence"), F.col("turn").alias("seq"))
    back = steps.select("doc_id", F.lit("main_flow").alias("track"), F.col("next").cast("string").alias("source_id"), F.col("turn").cast("string").alias("target_id"), F.lit(1.0).alias("confidence"), (F.col("turn") + 1000).alias("seq"))
    return rows, edges.unionByName(back)


def reading_sequence(spark, sf_dir):
    """Each turn has a way on and a surer way back; the walk never goes back to what it has seen."""
    rows, edges = _talk(spark, sf_dir)
    roots = rows.groupBy("doc_id").agg(F.min("turn").cast("string").alias("node_id")).select("doc_id", F.lit("main_flow").alias("track"), "node_id")
    return graph.reading_sequence(edges, roots).select(F.col("doc_id").cast("long").alias("conv_id"), F.col("step").cast("long").alias("step"), F.col("node_id").cast("long").alias("turn"))


def refused_steps(spark, sf_dir):
    _, edges = _talk(spark, sf_dir)
    return graph.accept_steps(edges).groupBy("doc_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused")).select(F.col("doc_id").cast("long").alias("conv_id"), "accepted", "refused")


def first_steps(spark, sf_dir):
    _, edges = _talk(spark, sf_dir)
    return graph.first_by_track(edges.withColumn("seq", F.col("doc_id").cast("long") * 10_000 + F.col("seq")), 100).select(F.col("doc_id").cast("long").alias("conv_id"), "source_id", "target_id")


def markdown_blocks(spark, sf_dir):
    mark = F.when(F.col("n") % 6 == 0, F.concat(F.repeat(F.lit("#"), (F.col("n") % 3 + 1).cast("int")), F.lit(" "))).otherwise("")
    made = lines(spark, sf_dir).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("n") % 5 == 4, "").otherwise(F.concat(mark, "line")).alias("l")))).alias("p"))
    docs = made.select("doc_id", F.concat(F.lit("/books/"), "doc_id", F.lit(".md")).alias("source_uri"), F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("text"))
    nodes = files.markdown_nodes(docs)
    return nodes.groupBy("doc_id").agg(F.count_if("kind = 'container'" and F.col("kind") == CONTAINER).alias("containers"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs")).select(_doc(), "containers", "paragraphs")


def text_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("/x/"), "source", F.lit(".txt")).alias("source_uri"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    nodes = files.text_nodes(docs)
    return nodes.filter("kind = 'paragraph'").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.size("spans")).alias("spans")).select(_doc(), "paragraphs", F.col("spans").cast("long").alias("spans"))


def document_json(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir, is_tombstoned=F.col("n") % 5 == 0)
    back = sink.read_document_json(sink.document_json(nodes))
    return back.groupBy("doc_id").agg(F.count("*").alias("nodes")).select(_doc(), "nodes")


def full_texts(spark, sf_dir):
    return sink.full_text(line_nodes(spark, sf_dir, is_tombstoned=F.col("n") % 5 == 0), _docs(spark, sf_dir)).select(_doc(), F.sha2("text", 256).alias("text_hash"))


def latex_documents(spark, sf_dir):
    return sink.latex(line_nodes(spark, sf_dir), _docs(spark, sf_dir)).select(_doc(), F.char_length("tex").alias("chars"))


def detected_kinds(spark, sf_dir):
    """The default pipeline over marked lines: nodes of each kind."""
    text = F.concat(F.when(F.col("n") % 8 < 2, "• ").when(F.col("n") % 8 == 4, "Note: ").when(F.col("n") % 8 == 5, "Figure 1-2 ").otherwise(""), "line")
    nodes = line_nodes(spark, sf_dir, text, page=F.floor(F.col("n") / 20).cast("int"))
    out = run_pipeline(nodes, DEFAULT, parts=parts_for(n_bytes(spark, f"{sf_dir}/documents.parquet")))
    return out.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_tombstoned").alias("tombstoned"))


def translation_queue(spark, sf_dir):
    nodes = line_nodes(spark, sf_dir)
    done = review.translate(review.translatable(nodes).filter(number() % 2 == 0), "ru").select("doc_id", "node_id", "lang")
    return review.to_translate(review.translatable(nodes), done, "ru").groupBy("doc_id").agg(F.count("*").alias("blocks")).select(_doc(), "blocks")


def translation_progress(spark, sf_dir):
    blocks = review.translatable(line_nodes(spark, sf_dir))
    done = review.translate(blocks.filter(number() % 2 == 0), "ru")
    return review.translation_progress(blocks, done, "ru").select(_doc(), "done", "total", "percent")


_ALL = (nested_page_ranges, nested_sections, nested_chunks, main_flow_edges, page_fill, heading_tree, continuation_edges, heading_violations, html_heading_tree, list_runs, heading_blocks, footnote_blocks, caption_targets, toc_sections, table_blocks, diagram_regions, bibliography_blocks, title_page_scores, table_like_pages, rebuilt_pages, page_groups, page_texts, live_counts, page_ranges, chunk_pack, chunk_links, semantic_chunks, instruction_dataset, qa_dataset, chunk_manifest, breadcrumb_header, kg_upsert, dangling_edges, named_edges, reading_sequence, refused_steps, first_steps, markdown_blocks, text_blocks, document_json, full_texts, latex_documents, detected_kinds, translation_queue, translation_progress)
QUERIES = {f.__name__: f for f in _ALL}

LEVELS = "levels AS (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN (n * 4 + doc_id) % 5 + 1 END AS level FROM lines)"
NEST = " ".join(f"max(CASE WHEN level = {k} THEN n END) OVER w AS h{k}," for k in range(1, 7))
PARENT = "greatest(-1, " + ", ".join(f"CASE WHEN level IS NULL OR level > {k} THEN coalesce(h{k}, -1) ELSE -1 END" for k in range(1, 7)) + ")::INT AS parent_n"
PACKED = f"""RECURSIVE {LINES}, leaves AS (SELECT doc_id, n, (n // 25)::VARCHAR AS section, n % 17 = 16 AS atomic, greatest(1, CASE WHEN line = '' THEN 0 ELSE greatest(1, length(line) // 4) END) AS tokens FROM lines),
    packed AS (
        SELECT doc_id, n, section, atomic, tokens AS total, tokens, 0 AS chunk FROM leaves WHERE n = 0
        UNION ALL
        SELECT l.doc_id, l.n, CASE WHEN p.atomic OR l.atomic OR p.section <> l.section OR p.total + l.tokens > 512 THEN l.section ELSE p.section END, l.atomic,
            CASE WHEN p.atomic OR l.atomic OR p.section <> l.section OR p.total + l.tokens > 512 THEN l.tokens ELSE p.total + l.tokens END, l.tokens,
            p.chunk + CASE WHEN p.atomic OR l.atomic OR p.section <> l.section OR p.total + l.tokens > 512 THEN 1 ELSE 0 END
        FROM packed p JOIN leaves l ON l.doc_id = p.doc_id AND l.n = p.n + 1)"""

ORACLE_SQL = {
    "main_flow_edges": f"WITH {LINES}, e AS (SELECT doc_id, n::INT AS source, lead(n) OVER (PARTITION BY doc_id ORDER BY n)::INT AS target FROM lines) SELECT doc_id, source, target, 'main_flow' AS track, 1.0::DOUBLE AS confidence FROM e WHERE target IS NOT NULL",
    "page_fill": f"WITH {LINES} SELECT doc_id, n::INT AS n, last_value(CASE WHEN n % 7 = 2 THEN (n // 7)::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS page FROM lines",
    "heading_tree": f"WITH {LINES}, {LEVELS}, h AS (SELECT doc_id, n, level, {NEST[:-1]} FROM levels WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, n::INT AS n, level::INT AS level, {PARENT} FROM h",
    "continuation_edges": f"WITH {LINES}, {LEVELS}, e AS (SELECT doc_id, lag(n) OVER (PARTITION BY doc_id, level ORDER BY n)::INT AS source, n::INT AS target FROM levels WHERE level IS NOT NULL) SELECT * FROM e WHERE source IS NOT NULL",
    "heading_violations": f"WITH {LINES}, {LEVELS}, e AS (SELECT doc_id, n::INT AS n, level, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS was FROM levels WHERE level IS NOT NULL) SELECT doc_id, n, 0.5::DOUBLE AS conf FROM e WHERE was > 0 AND level > was + 1",
    "html_heading_tree": f"""WITH t AS (SELECT page_id AS doc_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS tags FROM pages), levels AS (
            SELECT doc_id, generate_subscripts(tags, 1) - 1 AS n, unnest(tags) AS tag FROM t), lv AS (SELECT doc_id, n, regexp_extract(tag, '(?i)^<h([1-6])', 1)::INT AS level, replace(regexp_replace(tag, '(?s)<[^>]*>', '', 'g'), '&amp;', '&') AS title FROM levels),
            h AS (SELECT doc_id, n, level, trim(title) AS title, {NEST[:-1]} FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id AS page_id, n::INT AS n, level, sha256(title) AS title_hash, {PARENT} FROM h""",
    "list_runs": f"""WITH {LINES}, m AS (SELECT doc_id, n, CASE WHEN n % 8 < 3 THEN '• ' WHEN n % 8 = 5 THEN '1. ' WHEN n % 8 = 6 THEN '2) ' ELSE '' END || line AS l FROM lines),
            k AS (SELECT *, CASE WHEN regexp_matches(l, '^\\s*[•·‣∙◦▪▫■□●○*\\-–—]\\s+') THEN 'bullet' WHEN regexp_matches(l, '^\\s*\\d{{1,3}}[.)]\\s+') THEN 'ordered' WHEN regexp_matches(l, '^\\s*(?i:[ivxlcdm]{{2,}})[.)]\\s+') THEN 'roman' WHEN regexp_matches(l, '^\\s*(?i:[a-zа-я])[.)]\\s+') THEN 'alpha' END AS style FROM m),
            g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, style IS NULL ORDER BY n) AS run FROM k),
            c AS (SELECT doc_id, run, style, count(*) AS c, min(n) AS f FROM g WHERE style IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, run, sum(c) AS items, min(f) AS first, arg_min(style, -c * 1000000 + f) AS style FROM c GROUP BY ALL)
        SELECT doc_id, first::INT AS first, items::BIGINT AS items, style FROM b WHERE items >= 2""",
    "heading_blocks": f"""WITH {LINES}, s AS (SELECT doc_id, n, CASE WHEN n % 11 = 0 THEN 22.0 WHEN n % 5 = 0 THEN 18.0 WHEN n % 4 = 0 THEN 15.5 ELSE 12.0 END::DOUBLE AS size, 'Part ' || line AS t FROM lines),
            b AS (SELECT doc_id, size, count(*) AS c, min(n) AS f FROM s GROUP BY ALL), body AS (SELECT doc_id, arg_min(size, -c * 1000000 + f) * 1.25 AS line FROM b GROUP BY doc_id),
            levels AS (SELECT doc_id, n, CASE WHEN size >= line AND length(trim(t)) BETWEEN 3 AND 199 THEN CASE WHEN size / line >= 1.4 THEN 1 WHEN size / line >= 1.15 THEN 2 ELSE 3 END END AS level FROM s JOIN body USING (doc_id)),
            h AS (SELECT doc_id, n, level, {NEST[:-1]} FROM levels WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), p AS (SELECT doc_id, n, level, {PARENT} FROM h WHERE level IS NOT NULL)
        SELECT doc_id, n::INT AS n, level::INT AS level, CASE WHEN parent_n >= 0 THEN parent_n END AS parent FROM p""",
    "footnote_blocks": f"""WITH {LINES}, s AS (SELECT doc_id, n, CASE WHEN n % 4 = 0 THEN '¹ ' WHEN n % 4 = 1 THEN '3. ' ELSE '' END || line AS l, CASE WHEN n % 3 = 0 THEN 8.5 ELSE 12.0 END::DOUBLE AS size, n % 2 = 0 AS low FROM lines),
            b AS (SELECT doc_id, size, count(*) AS c, min(n) AS f FROM s GROUP BY ALL), body AS (SELECT doc_id, arg_min(size, -c * 1000000 + f) AS body FROM b GROUP BY doc_id), h AS (SELECT *, regexp_extract(l, '^\\s*(?:[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\\d{{1,3}}[.)]|[*†‡§¶])\\s+', 0) AS head FROM s JOIN body USING (doc_id))
        SELECT doc_id, n::INT AS n, trim(head) AS marker FROM h WHERE head <> '' AND low AND size < body * 0.85::DOUBLE""",
    "caption_targets": f"""WITH {LINES}, k AS (SELECT doc_id, n, CASE WHEN n % 9 = 4 THEN 'caption' WHEN n % 5 = 0 THEN 'figure' WHEN n % 7 = 1 THEN 'table' END AS kind FROM lines),
            p AS (SELECT c.doc_id, c.n AS caption, t.n AS target, row_number() OVER (PARTITION BY c.doc_id, c.n ORDER BY abs(c.n - t.n), t.n) AS r FROM k c JOIN k t ON c.doc_id = t.doc_id AND t.kind = CASE WHEN c.n % 2 = 0 THEN 'figure' ELSE 'table' END WHERE c.kind = 'caption')
        SELECT doc_id, caption::INT AS caption, target::INT AS target FROM p WHERE r = 1""",
    "diagram_regions": f"""WITH {LINES}, t AS (SELECT doc_id, n, n // 30 AS page, CASE WHEN n % 30 = 29 THEN 'c' WHEN n % 3 = 0 THEN 'l' END AS k, (n % 5) * 0.1::DOUBLE AS x, (n % 30) * 0.03::DOUBLE AS y FROM lines),
            g AS (SELECT doc_id, page, bool_or(k = 'c') AS cap, count(*) FILTER (k IS NOT NULL) AS c, min(x) FILTER (k IS NOT NULL) AS x0, min(y) FILTER (k IS NOT NULL) AS y0, max(x + 0.2::DOUBLE) FILTER (k IS NOT NULL) AS x1, max(y + 0.02::DOUBLE) FILTER (k IS NOT NULL) AS y1 FROM t GROUP BY ALL)
        SELECT doc_id, page::INT AS page, round(greatest(0, x0 - 0.05::DOUBLE), 6) AS x0, round(greatest(0, y0 - 0.03::DOUBLE), 6) AS y0, round(least(1, x1 + 0.17::DOUBLE), 6) AS x1, round(least(1, y1 + 0.03::DOUBLE), 6) AS y1 FROM g WHERE cap AND c >= 6""",
    "bibliography_blocks": f"WITH {LINES} SELECT doc_id, count(*) AS entries FROM lines WHERE doc_id % 5 = 0 AND length(trim(line)) >= 10 GROUP BY doc_id",
    "table_like_pages": f"""WITH {LINES}, t AS (SELECT doc_id, n, n // 8 AS page, CASE WHEN n % 2 = 0 THEN n || ' 100 20%' ELSE line END AS l FROM lines),
            u AS (SELECT *, length(regexp_replace(trim(l), '[^0-9]', '', 'g')) AS d, length(trim(l)) AS s FROM t),
            g AS (SELECT doc_id, page, count(*) AS c, count(*) FILTER (s BETWEEN 1 AND 40 AND d >= 1 AND d / s >= 0.3) AS num, count(*) FILTER (s <= 40) AS short, lower(string_agg(trim(l), ' ' ORDER BY n)) AS a FROM u GROUP BY ALL)
        SELECT doc_id, page::INT AS page FROM g WHERE c >= 5 AND (regexp_matches(a, 'table | analysis of| cost of |monthly use') OR num / c >= 0.35 OR short / c >= 0.7)""",
    "rebuilt_pages": f"""WITH {LINES}, p AS (SELECT doc_id, (n // 6)::INT AS page, count(*) AS c, sum(n) AS s FROM lines GROUP BY ALL), r AS (SELECT *, page % 4 AS r FROM p)
        SELECT doc_id, page, CASE WHEN r = 0 THEN 1 ELSE 0 END::BIGINT AS contents, CASE WHEN r = 0 THEN 2 * c ELSE 0 END AS entries, CASE WHEN r = 0 THEN 2 * s + 5 * c END::BIGINT AS targets, CASE WHEN r = 0 THEN 3 * c END::BIGINT AS levels,
            CASE WHEN r = 1 THEN 1 ELSE 0 END::BIGINT AS titles, CASE WHEN r = 2 THEN 1 ELSE 0 END::BIGINT AS diagrams, CASE WHEN r < 3 THEN c ELSE 0 END AS tombstoned, CASE WHEN r = 3 THEN c ELSE 0 END AS cells FROM r""",
    "page_groups": f"""WITH {LINES}, p AS (SELECT doc_id, n, CASE WHEN n % 9 < 7 THEN n // 3 END AS page FROM lines), c AS (SELECT *, CASE WHEN n = 0 OR page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS new FROM p)
        SELECT doc_id, n::INT AS n, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS page_group FROM c""",
    "page_texts": f"WITH {LINES} SELECT doc_id, (n // 6 + 1)::INT AS page, sha256(string_agg(line, chr(10) ORDER BY n)) AS text_hash FROM lines WHERE n % 5 <> 0 GROUP BY doc_id, n // 6",
    "live_counts": f"WITH {LINES} SELECT doc_id, count(*) FILTER (n % 5 <> 0) + 1 AS n FROM lines GROUP BY doc_id",
    "page_ranges": f"WITH {LINES} SELECT doc_id, min(n // 6) FILTER (n % 5 <> 0)::INT AS first_page, max(n // 6) FILTER (n % 5 <> 0)::INT AS last_page FROM lines GROUP BY doc_id",
    "nested_page_ranges": f"""WITH {LINES}, k AS (SELECT doc_id, unnest(range(0, 12)) AS level FROM documents)
        SELECT k.doc_id, level::INT AS level, min(n // 6)::INT AS first_page, max(n // 6)::INT AS last_page FROM k LEFT JOIN lines l ON l.doc_id = k.doc_id AND n % 12 >= level AND n % 5 <> 0 AND NOT (k.doc_id % 3 = 0 AND n % 12 >= 7) WHERE NOT (k.doc_id % 3 = 0 AND level >= 7) GROUP BY ALL""",
    "nested_sections": f"WITH {LINES} SELECT doc_id, n::INT AS n, array_to_string(list_transform(list_filter(range(0, n % 12 + 1), lambda x: x % 5 > 0), lambda x: 't' || x), ' > ') AS sections FROM lines",
    "nested_chunks": f"""WITH {LINES}, m AS (SELECT doc_id, n, array_to_string(list_transform(list_filter(range(0, n % 12 + 1), lambda x: x % 5 > 0), lambda x: 't' || x), ' > ') AS sections FROM lines WHERE n % 5 <> 0 AND NOT (doc_id % 3 = 0 AND n % 12 >= 7) AND regexp_matches(line, '[A-Za-z]'))
        SELECT doc_id, sections, count(*)::BIGINT AS nodes, '[' || array_to_string(list_sort(list_distinct(list(n // 6 + 1))), ', ') || ']' AS pages FROM m GROUP BY ALL""",
    "chunk_pack": f"WITH {PACKED} SELECT doc_id, n::INT AS n, chunk::INT AS chunk FROM packed",
    "chunk_links": f"WITH {PACKED}, c AS (SELECT doc_id, chunk::INT AS chunk, CAST(sum(tokens) AS BIGINT) AS tokens FROM packed GROUP BY ALL) SELECT doc_id, chunk, tokens, lag(chunk) OVER w AS prev, lead(chunk) OVER w AS next FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)",
    "breadcrumb_header": "SELECT doc_id, '[Context: Book ' || source || CASE WHEN doc_id % 3 = 0 THEN ' | ' || lang || ' > ' || source ELSE '' END || ' | Pages: [' || (doc_id % 7) || ', 12]]' AS header FROM documents",
    "kg_upsert": """SELECT 'user:' || user_id AS source_id, 'type:' || event_type AS target_id, arg_max(value, event_id) AS confidence, arg_max(props->>'$.k', event_id) AS k, min(event_id) AS seq FROM events GROUP BY ALL""",
    "dangling_edges": """WITH e AS (SELECT unnest(['order:' || l_orderkey, 'part:' || l_partkey]) AS missing FROM lineitem), k AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' UNION SELECT 'part:' || p_partkey FROM part WHERE p_size <= 25)
        SELECT missing, count(*) AS edges FROM e WHERE missing NOT IN (SELECT id FROM k) GROUP BY missing""",
    "named_edges": "SELECT left('order:' || l_orderkey, 8) AS source_name, CASE WHEN p_size <= 25 THEN p_name ELSE left('part:' || l_partkey, 8) END AS target_name, count(*) AS edges FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "reading_sequence": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, turn FROM conversations",
    "refused_steps": "SELECT conv_id, count(*) - 1 AS accepted, count(*) - 1 AS refused FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "first_steps": """WITH s AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
            e AS (SELECT conv_id, turn AS a, next AS b, turn AS seq FROM s WHERE next IS NOT NULL UNION ALL SELECT conv_id, next, turn, turn + 1000 FROM s WHERE next IS NOT NULL)
        SELECT conv_id, a::VARCHAR AS source_id, b::VARCHAR AS target_id FROM e ORDER BY conv_id * 10000 + seq LIMIT 100""",
    "markdown_blocks": f"""WITH {LINES}, m AS (SELECT doc_id, n, n % 5 <> 4 AND n % 6 = 0 AND trim(line) <> '' AS h, n % 5 <> 4 AND n % 6 <> 0 AND trim(line) <> '' AS p FROM lines),
            s AS (SELECT *, p AND NOT coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY n), false) AS starts FROM m), f AS (SELECT doc_id, min(n) FILTER (h) AS fh, min(n) FILTER (p) AS fp, count(*) FILTER (h) AS hs, count(*) FILTER (starts) AS ps FROM s GROUP BY doc_id)
        SELECT doc_id, hs + CASE WHEN fp < coalesce(fh, 1000000000) OR (fp IS NULL AND fh IS NULL) THEN 1 ELSE 0 END AS containers, ps AS paragraphs FROM f""",
    "text_blocks": """WITH p AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS p FROM documents)
        SELECT doc_id, count(*) AS paragraphs, CAST(sum(len(list_filter(string_split(trim(p, ' ' || chr(10)), chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS spans FROM p WHERE trim(p, ' ' || chr(10)) <> '' GROUP BY doc_id""",
    "document_json": f"WITH {LINES} SELECT doc_id, count(*) FILTER (n % 5 <> 0) + 1 AS nodes FROM lines GROUP BY doc_id",
    "full_texts": f"WITH {LINES}, t AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) FILTER (line <> '') AS t FROM lines GROUP BY doc_id) SELECT doc_id, sha256('Book ' || source || chr(10) || chr(10) || 'Document ' || doc_id || coalesce(chr(10) || chr(10) || t, '')) AS text_hash FROM documents JOIN t USING (doc_id)",
    "translation_progress": f"WITH {LINES}, c AS (SELECT doc_id, count(*) FILTER (n % 2 = 0 AND length(trim(line)) > 2) AS done, count(*) FILTER (length(trim(line)) > 2) + 1 AS total FROM lines GROUP BY doc_id) SELECT doc_id, done, total, floor(100 * done / total)::INT AS percent FROM c",
    "translation_queue": f"WITH {LINES} SELECT doc_id, count(*) FILTER (n % 2 = 1 AND length(trim(line)) > 2) + 1 AS blocks FROM lines GROUP BY doc_id",
}
