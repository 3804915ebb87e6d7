"""Structure detectors: each takes a node table and returns one.

A node that changes kind keeps its id. What a merge replaces stays, tombstoned with a reason, and the new node stands before the first of its members. Sibling order is
that of path, so nothing is renumbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import markers
from quire.functions.text import classification_confidence, collapse, n_words, normalized, strip
from quire.model import CONTAINER, NODE, PARAGRAPH, PARAGRAPH_LIKE, READING_LEAVES, after, attrs_with, before, is_kind, made_id, text_first, text_joined, text_spaced, with_new
from quire.operators.text_search import holding
from quire.storage import staged

UNTIL = (Window.unboundedPreceding, 0)

HEADING_RATIO, NO_THRESHOLD, LEVEL_1, LEVEL_2 = 1.25, 999.0, 1.4, 1.15
SMALL_RATIO, LOW_ON_PAGE = 0.85, 0.70
TOC_RUN, TOC_JUMP, TOC_SHARE, PAGES = 4, 2, 0.12, 100
TABLE_ROWS, STEP_TOLERANCE, STEP_MIN, OVERLAP, CELL_CHARS, CELL_HEIGHT = 5, 0.008, 0.005, 0.3, 80, 0.04
LABELS, LABEL_WORDS, LABEL_WIDTH, CAPTION_WORDS = 6, 4, 0.30, 10
PAD_RIGHT, PAD_LEFT, PAD = 0.17, 0.05, 0.03
TITLE_SCORE, TITLE_PAGES, TITLE_CHARS, BLANK_CHARS = 3, 3, 150, 2


def _siblings():
    return Window.partitionBy("doc_id", "parent_id").orderBy("path")


def _document():
    return Window.partitionBy("doc_id").orderBy("path")


def _like_input(out: DataFrame) -> DataFrame:
    return out.select(*(F.col(f.name).cast(f.dataType) for f in NODE))


def normalize(nodes: DataFrame) -> DataFrame:
    """White space of each span collapsed; a node whose spans changed has the least confidence of its spans as attr span_confidence."""
    made = F.transform("spans", lambda s: normalized(s))
    low = F.array_min(F.transform(made, lambda m: m["confidence"]))
    out = nodes.withColumn("attrs", attrs_with(span_confidence=low)).withColumn("spans", F.transform(made, lambda m: m["text"]))
    return _like_input(out)


def main_flow(nodes: DataFrame) -> DataFrame:
    """doc_id, source_id, target_id, track, confidence: each leaf to the next in document order; captions and footnotes have tracks of their own."""
    leaves = nodes.filter(is_kind(*READING_LEAVES)).withColumn("_next", F.lead("node_id").over(_document()))
    main = leaves.filter("_next is not null").select("doc_id", F.col("node_id").alias("source_id"), F.col("_next").alias("target_id"), F.lit("main_flow").alias("track"), F.lit(1.0).alias("confidence"))
    captions = nodes.filter((F.col("kind") == "caption") & F.col("attrs")["target_block_id"].isNotNull()).select("doc_id", F.col("attrs")["target_block_id"].alias("source_id"), F.col("node_id").alias("target_id"), F.lit("caption_flow").alias("track"), F.lit(1.0).alias("confidence"))
    notes = nodes.filter(F.col("kind") == "footnote").select("doc_id", F.explode(F.split(F.coalesce(F.col("attrs")["ref_block_ids"], F.lit("")), ",")).alias("source_id"), F.col("node_id").alias("target_id"), F.lit("footnote_flow").alias("track"), F.lit(0.9).alias("confidence"))
    return main.unionByName(captions).unionByName(notes.filter("source_id <> ''"))


def body_sizes(nodes: DataFrame, chosen: Column) -> DataFrame:
    """doc_id, body: the most frequent font size, to a tenth, among the chosen nodes; of equals the one that comes first. A node without a size has 12."""
    size = F.bround(F.coalesce("font_size", F.lit(12.0)), 1)
    counted = nodes.filter(chosen).groupBy("doc_id", size.alias("size")).agg(F.count("*").alias("n"), F.min("path").alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("doc_id", F.col("size").alias("body"))


def headings(nodes: DataFrame) -> DataFrame:
    """Large paragraphs become containers, nested by level; a level that jumps by more than one has the confidence 0.5 and the attr heading_violation.

    The new parent of a node is the last heading of a lower level before it among its siblings, or the old parent. A root with a nested container stays as it is.
    """
    depth1 = F.size("path") == 2
    plain = is_kind(*PARAGRAPH_LIKE) & ~F.coalesce("is_mono", F.lit(False))
    sizes = body_sizes(nodes, plain & depth1).withColumn("_line", F.col("body") * HEADING_RATIO).drop("body")
    rows = nodes.join(sizes, "doc_id", "left").withColumn("_line", F.coalesce("_line", F.lit(NO_THRESHOLD)))
    nested = nodes.filter((F.col("kind") == CONTAINER) & (F.size("path") > 1)).select("doc_id", F.get("path", F.lit(0)).alias("_root")).distinct().withColumn("_nested", F.lit(True))
    rows = rows.withColumn("_root", F.get("path", F.lit(0))).join(nested, ["doc_id", "_root"], "left")
    text = strip(text_spaced())
    big = plain & depth1 & F.col("_nested").isNull() & (F.coalesce("font_size", F.lit(12.0)) >= F.col("_line"))
    is_heading = big & F.char_length(text).between(3, 199) & text.rlike(r"\p{L}")
    ratio = F.coalesce("font_size", F.lit(12.0)) / F.col("_line")
    level = F.when(is_heading, F.when(ratio >= LEVEL_1, 1).when(ratio >= LEVEL_2, 2).otherwise(3))
    rows = rows.withColumn("_level", level).withColumn("_h", F.col("_level").isNotNull())
    frame = Window.partitionBy("doc_id", "_root").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("_level") == k, F.struct("path", "node_id"))).over(frame) for k in (1, 2, 3)}
    for k, c in last.items():
        rows = rows.withColumn(f"_l{k}", c)
    top = lambda n: F.greatest(*(F.col(f"_l{k}") for k in range(1, n + 1))) if n > 1 else F.col("_l1")
    above = F.when(F.col("_level") == 1, F.lit(None)).when(F.col("_level") == 2, top(1)).when(F.col("_level") == 3, top(2)).otherwise(F.when(depth1, top(3)))
    rows = rows.withColumn("_above", F.when(F.col("_nested").isNull(), above))
    rows = rows.withColumn("parent_id", F.coalesce("_above.node_id", "parent_id"))
    rows = (
        rows.withColumn("title", F.when(F.col("_h"), text).otherwise(F.col("title")))
        .withColumn("kind", F.when(F.col("_h"), CONTAINER).otherwise(F.col("kind")))
        .withColumn("level", F.when(F.col("_h"), F.col("_level")).otherwise(F.col("level")))
        .withColumn("cls_conf", F.when(F.col("_h"), 0.75).otherwise(F.col("cls_conf")))
        .withColumn("conf", F.when(F.col("_h"), F.least("ext_conf", F.lit(0.75))).otherwise(F.col("conf")))
    )
    return heading_violations(_like_input(rows))


def heading_violations(nodes: DataFrame) -> DataFrame:
    """Containers whose level is over that of the container before by more than one."""
    order = Window.partitionBy("doc_id", F.col("kind") == CONTAINER).orderBy("path")
    jump = (F.col("kind") == CONTAINER) & (F.col("_was") > 0) & (F.col("level") > F.col("_was") + 1)
    rows = nodes.withColumn("_was", F.lag("level").over(order)).withColumn("_jump", F.coalesce(jump, F.lit(False)))
    out = rows.withColumn("conf", F.when(F.col("_jump"), 0.5).otherwise(F.col("conf"))).withColumn("attrs", F.when(F.col("_jump"), attrs_with(heading_violation=F.lit("true"))).otherwise(F.col("attrs")))
    return _like_input(out)


def continuation_edges(nodes: DataFrame) -> DataFrame:
    """From the container of the same level before, anywhere in the document, to each container."""
    order = Window.partitionBy("doc_id", "level").orderBy("path")
    rows = nodes.filter(F.col("kind") == CONTAINER).withColumn("_was", F.lag("node_id").over(order)).filter("_was is not null")
    return rows.select("doc_id", F.col("_was").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("continuation_of").alias("relation"), F.lit(1.0).alias("confidence"))


def concept_entities(nodes: DataFrame) -> DataFrame:
    """An entity a container."""
    name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("Section L"), F.col("level")))
    return nodes.filter(F.col("kind") == CONTAINER).select("doc_id", F.col("node_id").alias("entity_id"), name.alias("name"), F.lit("concept_term").alias("entity_type"))


def _runs(rows: DataFrame, belongs: Column, cut: Column | None = None) -> DataFrame:
    """rows with _in (belongs to a run), _run (its number among siblings) and _size (its length)."""
    rows = rows.withColumn("_in", F.coalesce(belongs, F.lit(False)))
    begins = F.col("_in") & ~F.coalesce(F.lag("_in").over(_siblings()), F.lit(False))
    begins = begins if cut is None else begins | (F.col("_in") & F.coalesce(cut, F.lit(False)))
    rows = rows.withColumn("_run", F.when(F.col("_in"), F.sum(begins.cast("int")).over(_siblings().rowsBetween(*UNTIL))))
    return rows.withColumn("_size", F.count("*").over(Window.partitionBy("doc_id", "parent_id", "_run")))


def lists(nodes: DataFrame) -> DataFrame:
    """Runs of two or more live marked paragraphs become a list of items; the mark goes from single ones too. A mixed run has its most frequent style, of equals the first."""
    marked = nodes.withColumn("_m", F.when((F.col("kind") == PARAGRAPH) & ~F.col("is_tombstoned"), markers.list_marker(text_first())))
    rows = _runs(marked, F.col("_m").isNotNull())
    whole = F.col("_in") & (F.col("_size") >= 2)
    stripped = F.transform("spans", lambda s, i: F.when(i == F.array_position("spans", text_first()) - 1, F.col("_m.rest")).otherwise(s))
    rows = rows.withColumn("spans", F.when(F.col("_m").isNotNull(), stripped).otherwise(F.col("spans"))).withColumn("_list", whole)
    runs = rows.filter("_list").groupBy("doc_id", "parent_id", "_run", "_m.style").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.min_by("node_id", "path").alias("id"), F.min_by("page", "path").alias("page"), F.min("ext_conf").alias("ext"))
    best = Window.partitionBy("doc_id", "parent_id", "_run").orderBy(F.desc("n"), "first")
    all_rows = Window.partitionBy("doc_id", "parent_id", "_run")
    runs = runs.withColumn("_k", F.row_number().over(best)).withColumn("_first", F.min(F.struct("first", "id", "page")).over(all_rows)).withColumn("_ext", F.min("ext").over(all_rows)).filter("_k = 1")
    runs = runs.withColumn("_list_id", made_id("list", F.col("_first.id")))
    made = runs.select(
        "doc_id", F.col("_list_id").alias("node_id"), "parent_id", before(F.col("_first.first")).alias("path"), F.lit("list").alias("kind"), F.col("_first.page").alias("page"),
        F.least("_ext", F.lit(0.85)).alias("ext_conf"), F.lit(0.85).alias("cls_conf"), F.least("_ext", F.lit(0.85)).alias("conf"), F.create_map(F.lit("list_style"), F.col("style")).alias("attrs"),
    )
    rows = rows.join(runs.select("doc_id", F.col("parent_id").alias("_pp"), F.col("_run").alias("_rr"), "_list_id", F.col("_first.first").alias("_lp")), (F.col("_rr") == F.col("_run")) & F.col("_pp").eqNullSafe(F.col("parent_id")) & (rows["doc_id"] == runs["doc_id"]) & F.col("_list"), "left").drop(runs["doc_id"])
    item = F.col("_list_id").isNotNull()
    rows = (
        rows.withColumn("kind", F.when(item, "list_item").otherwise(F.col("kind")))
        .withColumn("attrs", F.when(item, attrs_with(marker=F.col("_m.marker"))).otherwise(F.col("attrs")))
        .withColumn("ext_conf", F.when(item, F.least("ext_conf", F.lit(0.85))).otherwise(F.col("ext_conf")))
        .withColumn("cls_conf", F.when(item, 0.85).otherwise(F.col("cls_conf")))
        .withColumn("conf", F.when(item, F.least("ext_conf", F.lit(0.85))).otherwise(F.col("conf")))
        .withColumn("parent_id", F.coalesce("_list_id", "parent_id"))
        .withColumn("path", F.when(item, F.concat(before(F.col("_lp")), F.slice("path", F.size("path"), F.lit(1)))).otherwise(F.col("path")))
    )
    return with_new(_like_input(rows), made)


def _changed(nodes: DataFrame, found: Column, kind: str, conf: float, **attrs: str) -> DataFrame:
    """Live nodes where the struct `found` isn't null change kind and take attrs from its fields."""
    rows = nodes.withColumn("_f", F.when(~F.col("is_tombstoned"), found)).withColumn("_is", F.col("_f").isNotNull())
    rows = (
        rows.withColumn("kind", F.when(F.col("_is"), kind).otherwise(F.col("kind")))
        .withColumn("cls_conf", F.when(F.col("_is"), conf).otherwise(F.col("cls_conf")))
        .withColumn("conf", F.when(F.col("_is"), F.least("ext_conf", F.lit(conf))).otherwise(F.col("conf")))
        .withColumn("attrs", F.when(F.col("_is"), attrs_with(**{k: F.col(f"_f.{v}") for k, v in attrs.items()})).otherwise(F.col("attrs")))
    )
    return _like_input(rows)


def formulas(nodes: DataFrame) -> DataFrame:
    """Confidence 0.75 by font, 0.60 by density. Title pages count as paragraphs here."""
    rows = _changed(nodes, F.when(is_kind(*PARAGRAPH_LIKE), markers.formula(text_joined(), F.col("font_family"))), "formula", 0.60, latex_expression="latex", formula_number="number", formula_signal="signal")
    by_font = (F.col("kind") == "formula") & (F.col("attrs")["formula_signal"] == "font") & (F.col("cls_conf") == 0.60)
    return _like_input(rows.withColumn("cls_conf", F.when(by_font, 0.75).otherwise(F.col("cls_conf"))).withColumn("conf", F.when(by_font, F.least("ext_conf", F.lit(0.75))).otherwise(F.col("conf"))))


def callouts(nodes: DataFrame) -> DataFrame:
    return _changed(nodes, F.when(F.col("kind") == PARAGRAPH, markers.callout(text_first())), "callout", 0.85, callout_kind="kind", severity="severity", label="label", rest="rest")


def footnotes(nodes: DataFrame) -> DataFrame:
    """Marked paragraphs that are small and low on the page; one without size or place is taken as such."""
    body = body_sizes(nodes, is_kind(*PARAGRAPH_LIKE) & ~F.col("is_tombstoned") & F.col("font_size").isNotNull())
    rows = nodes.join(body, "doc_id", "left")
    small = F.col("font_size").isNull() | F.col("body").isNull() | (F.col("font_size") < F.col("body") * SMALL_RATIO)
    low = F.col("y0").isNull() | (F.col("y0") >= LOW_ON_PAGE)
    found = F.when((F.col("kind") == PARAGRAPH) & small & low, markers.footnote_marker(text_first()))
    return _changed(rows, found, "footnote", 0.75, marker="marker", footnote_number="number", rest="rest")


def bibliography(nodes: DataFrame) -> DataFrame:
    """Containers with such a title get the type bibliography, and their own paragraphs of ten or more characters become entries; what is deeper stays."""
    rows = nodes.withColumn("semantic_type", F.when((F.col("kind") == CONTAINER) & (markers.is_bibliography_title(F.col("title")) | (F.col("semantic_type") == "bibliography")), "bibliography").otherwise(F.col("semantic_type")))
    inside = rows.filter("semantic_type = 'bibliography'").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_c"))
    rows = rows.join(inside, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_c")), "left")
    text = strip(text_spaced())
    entry = markers.bib_entry(text)
    flat = F.struct(entry["key"].alias("key"), F.array_join(entry["authors"], "; ").alias("authors"), entry["year"].alias("year"), entry["title"].alias("title"), entry["raw"].alias("raw"))
    found = F.when(is_kind(*PARAGRAPH_LIKE) & F.col("_c").isNotNull() & (F.char_length(text) >= 10), flat)
    return _changed(rows, found, "bib_entry", 0.80, cite_key="key", authors="authors", year="year", bib_title="title", raw_text="raw")


#: Signs of a title or copyright page, with the points they give.
STRONG = r"(?iU)\b(university|college|institute|laborator|press|publisher|inc\.|annual\s+report|thesis|dissertation|proceedings|edition|isbn|copyright)\b"
COPYRIGHT = r"(?iU)(?:©|\bcopyright\b|\bcopr\b)"
PUBLISHER = r"(?iU)\b(?:press|publisher|inc\.|hall|wiley|springer|mcgraw|elsevier|academic|prentice|addison|cambridge|oxford|o'reilly)\b"
ISBN = r"(?iU)\bISBN\b"
EDITION = r"(?iU)\b\d+(?:st|nd|rd|th)\s+edition\b"
YEAR = r"(?U)\b(19|20)\d{2}\b"
NOT_AUTHORS = ("edition", "copyright", "press", "inc", "limited", "ltd")


def _mostly_upper(c: Column) -> Column:
    alpha = F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (alpha >= 3) & (F.char_length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / alpha > 0.7)


def title_points(c: Column) -> Column:
    parts = ((_mostly_upper(c) & (F.char_length(c) > 5), 2), (c.rlike(COPYRIGHT), 3), (c.rlike(PUBLISHER), 2), (c.rlike(ISBN), 3), (c.rlike(EDITION), 2), (c.rlike(YEAR) & (F.char_length(c) < 60), 1))
    return sum((F.when(hit, points).otherwise(0) for hit, points in parts), F.lit(0))


def _is_author(c: Column) -> Column:
    w = F.filter(F.split(collapse(c), " "), lambda x: x != "")
    capital = F.forall(F.filter(w, lambda x: x.rlike(r"^\p{L}")), lambda x: x.rlike(r"^\p{Lu}"))
    other = c.rlike(PUBLISHER) | c.rlike(COPYRIGHT) | c.rlike(ISBN)
    for word in NOT_AUTHORS:
        other = other | F.contains(F.lower(c), F.lit(word))
    return F.size(w).between(2, 6) & capital & ~other & (~_mostly_upper(c) | (F.size(w) <= 4))


def title_scores(nodes: DataFrame) -> DataFrame:
    """doc_id, page, score, long (a text is over 150 characters), strong: of the first pages, by their texts."""
    text = F.when(F.col("kind") == CONTAINER, strip(F.coalesce("title", F.lit("")))).otherwise(strip(text_spaced()))
    rows = nodes.filter(is_kind(CONTAINER, *PARAGRAPH_LIKE) & (F.col("page") < TITLE_PAGES)).withColumn("_t", text).filter("_t <> ''")
    by_page = rows.groupBy("doc_id", "page").agg(F.sum(title_points(F.col("_t"))).alias("points"), F.count("*").alias("n"), F.max(F.char_length("_t")).alias("longest"), F.bool_or(F.col("_t").rlike(STRONG)).alias("strong"))
    bonus = F.when((F.col("n") >= 3) & (F.col("longest") < 80), 1).otherwise(0)
    return by_page.select("doc_id", "page", (F.col("points") + bonus).alias("score"), (F.col("longest") > TITLE_CHARS).alias("long"), "strong")


def title_pages(nodes: DataFrame) -> DataFrame:
    """Texts of two or fewer characters become a cover on page 0, else a blank page. Pages that score become one title page, before their first node."""
    tiny = is_kind(PARAGRAPH) & (F.char_length(strip(text_spaced())) <= BLANK_CHARS)
    rows = (
        nodes.withColumn("_b", tiny)
        .withColumn("kind", F.when(F.col("_b"), F.when(F.col("page") == 0, "title_page").otherwise("blank_page")).otherwise(F.col("kind")))
        .withColumn("attrs", F.when(F.col("_b"), F.when(F.col("page") == 0, F.create_map(F.lit("page_role"), F.lit("cover"))).otherwise(F.create_map().cast("map<string,string>"))).otherwise(F.col("attrs")))
        .withColumn("ext_conf", F.when(F.col("_b"), 1.0).otherwise(F.col("ext_conf")))
        .withColumn("cls_conf", F.when(F.col("_b"), 1.0).otherwise(F.col("cls_conf")))
        .withColumn("conf", F.when(F.col("_b"), 1.0).otherwise(F.col("conf")))
    )
    rows = _like_input(rows)
    good = title_scores(rows).filter((F.col("score") >= TITLE_SCORE) & ~F.col("long") & ((F.col("page") == 0) | F.col("strong"))).select(F.col("doc_id").alias("_d"), F.col("page").alias("_pg"))
    marked = rows.join(good, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_pg")), "left")
    text = F.when(F.col("kind") == CONTAINER, strip(F.coalesce("title", F.lit("")))).otherwise(strip(text_spaced()))
    members = marked.filter(F.col("_d").isNotNull() & is_kind(CONTAINER, *PARAGRAPH_LIKE)).withColumn("_t", text)
    one = F.struct("path", F.col("_t").alias("t"), _is_author(F.col("_t")).alias("author"), (_mostly_upper(F.col("_t")) & (F.char_length("_t") > 5) & ~F.col("_t").rlike(COPYRIGHT)).alias("title"), (F.col("_t").rlike(COPYRIGHT) | F.col("_t").rlike(ISBN)).alias("legal"), F.col("_t").rlike(PUBLISHER).alias("pub"), F.regexp_extract("_t", EDITION, 0).alias("ed"))
    grouped = members.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.when(F.col("_t") != "", one))).alias("m"), F.min(F.when(F.col("kind") != CONTAINER, F.struct("path", "node_id", "parent_id"))).alias("first")).filter("first is not null")
    pick = lambda field: F.transform(F.filter("m", lambda x: x[field]), lambda x: x["t"])
    attrs = F.map_from_arrays(
        F.array(*(F.lit(k) for k in ("book_title", "authors", "publisher", "edition", "page_role"))),
        F.array(F.array_join(pick("title"), " "), F.array_join(F.slice(pick("author"), 1, 5), "; "), F.coalesce(F.try_element_at(pick("pub"), F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(F.filter(F.transform("m", lambda x: x["ed"]), lambda e: e != ""), F.lit(-1)), F.lit("")), F.when(F.exists("m", lambda x: x["legal"]), "copyright").otherwise("title")),
    )
    made = grouped.select(
        "doc_id", made_id("title_page", F.col("first.node_id")).alias("node_id"), F.col("first.parent_id").alias("parent_id"), before(F.col("first.path")).alias("path"), F.lit("title_page").alias("kind"), F.array(F.array_join(F.transform("m", lambda x: x["t"]), "\n")).alias("spans"),
        "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(0.90).alias("ext_conf"), F.lit(0.90).alias("cls_conf"), F.lit(1.0).alias("conf"), attrs.alias("attrs"),
    )
    heads = made.select(F.col("doc_id").alias("_hd"), F.col("page").alias("_hp"), F.col("node_id").alias("_tp"), F.col("path").alias("_hpath"))
    marked = marked.join(heads, (F.col("doc_id") == F.col("_hd")) & (F.col("page") == F.col("_hp")), "left")
    gone = F.col("_tp").isNotNull() & is_kind(*PARAGRAPH_LIKE)
    marked = marked.withColumn("tombstone_reason", F.when(gone, F.concat(F.lit("merged_into_title_page:"), F.col("_tp"))).otherwise(F.col("tombstone_reason"))).withColumn("is_tombstoned", gone | F.col("is_tombstoned")).withColumn("path", F.when(gone & (before(F.col("path")) == F.col("_hpath")), after(F.col("path"))).otherwise(F.col("path")))
    return with_new(_like_input(marked), made)


def table_runs(nodes: DataFrame) -> DataFrame:
    """doc_id, parent_id, page, run, place, node_id: rows of single-column tables.

    Per parent and page, boxes go greedily to the first column whose first box they overlap, and a column's boxes, from top to bottom, to runs of
    steady vertical steps. Both hang on what came before, so each group is folded in Python; a group is a page of a container.
    """
    fits = F.col("x0").isNotNull() & F.col("page").isNotNull() & ((F.col("y1") - F.col("y0")) <= CELL_HEIGHT) & (F.char_length(text_spaced()) <= CELL_CHARS) & is_kind(*PARAGRAPH_LIKE)
    enough = Window.partitionBy("doc_id", "parent_id")
    cells = nodes.filter(fits).withColumn("_n", F.count("*").over(enough)).filter(F.col("_n") >= TABLE_ROWS).select("doc_id", "parent_id", "page", "path", "node_id", "x0", "y0", "x1", "y1")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_p=group["path"].map(tuple)).sort_values("_p")
        columns: list[list] = []
        for row in sorted(group.itertuples(index=False), key=lambda r: r.x0):
            for column in columns:
                width = min(row.x1 - row.x0, column[0].x1 - column[0].x0)
                if width > 0 and (min(row.x1, column[0].x1) - max(row.x0, column[0].x0)) / width >= OVERLAP:
                    column.append(row)
                    break
            else:
                columns.append([row])
        out, number = [], 0
        for column in columns:
            rows = sorted(column, key=lambda r: r.y0)
            run, step = [rows[0]], None
            runs = []
            for last, row in zip(rows, rows[1:]):
                gap = row.y0 - last.y0
                if gap < STEP_MIN:
                    continue
                if step is None or abs(gap - step) < STEP_TOLERANCE:
                    step = gap if step is None else step
                    run.append(row)
                else:
                    runs.append(run)
                    run, step = [row], None
            for run in [*runs, run]:
                if len(run) >= TABLE_ROWS:
                    out += [(r.doc_id, r.parent_id, r.page, number, k, r.node_id) for k, r in enumerate(run)]
                    number += 1
        return pd.DataFrame(out, columns=["doc_id", "parent_id", "page", "run", "place", "node_id"])

    return cells.groupBy("doc_id", "parent_id", "page").applyInPandas(fold, "doc_id string, parent_id string, page int, run int, place int, node_id string")


def tables(nodes: DataFrame) -> DataFrame:
    """Table runs become tables of one column, their rows tombstoned."""
    runs = table_runs(nodes).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("page").alias("_pg"), "run", "place")
    rows = nodes.join(runs, (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_n")), "left")
    gone = F.col("_n").isNotNull()
    cells = rows.filter(gone).groupBy("doc_id", "parent_id", "_pg", "run").agg(F.array_sort(F.collect_list(F.struct("place", text_spaced().alias("t")))).alias("cells"), F.avg("ext_conf").alias("ext"), F.count("*").alias("n"), F.min_by(F.struct("path", "node_id", "x0", "y0", "x1", "y1"), "place").alias("first"))
    cls = F.least(F.lit(0.90), 0.50 + F.col("n") * 0.05)
    made = cells.select(
        "doc_id", made_id("table", F.col("first.node_id")).alias("node_id"), "parent_id", before(F.col("first.path")).alias("path"), F.lit("table").alias("kind"), F.col("_pg").alias("page"), F.col("first.x0").alias("x0"), F.col("first.y0").alias("y0"), F.col("first.x1").alias("x1"), F.col("first.y1").alias("y1"),
        F.col("ext").alias("ext_conf"), cls.alias("cls_conf"), F.least("ext", cls).alias("conf"), F.create_map(F.lit("grid"), F.to_json(F.transform("cells", lambda c: F.array(c["t"])))).alias("attrs"),
    )
    rows = rows.withColumn("path", F.when(gone & (F.col("place") == 0), after(F.col("path"))).otherwise(F.col("path"))).withColumn("is_tombstoned", gone | F.col("is_tombstoned")).withColumn("tombstone_reason", F.when(gone, "merged_into_table").otherwise(F.col("tombstone_reason")))
    return with_new(_like_input(rows), made)


FIGURE_CAPTION, SUB_LABEL = r"(?i)^fig(?:ure|\.)?\s*\d+[-.–]\d+", r"(?iU)^\(?[a-g]\)?\s+\w"


def diagrams(nodes: DataFrame) -> DataFrame:
    """A page with a short figure caption and six or more narrow labels gets a diagram over their padded region; the labels are tombstoned."""
    text = strip(text_spaced())
    rows = nodes.withColumn("_t", text)
    candidates = rows.filter(is_kind(*PARAGRAPH_LIKE) & ~F.col("is_tombstoned") & F.col("page").isNotNull() & F.col("x0").isNotNull() & (F.col("_t") != ""))
    label = ((n_words(F.col("_t")) <= LABEL_WORDS) & ((F.col("x1") - F.col("x0")) <= LABEL_WIDTH)) | F.col("_t").rlike(SUB_LABEL)
    is_caption = F.col("_t").rlike(FIGURE_CAPTION) & (n_words(F.col("_t")) <= CAPTION_WORDS)
    candidates = candidates.withColumn("_label", label)
    one = F.when(F.col("_label"), F.struct("path", F.col("_t").alias("text"), "x0", "y0", "x1", "y1"))
    mine = lambda c: F.when(F.col("_label"), c)
    pages = candidates.groupBy("doc_id", F.col("page").alias("_pg")).agg(
        F.min_by(F.when(is_caption, F.col("_t")), F.when(is_caption, F.col("path"))).alias("caption"), F.count_if("_label").alias("n"), F.min(mine(F.struct("path", "node_id", "parent_id"))).alias("first"),
        F.min(mine(F.col("x0"))).alias("x0"), F.min(mine(F.col("y0"))).alias("y0"), F.max(mine(F.col("x1"))).alias("x1"), F.max(mine(F.col("y1"))).alias("y1"), F.array_sort(F.collect_list(one)).alias("labels"),
    ).filter(F.col("caption").isNotNull() & (F.col("n") >= LABELS))
    made = pages.select(
        "doc_id", made_id("diagram", F.col("first.node_id")).alias("node_id"), F.col("first.parent_id").alias("parent_id"), before(F.col("first.path")).alias("path"), F.lit("diagram").alias("kind"), F.col("_pg").alias("page"),
        F.greatest(F.lit(0.0), F.col("x0") - PAD_LEFT).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - PAD).alias("y0"), F.least(F.lit(1.0), F.col("x1") + PAD_RIGHT).alias("x1"), F.least(F.lit(1.0), F.col("y1") + PAD).alias("y1"),
        F.lit(0.85).alias("ext_conf"), F.lit(0.80).alias("cls_conf"), F.lit(0.80).alias("conf"),
        F.create_map(F.lit("caption_text"), F.col("caption"), F.lit("labels"), F.to_json(F.transform("labels", lambda x: F.struct(x["text"].alias("text"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"))))).alias("attrs"),
    )
    heads = made.select(F.col("doc_id").alias("_hd"), F.col("page").alias("_hp"), F.col("node_id").alias("_dg"), F.col("path").alias("_hpath"))
    labels = candidates.filter("_label").select(F.col("doc_id").alias("_ld"), F.col("node_id").alias("_ln"))
    rows = rows.join(heads, (F.col("doc_id") == F.col("_hd")) & (F.col("page") == F.col("_hp")), "left").join(labels, (F.col("doc_id") == F.col("_ld")) & (F.col("node_id") == F.col("_ln")), "left")
    gone = F.col("_dg").isNotNull() & F.col("_ln").isNotNull()
    rows = rows.withColumn("tombstone_reason", F.when(gone, F.concat(F.lit("absorbed_into_diagram:"), F.col("_dg"))).otherwise(F.col("tombstone_reason"))).withColumn("is_tombstoned", gone | F.col("is_tombstoned")).withColumn("path", F.when(gone & (before(F.col("path")) == F.col("_hpath")), after(F.col("path"))).otherwise(F.col("path")))
    return with_new(_like_input(rows), made)


def link_captions(nodes: DataFrame) -> DataFrame:
    """doc_id, caption_id, target_id: the nearest sibling of the caption's target type by place, of equals the first."""
    rows = nodes.withColumn("_i", F.row_number().over(_siblings()))
    back = Window.partitionBy("doc_id", "parent_id").orderBy(F.desc("path"))
    found = {}
    for target, kinds in (("figure", ("figure", "diagram")), ("table", ("table",))):
        here = F.when(is_kind(*kinds), F.struct("_i", "node_id"))
        found[target] = F.last(here, ignorenulls=True).over(_siblings()), F.last(here, ignorenulls=True).over(back)
        rows = rows.withColumn(f"_{target}_before", found[target][0]).withColumn(f"_{target}_after", found[target][1])
    best = F.lit(None).cast("string")
    for target in found:
        a, b = F.col(f"_{target}_before"), F.col(f"_{target}_after")
        near = F.when(b.isNull() | (F.col("_i") - a["_i"] <= b["_i"] - F.col("_i")), a["node_id"]).otherwise(b["node_id"])
        best = F.when(F.col("attrs")["target_type"] == target, near).otherwise(best)
    rows = rows.filter("kind = 'caption'").select("doc_id", F.col("node_id").alias("caption_id"), best.alias("target_id"))
    return rows.filter("target_id is not null")


def captions(nodes: DataFrame) -> DataFrame:
    """Caption paragraphs become captions with new ids, linked to their targets; containers titled Example N get the type example."""
    found = _changed(nodes, F.when(is_kind(*PARAGRAPH_LIKE), markers.caption(strip(text_spaced()))), "caption", 0.90, target_type="target", label_number="label", caption_text="rest")
    fresh = (F.col("kind") == "caption") & F.col("attrs")["target_block_id"].isNull() & (F.col("cls_conf") == 0.90)
    found = found.withColumn("node_id", F.when(fresh, made_id("caption", F.col("node_id"))).otherwise(F.col("node_id")))
    found = found.withColumn("semantic_type", F.when((F.col("kind") == CONTAINER) & F.col("title").rlike(r"(?i)^Example\s+(\d+[-–.]\d+|\d+)"), "example").otherwise(F.col("semantic_type")))
    links = link_captions(found)
    back = links.join(found.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("path").alias("_path")), (F.col("doc_id") == F.col("_d")) & (F.col("caption_id") == F.col("_n"))).groupBy("doc_id", "target_id").agg(F.max_by("caption_id", "_path").alias("_cap"))
    rows = found.join(links.withColumnRenamed("caption_id", "node_id"), ["doc_id", "node_id"], "left")
    rows = rows.join(back.withColumnRenamed("target_id", "node_id"), ["doc_id", "node_id"], "left")
    rows = rows.withColumn("attrs", F.when(F.col("target_id").isNotNull(), attrs_with(target_block_id=F.col("target_id"))).otherwise(F.col("attrs")))
    rows = rows.withColumn("attrs", F.when(F.col("_cap").isNotNull(), attrs_with(caption_id=F.col("_cap"))).otherwise(F.col("attrs")))
    return _like_input(rows)


def toc_runs(nodes: DataFrame) -> DataFrame:
    """nodes with _in, _run, _size: runs of contents lines among siblings; a jump of over two pages inside a run begins another."""
    line = is_kind(*PARAGRAPH_LIKE) & markers.looks_like_toc(text_spaced())
    rows = _runs(nodes, line)
    inside = Window.partitionBy("doc_id", "parent_id", "_run").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    jump = F.col("_in") & (F.abs(F.col("page") - F.last("page", ignorenulls=True).over(inside)) > TOC_JUMP)
    rows = rows.withColumn("_jump", F.coalesce(jump, F.lit(False)))
    rows = rows.withColumn("_part", F.sum(F.col("_jump").cast("int")).over(Window.partitionBy("doc_id", "parent_id", "_run").orderBy("path")))
    return rows.withColumn("_run", F.when(F.col("_in"), F.struct("_run", "_part"))).withColumn("_size", F.count("*").over(Window.partitionBy("doc_id", "parent_id", "_run")))


def classify_blocks(nodes: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Paragraphs get their confidence; contents runs of four lines or more near either end of the document become a contents container, linked to headings.

    docs: doc_id, page_count; a document without one has 100 pages.
    """
    rows = staged(toc_runs(nodes), "toc-runs")  # read four times below
    long = F.col("_in") & (F.col("_size") >= TOC_RUN)
    titles = nodes.filter((F.col("kind") == CONTAINER) & (F.coalesce("title", F.lit("")) != "")).select("doc_id", F.lower(collapse(F.col("title"))).alias("_title")).distinct()
    left = F.lower(collapse(F.regexp_replace(strip(text_spaced()), markers.PAGE_AT_END, "")))
    lines = staged(rows.filter(long).select("doc_id", "node_id", left.alias("_left")), "toc-lines")
    within = holding(titles, lines, ["doc_id"], "_title", "_title", "node_id", "_left").unionByName(holding(lines, titles, ["doc_id"], "node_id", "_left", "_title", "_title"))
    hits = within.select(F.col("doc_id").alias("_hd"), F.col("node_id").alias("_hn")).distinct()
    member = rows.filter(long).join(hits, (F.col("doc_id") == F.col("_hd")) & (F.col("node_id") == F.col("_hn")), "left")
    runs = member.groupBy("doc_id", "parent_id", "_run").agg(F.avg("page").alias("mean"), F.count("*").alias("n"), F.count("_hn").alias("hits"), F.min_by(F.struct("path", "node_id", "page"), "path").alias("first"))
    pages = F.lit(PAGES)
    if docs is not None:
        runs = runs.join(docs.select("doc_id", "page_count"), "doc_id", "left")
        pages = F.coalesce("page_count", F.lit(PAGES))
    near = F.greatest(F.lit(3), F.floor(pages * TOC_SHARE))
    runs = runs.withColumn("_ok", F.col("mean").isNull() | ~((F.col("mean") > near) & (F.col("mean") < pages - near)))
    runs = runs.withColumn("_conf", F.least(F.lit(0.90), 0.60 + F.col("hits") / F.col("n") * 0.30 + F.col("n") * 0.01)).withColumn("_toc", made_id("toc", F.col("first.node_id")))
    levels = nodes.select(F.col("doc_id").alias("_ld"), F.col("node_id").alias("_ln"), F.col("level").alias("_plevel"))
    good = runs.filter("_ok").join(levels, (F.col("doc_id") == F.col("_ld")) & (F.col("parent_id") == F.col("_ln")), "left")
    made = good.select(
        "doc_id", F.col("_toc").alias("node_id"), "parent_id", before(F.col("first.path")).alias("path"), F.lit(CONTAINER).alias("kind"), (F.coalesce("_plevel", F.lit(0)) + 1).alias("level"), F.lit("Оглавление").alias("title"), F.lit("toc").alias("semantic_type"),
        F.lit(0.85).alias("ext_conf"), F.col("_conf").alias("cls_conf"), F.least(F.lit(0.85), F.col("_conf")).alias("conf"),
    )
    runs_in = good.select(F.col("doc_id").alias("_gd"), F.col("parent_id").alias("_gp"), F.col("_run").alias("_gr"), "_toc", "_conf", F.col("first.path").alias("_fp"))
    rows = rows.join(runs_in, (F.col("doc_id") == F.col("_gd")) & F.col("parent_id").eqNullSafe(F.col("_gp")) & (F.col("_run") == F.col("_gr")), "left")
    in_toc = F.col("_toc").isNotNull()
    entry = markers.toc_entry(text_spaced())
    entries = rows.filter(in_toc).withColumn("_e", entry).select(
        "doc_id", "node_id", F.col("_toc").alias("parent_id"), F.concat(before(F.col("_fp")), F.slice("path", F.size("path"), F.lit(1))).alias("path"), F.lit("toc_entry").alias("kind"), F.array("_e.text").alias("spans"), "page", "x0", "y0", "x1", "y1",
        F.lit(0.85).alias("ext_conf"), F.col("_conf").alias("cls_conf"), F.least(F.lit(0.85), F.col("_conf")).alias("conf"),
        F.map_filter(F.create_map(F.lit("entry_text"), F.col("_e.text"), F.lit("chapter_number"), F.col("_e.number"), F.lit("target_page"), F.col("_e.page").cast("string")), lambda k, v: v.isNotNull()).alias("attrs"),
    )
    anchored = with_new(with_new(nodes.limit(0), entries), made)
    cls = classification_confidence(text_spaced())
    plain = is_kind(*PARAGRAPH_LIKE) & ~(F.col("_in") & (F.col("_size") >= TOC_RUN))
    old = rows.withColumn("cls_conf", F.when(plain, cls).otherwise(F.col("cls_conf"))).withColumn("conf", F.when(plain, F.least("ext_conf", cls)).otherwise(F.col("conf")))
    old = (
        old.withColumn("tombstone_reason", F.when(in_toc, "merged_into_toc").otherwise(F.col("tombstone_reason")))
        .withColumn("path", F.when(in_toc & (F.col("path") == F.col("_fp")), after(F.col("path"))).otherwise(F.col("path")))
        .withColumn("is_tombstoned", in_toc | F.col("is_tombstoned"))
    )
    return link_toc(_like_input(old).unionByName(anchored))


def link_toc(nodes: DataFrame) -> DataFrame:
    """Contents entries get the attr anchor_id of a heading with their number, else with their title; of several the last."""
    lead = r"(?U)^\s*([\d.]+|[A-Za-zА-Яа-я]\.)\s+"
    heads = nodes.filter((F.col("kind") == CONTAINER) & ~F.coalesce(F.col("semantic_type") == "toc", F.lit(False)) & (F.coalesce("title", F.lit("")) != ""))
    number = F.rtrim(F.regexp_extract("title", lead, 1), F.lit("."))
    keys = heads.select("doc_id", "node_id", "path", F.lower(collapse(F.col("title"))).alias("key")).unionByName(heads.select("doc_id", "node_id", "path", number.alias("key")).filter("key <> ''"))
    keys = keys.groupBy("doc_id", "key").agg(F.max_by("node_id", "path").alias("_anchor"))
    text = F.coalesce(F.col("attrs")["entry_text"], F.lit(""))
    rows = nodes.withColumn("_entry", F.col("kind") == "toc_entry")
    rows = rows.withColumn("_k1", F.when(F.col("_entry"), F.rtrim(strip(F.col("attrs")["chapter_number"]), F.lit(".")))).withColumn("_k2", F.when(F.col("_entry"), F.nullif(F.lower(collapse(F.regexp_replace(text, lead, ""))), F.lit(""))))
    for k in ("_k1", "_k2"):
        found = keys.select(F.col("doc_id").alias(f"_d{k}"), F.col("key").alias(f"_x{k}"), F.col("_anchor").alias(f"_a{k}"))
        rows = rows.join(found, (F.col("doc_id") == F.col(f"_d{k}")) & (F.col(k) == F.col(f"_x{k}")), "left")
    anchor = F.coalesce(F.col("attrs")["anchor_id"], F.col("_a_k1"), F.col("_a_k2"))
    return _like_input(rows.withColumn("attrs", F.when(F.col("_entry"), attrs_with(anchor_id=anchor)).otherwise(F.col("attrs"))))


def entities(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions): doc_id, entity_id, name, entity_type, one a type and name in upper case; and doc_id, source_id, entity_id, confidence, start of each mention in the span."""
    spans = nodes.select("doc_id", "node_id", F.posexplode_outer("spans").alias("span", "text")).filter("text <> ''")
    found = spans.select("doc_id", "node_id", "span", F.posexplode(markers.mentions(F.col("text"))).alias("nth", "m")).select("doc_id", "node_id", "span", "nth", "m.*")
    upto = Window.partitionBy("doc_id", "node_id", "span", "type").orderBy("nth")
    found = found.withColumn("start", F.sum(F.col("gap") + F.char_length("name")).over(upto) - F.char_length("name"))
    found = found.withColumn("entity_id", F.sha2(F.concat_ws(":", "doc_id", "type", F.upper("name")), 256))
    once = found.groupBy("doc_id", "entity_id").agg(F.min_by("name", F.struct("node_id", "span", "nth")).alias("name"), F.first("type").alias("entity_type"))
    return once, found.select("doc_id", F.concat_ws(":", "node_id", "span").alias("source_id"), "node_id", "entity_id", F.lit(0.95).alias("confidence"), F.col("start").cast("int").alias("start"))


def table_pages(nodes: DataFrame) -> DataFrame:
    """doc_id, page of pages that look like a table without having one: by words, by numbers, or by short texts."""
    text = strip(F.when(F.col("kind") == CONTAINER, F.coalesce("title", F.lit(""))).otherwise(text_spaced()))
    rows = nodes.filter(F.col("page").isNotNull() & ~F.col("is_tombstoned") & is_kind(CONTAINER, *PARAGRAPH_LIKE)).withColumn("_t", text)
    joined = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "_t"))), lambda x: x["_t"]), " "))
    pages = rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if(markers.looks_numeric(F.col("_t"))).alias("numeric"), F.count_if(F.char_length("_t") <= 40).alias("short"), joined.alias("all"))
    titled = F.col("all").rlike(r"table | analysis of| cost of |monthly use")
    chosen = pages.filter((F.col("n") >= 5) & (titled | (F.col("numeric") / F.col("n") >= 0.35) | (F.col("short") / F.col("n") >= 0.7)))
    has = nodes.filter("kind = 'table'").select("doc_id", "page").distinct()
    return chosen.join(has, ["doc_id", "page"], "left_anti").select("doc_id", "page")


def page_fill(nodes: DataFrame) -> DataFrame:
    """The last page known in document order, for nodes without one."""
    return nodes.withColumn("page", F.last("page", ignorenulls=True).over(_document().rowsBetween(*UNTIL)))


def page_groups(nodes: DataFrame) -> DataFrame:
    """Siblings in a row with the same page share a group number; containers have no page."""
    rows = nodes.withColumn("_pg", F.when(F.col("kind") != CONTAINER, F.col("page")))
    first = F.row_number().over(_siblings()) == 1
    new = first | ~F.lag("_pg").over(_siblings()).eqNullSafe(F.col("_pg"))
    return rows.withColumn("page_group", F.sum(new.cast("int")).over(_siblings())).drop("_pg")


def refine_with_model(nodes: DataFrame, model=None, below: float = 0.60, batch: int = 3) -> DataFrame:
    """Unsure paragraphs go to `model`, an iterator function over pandas frames (batch, node_id, text) that yields (node_id, confidence); without one nothing changes."""
    if model is None:
        return nodes
    unsure = nodes.filter(is_kind(*PARAGRAPH_LIKE) & (F.col("cls_conf") < below) & (strip(text_spaced()) != ""))
    asked = unsure.select(F.floor((F.row_number().over(_document()) - 1) / batch).alias("batch"), "node_id", text_spaced().alias("text"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from model(frames)

    said = asked.mapInPandas(ask, "node_id string, confidence double").withColumn("_said", F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.col("confidence")))).drop("confidence")
    rows = nodes.join(said, "node_id", "left").withColumn("cls_conf", F.coalesce("_said", "cls_conf"))
    return _like_input(rows.withColumn("conf", F.when(F.col("_said").isNotNull(), F.least("ext_conf", "cls_conf")).otherwise(F.col("conf"))))
