"""Retrieval chunks with their context, and what is exported from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip, token_estimate
from quire.model import ATOMIC, CONTAINER, FIGURE_LIKE, live, made_id, text_joined, text_spaced
from quire.storage import staged

MAX_TOKENS = 512
QUIET = ("caption", "blank_page")  # they lend ids, but no text


def chunk_text() -> Column:
    """The text of a node by its kind; parts of lists and tables are in attrs."""
    a, text = F.col("attrs"), strip(text_spaced())
    number = F.concat(F.lit("["), a["formula_number"], F.lit("] "))
    grid = F.array_join(F.transform(F.from_json(a["grid"], "array<array<string>>"), lambda r: F.array_join(r, " | ")), "\n")
    body = F.coalesce(a["rest"], text)
    page = F.concat(F.lit(" … p."), (a["target_page"].try_cast("int") + 1).cast("string"))
    kind = F.col("kind")
    return (
        F.when(kind == "formula", F.concat(F.coalesce(number, F.lit("")), F.coalesce(a["latex_expression"], text)))
        .when(kind == "code", F.coalesce(a["code_text"], text_joined()))
        .when(kind == "table", F.coalesce(grid, text))
        .when(kind.isin(*FIGURE_LIKE), F.concat(F.lit("[Figure: "), F.coalesce(F.nullif(a["alt_text"], F.lit("")), a["caption_id"], F.lit("Image")), F.lit("]")))
        .when(kind == "callout", F.trim(F.concat(F.lit("["), F.upper(F.coalesce(F.nullif(a["label"], F.lit("")), F.initcap(a["callout_kind"]))), F.lit("] "), body)))
        .when(kind == "footnote", F.trim(F.concat(F.lit("[footnote "), F.coalesce(a["marker"], a["footnote_number"], F.lit("")), F.lit("] "), body)))
        .when(kind == "bib_entry", F.coalesce(F.nullif(a["raw_text"], F.lit("")), a["bib_title"], text))
        .when(kind == "toc_entry", F.trim(F.concat(F.concat_ws(" ", a["chapter_number"], F.coalesce(a["entry_text"], text)), F.coalesce(page, F.lit("")))))
        .when(kind.isin(*QUIET), F.lit(""))
        .otherwise(F.array_join(F.filter(F.coalesce("spans", F.array().cast("array<string>")), lambda x: x != ""), "\n"))
    )


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: files and shuffles of ids are some fifty times smaller than the rows in memory, so Spark's sizes would let a table of millions of rows onto the driver."""
    return df.hint("merge")


def list_text(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, text of lists: items joined by line, a bullet or the item's number; a tombstoned item leaves a gap in the numbers."""
    items = nodes.filter("kind = 'list_item'").withColumn("_i", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("path"))).filter(~F.col("is_tombstoned") & (strip(text_spaced()) != ""))
    style = nodes.filter("kind = 'list'").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("attrs")["list_style"].alias("_style"))
    items = items.join(shuffled(style), (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_n")))
    line = F.concat(F.when(F.col("_style").isin("ordered", "alpha", "roman"), F.concat(F.col("_i").cast("string"), F.lit(". "))).otherwise("- "), strip(text_spaced()))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("line")))), lambda x: x["line"]), "\n")
    return items.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(joined.alias("list_text"))


FOLD = 4096  # nodes of a section that are folded as one array


def _starts_by_fold(rows: DataFrame, max_tokens: int) -> DataFrame:
    """doc_id, i: where chunks start in sections of at most FOLD nodes."""
    all_of = F.array_sort(F.collect_list(F.struct("i", F.col("tokens").alias("t"))))
    start = F.struct(F.lit(max_tokens).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        fits = s["sum"] + x["t"] <= max_tokens
        return F.struct(F.when(fits, s["sum"] + x["t"]).otherwise(x["t"]).alias("sum"), F.when(fits, s["starts"]).otherwise(F.concat(s["starts"], F.array(x["i"]))).alias("starts"))

    folded = rows.groupBy("doc_id", "segment").agg(all_of.alias("_all"))
    return folded.select("doc_id", F.explode(F.aggregate("_all", start, step)["starts"]).alias("i"))


def _starts_by_pointers(rows: DataFrame, max_tokens: int) -> DataFrame:
    """doc_id, i: the same for longer sections. Each node points to where the next chunk would start if one started at it; the nodes that can be reached from a section's first are found by doubling the pointers."""
    within = Window.partitionBy("doc_id", "segment").orderBy("before")
    more = F.count("*").over(within.rangeBetween(1, max_tokens))  # those after it that begin within the limit
    step = F.when(F.col("total") > F.col("before") + max_tokens, F.col("i") + F.greatest(more, F.lit(1)))
    jump = staged(rows.withColumn("to", step).select("doc_id", "i", F.when(F.col("to") <= F.col("last"), F.col("to")).alias("to")), "pointers")
    marked = staged(rows.filter("before = 0").select("doc_id", "i"), "starts")
    while not jump.filter("to IS NOT NULL").isEmpty():
        reached = marked.join(shuffled(jump), ["doc_id", "i"]).filter("to IS NOT NULL").select("doc_id", F.col("to").alias("i"))
        marked = staged(marked.unionByName(reached), "starts")
        on = jump.select(F.col("doc_id").alias("_d"), F.col("i").alias("_i"), F.col("to").alias("_to"))
        jump = staged(jump.filter("to IS NOT NULL").join(shuffled(on), (F.col("doc_id") == F.col("_d")) & (F.col("to") == F.col("_i"))).select("doc_id", "i", F.col("_to").alias("to")), "pointers")
    return marked


def pack(leaves: DataFrame, max_tokens: int = MAX_TOKENS, fold: int = FOLD) -> DataFrame:
    """leaves with chunk: its number in the document. leaves: doc_id, path, node_id, section, is_atomic, tokens (1 at least).

    An atomic node is a chunk by itself. Others share one while they have the section of its first node and the sum of their tokens stays within the limit. Where a section's nodes stand together and fit, windows say it all; a longer stretch is
    folded in the JVM, and one of over `fold` nodes takes pointers, so no document is one array.
    """
    order = Window.partitionBy("doc_id").orderBy("path", "node_id")
    tokens = F.greatest(F.lit(1), F.col("tokens").cast("bigint"))
    head = F.col("is_atomic") | F.coalesce(F.lag("is_atomic").over(order), F.lit(True)) | ~F.col("section").eqNullSafe(F.lag("section").over(order))
    rows = leaves.select("doc_id", "node_id", "path", tokens.alias("tokens"), head.alias("head"), F.row_number().over(order).cast("bigint").alias("i"))
    rows = rows.withColumn("segment", F.sum(F.col("head").cast("bigint")).over(order))
    part = Window.partitionBy("doc_id", "segment")
    rows = rows.withColumns({"before": F.sum("tokens").over(part.orderBy("i")) - F.col("tokens"), "total": F.sum("tokens").over(part), "n": F.count("*").over(part), "last": F.max("i").over(part)})
    rows = staged(rows, "leaves")
    long = rows.filter(F.col("total") > max_tokens)
    starts = _starts_by_fold(long.filter(F.col("n") <= fold), max_tokens)
    if not (longer := long.filter(F.col("n") > fold)).isEmpty():
        starts = starts.unionByName(_starts_by_pointers(longer, max_tokens))
    starts = starts.select(F.col("doc_id").alias("_d"), F.col("i").alias("_i"))
    marked = rows.join(shuffled(starts), (F.col("doc_id") == F.col("_d")) & (F.col("i") == F.col("_i")), "left")
    chunk = F.sum((F.col("head") | F.col("_i").isNotNull()).cast("int")).over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return leaves.join(shuffled(marked.select("doc_id", "node_id", chunk.cast("int").alias("chunk"))), ["doc_id", "node_id"])


def page_list(pages: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("]"))


def breadcrumb(title: Column, sections: Column, pages: Column) -> Column:
    """One line of context: the document, its sections, if any, and its pages."""
    where = F.nullif(F.array_join(F.filter(sections, lambda s: s != ""), " > "), F.lit(""))
    return F.concat(F.lit("[Context: "), F.concat_ws(" | ", title, where, F.concat(F.lit("Pages: "), page_list(pages))), F.lit("]"))


def section_paths(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, sections: the titles of a node's containers from the outermost, at any depth; containers without a title add nothing.

    Pointers to parents are doubled among the containers, so a depth costs joins by its logarithm; containers that are their own ancestors end where they have been met.
    """
    title = F.coalesce("title", F.lit(""))
    own = F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>"))
    boxes = staged(nodes.filter(F.col("kind") == CONTAINER).select("doc_id", F.col("node_id").alias("id"), F.col("parent_id").alias("at"), own.alias("sections")), "containers")
    most = boxes.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    steps = 1
    while steps < 2 * most and not boxes.filter("at IS NOT NULL").isEmpty():
        up = boxes.select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"), F.col("at").alias("_at"), F.col("sections").alias("_s"))
        found = boxes.join(shuffled(up), (F.col("doc_id") == F.col("_d")) & (F.col("at") == F.col("_i")), "left")
        boxes = staged(found.select("doc_id", "id", F.col("_at").alias("at"), F.when(F.col("_i").isNotNull(), F.concat("_s", "sections")).otherwise(F.col("sections")).alias("sections")), "containers")
        steps *= 2
    above = boxes.select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"), "sections")
    rows = nodes.select("doc_id", "node_id", "parent_id").join(shuffled(above), (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_i")), "left")
    return rows.select("doc_id", "node_id", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"))


def chunk_language() -> Column:
    """What says more of a node's kind: a language, an architecture, a style, a mark or a key."""
    a, kind = F.col("attrs"), F.col("kind")
    named = F.when(kind == "code", a["language"]).when(kind == "instruction", a["architecture"]).when(kind == "list", a["list_style"]).when(kind == "callout", a["callout_kind"])
    return F.nullif(named.when(kind == "footnote", F.coalesce(a["marker"], a["footnote_number"])).when(kind == "bib_entry", a["cite_key"]), F.lit(""))


#: Relations that lead from a text to a figure or table.
LEADS = ("caption_for", "references")


def build_chunks(nodes: DataFrame, docs: DataFrame, edges: DataFrame | None = None, entities: DataFrame | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, chunk, chunk_id, chunk_type, language, text, header, pages, node_ids, tokens, prev_id, next_id and, with a graph, mentioned and related ids.

    nodes: a node table; docs: doc_id, title. Chunks without text are left out. A chunk without a page is on page 1.
    """
    alive = live(nodes)
    leaves = alive.filter(~F.col("kind").isin(CONTAINER, "list_item")).join(shuffled(list_text(nodes)), ["doc_id", "node_id"], "left")
    leaves = leaves.withColumn("_text", F.coalesce("list_text", chunk_text())).join(shuffled(section_paths(nodes)), ["doc_id", "node_id"])
    leaves = leaves.select("doc_id", "node_id", "path", "kind", "page", "_text", "sections", F.col("kind").isin(*ATOMIC).alias("is_atomic"), F.concat_ws("\u0001", "sections").alias("section"), F.greatest(F.lit(1), token_estimate(F.col("_text"))).alias("tokens"), chunk_language().alias("language"))
    packed = pack(leaves, max_tokens)
    parts = F.array_sort(F.collect_list(F.struct("path", "node_id", "kind", F.col("_text").alias("text"), "page", "sections", "language")))
    chunks = packed.groupBy("doc_id", "chunk").agg(parts.alias("p"))
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != "")
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("p", lambda x: x["page"] + 1), lambda x: x.isNotNull())))
    kind = F.get("p", F.lit(0))["kind"]
    chunks = chunks.select(
        "doc_id", "chunk", F.when(kind.isin(*ATOMIC), kind).otherwise("narrative").alias("chunk_type"), F.array_join(texts, "\n\n").alias("text"), F.when(F.size(pages) == 0, F.array(F.lit(1))).otherwise(pages).alias("pages"),
        F.transform("p", lambda x: x["node_id"]).alias("node_ids"), F.get("p", F.lit(0))["sections"].alias("sections"), F.get("p", F.lit(0))["language"].alias("language"),
        F.transform(F.filter("p", lambda x: x["kind"] == "figure"), lambda x: x["node_id"]).alias("own_figures"), F.transform(F.filter("p", lambda x: x["kind"] == "table"), lambda x: x["node_id"]).alias("own_tables"),
    ).filter("text <> ''")
    chunks = chunks.join(shuffled(docs.select("doc_id", F.col("title").alias("_title"))), "doc_id", "left")
    chunks = chunks.withColumn("chunk_id", made_id("chunk", F.col("doc_id"), F.get("node_ids", F.lit(0)))).withColumn("tokens", token_estimate(F.col("text")))
    chunks = chunks.withColumn("header", breadcrumb(F.coalesce("_title", F.lit("")), F.col("sections"), F.col("pages"))).drop("_title")
    if edges is not None and entities is not None:
        chunks = with_graph(chunks, edges, entities)
    chunks = chunks.drop("own_figures", "own_tables")
    order = Window.partitionBy("doc_id").orderBy("chunk")
    return chunks.withColumn("prev_id", F.lag("chunk_id").over(order)).withColumn("next_id", F.lead("chunk_id").over(order))


def with_graph(chunks: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """chunks with mentioned (names of entities at edges from or to their nodes), related_figures and related_tables: their own, and what edges of LEADS lead to if its id says
    so and it's no entity. chunks: chunk_id, node_ids and, if known, own_figures and own_tables; edges: source_id, target_id, relation."""
    ids = chunks.select("chunk_id", F.explode("node_ids").alias("_n"))
    out = ids.join(edges.select(F.col("source_id").alias("_s"), F.col("target_id").alias("other"), F.col("relation").isin(*LEADS).alias("leads")), F.col("_n") == F.col("_s")).select("chunk_id", "other", "leads")
    into = ids.join(edges.select(F.col("target_id").alias("_s"), F.col("source_id").alias("other")), F.col("_n") == F.col("_s")).select("chunk_id", "other", F.lit(False).alias("leads"))
    named = entities.filter(F.coalesce("name", F.lit("")) != "").select(F.col("entity_id").alias("_e"), "name")
    around = out.union(into).distinct().join(named, F.col("other") == F.col("_e"), "left")
    figure = F.contains(F.lower("other"), F.lit("fig"))
    lead = F.col("leads") & F.col("_e").isNull()
    found = around.groupBy(F.col("chunk_id").alias("_c")).agg(
        F.array_sort(F.collect_set("name")).alias("mentioned"),
        F.collect_set(F.when(lead & figure, F.col("other"))).alias("_figures"),
        F.collect_set(F.when(lead & ~figure & F.contains(F.lower("other"), F.lit("tbl")), F.col("other"))).alias("_tables"),
    )
    none = F.array().cast("array<string>")
    rows = chunks.join(found, F.col("chunk_id") == F.col("_c"), "left")
    own = lambda c: F.coalesce(c, none) if c in chunks.columns else none
    rows = rows.withColumn("mentioned", F.coalesce("mentioned", none))
    for kind in ("figures", "tables"):
        rows = rows.withColumn(f"related_{kind}", F.array_sort(F.array_union(F.coalesce(f"_{kind}", none), own(f"own_{kind}"))))
    return rows.drop("_c", "_figures", "_tables")


def manifest(chunks: DataFrame) -> DataFrame:
    """doc_id, manifest: the chunks of a document as JSON."""
    one = F.struct("chunk", F.struct("chunk_id", "chunk_type", "header", "text", "tokens", "pages", "node_ids", "prev_id", "next_id").alias("c"))
    body = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"])
    return chunks.groupBy("doc_id").agg(F.to_json(F.struct(F.col("doc_id"), F.count("*").alias("total_chunks"), body.alias("chunks"))).alias("manifest"))


def graph_rag(chunks: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): chunks and entities, the first of an id winning; each mention by name as an edge from the chunk to the first entity so called, and all edges of the graph, none merged."""
    nodes = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), F.col("header").alias("label"), F.lit(0).alias("_o")).unionByName(entities.select(F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.col("name").alias("label"), F.lit(1).alias("_o")))
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("type", "label"), "_o").alias("n")).select("id", "n.*")
    named = entities.groupBy("name").agg(F.min("entity_id").alias("target"))
    mentions = chunks.select("chunk_id", F.explode("mentioned").alias("name")).join(named, "name").select(F.col("chunk_id").alias("source"), "target", F.lit("MENTIONS_ENTITY").alias("relation"), F.lit(1.0).alias("weight"))
    return nodes, mentions.unionByName(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", F.col("confidence").alias("weight")))


def _contextual() -> Column:
    return F.concat(F.col("header"), F.lit("\n"), F.col("text"))


def instruction_dataset(chunks: DataFrame) -> DataFrame:
    """chunk_id, instruction, input, output, node_ids: one example a chunk."""
    return chunks.select("chunk_id", F.concat(F.lit("Analyze and extract key knowledge from: "), "header").alias("instruction"), _contextual().alias("input"), F.col("text").alias("output"), "node_ids")


def qa_dataset(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id, question, answer, context, node_ids: one pair a chunk. docs: doc_id, title."""
    rows = chunks.join(docs.select("doc_id", F.col("title").alias("_title")), "doc_id", "left")
    asked = F.concat(F.lit("What information is described in "), F.coalesce("_title", F.lit("the section")), F.lit(" regarding "), "chunk_type", F.lit("?"))
    return rows.select("chunk_id", asked.alias("question"), F.col("text").alias("answer"), _contextual().alias("context"), "node_ids")
