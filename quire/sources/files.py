"""Readers: files of a folder to documents and nodes. Every reader takes whole files and works on columns; what can't be read is in a table of errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import strip, title_from_uri
from quire.model import CONTAINER, NODE, PARAGRAPH

FENCE, HEADING = "```", r"^(#{1,6})\s+(.+)$"
REPLACED = "�"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, is_dir, size, modified below root: folders first, then by name in lower case. What lies outside the root can't be listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rel = F.regexp_replace("path", r"^\w+:/*", "/")
    base = root.rstrip("/")
    inside = files.withColumn("_rel", F.substring_index(rel, base + "/", -1))
    top = F.split("_rel", "/")
    here = inside.select(F.get(top, F.lit(0)).alias("name"), (F.size(top) > 1).alias("is_dir"), "size", "modified")
    return here.groupBy("name", "is_dir").agg(F.sum("size").alias("size"), F.max("modified").alias("modified")).orderBy(F.desc("is_dir"), F.lower("name"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source_uri, raw, text, is_valid: UTF-8 text of each file; is_valid is false where the bytes aren't UTF-8."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_uri"), F.col("content").alias("raw"))
    return rows.select(F.sha2("source_uri", 256).alias("doc_id"), "source_uri", "raw", F.make_valid_utf8(F.col("raw").cast("string")).alias("text"), F.is_valid_utf8(F.col("raw").cast("string")).alias("is_valid"))


def parse_errors(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_valid")).select("doc_id", "source_uri", F.lit("not UTF-8").alias("error"))


def _node(rows: DataFrame) -> DataFrame:
    fresh = {"ext_conf": F.lit(1.0), "cls_conf": F.lit(1.0), "conf": F.lit(1.0), "is_tombstoned": F.lit(False), "is_mono": F.lit(False), "applied": F.array().cast("array<string>"), "attrs": F.create_map().cast("map<string,string>")}
    return rows.select(*((F.col(f.name) if f.name in rows.columns else fresh.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in NODE))


def text_nodes(files: DataFrame) -> DataFrame:
    """Nodes of plain text: one container a document, a paragraph between blank lines, a span a line that isn't blank. files: doc_id, source_uri, text."""
    roots = files.select("doc_id", F.concat("doc_id", F.lit("/0")).alias("node_id"), F.array(F.lit(0)).alias("path"), F.lit(CONTAINER).alias("kind"), F.lit(1).alias("level"), title_from_uri(F.col("source_uri")).alias("title"))
    parts = files.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n\n"), strip), lambda p: p != "")).alias("i", "p"))
    spans = F.filter(F.transform(F.split("p", r"\r\n|\r|\n"), strip), lambda s: s != "")
    paragraphs = parts.select("doc_id", F.concat_ws("/", "doc_id", F.lit("0"), "i").alias("node_id"), F.concat("doc_id", F.lit("/0")).alias("parent_id"), F.array(F.lit(0), "i").alias("path"), F.lit(PARAGRAPH).alias("kind"), spans.alias("spans"))
    return _node(roots).unionByName(_node(paragraphs))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "source_uri", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line")).withColumn("s", strip(F.col("line")))


def _nest(rows: DataFrame) -> DataFrame:
    """rows: doc_id, n, level (of a heading, else null). parent_n: the last heading before of a lower level, for blocks the last one at all that is still open, or -1."""
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 7):
        rows = rows.withColumn(f"_h{k}", F.max(F.when(F.col("level") == k, F.col("n"))).over(order))
    best = F.lit(-1)
    for k in range(6, 0, -1):
        best = F.when(F.col("level").isNull() | (F.col("level") > k), F.greatest(best, F.coalesce(f"_h{k}", F.lit(-1)))).otherwise(best)
    return rows.withColumn("parent_n", best).drop(*(f"_h{k}" for k in range(1, 7)))


def markdown_nodes(files: DataFrame) -> DataFrame:
    """Nodes of Markdown: headings 1 to 6 nest containers, fences make code with its language, blank lines end paragraphs. Text before any heading is in
    a container of level 1 with the document's title; an open fence goes to the end. files: doc_id, source_uri, text."""
    order = Window.partitionBy("doc_id").orderBy("n")
    rows = _lines(files).withColumn("_fence", F.startswith("s", F.lit(FENCE)))
    rows = rows.withColumn("_fences", F.sum(F.col("_fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_code", (F.col("_fences") % 2 == 1) & ~F.col("_fence")).withColumn("_open", F.col("_fence") & (F.col("_fences") % 2 == 1))
    heading = ~F.col("_code") & ~F.col("_fence") & F.col("s").rlike(HEADING)
    rows = rows.withColumn("level", F.when(heading, F.char_length(F.regexp_extract("s", HEADING, 1)))).withColumn("title", F.when(heading, strip(F.regexp_extract("s", HEADING, 2))))
    rows = rows.withColumn("_plain", ~F.col("_code") & ~F.col("_fence") & F.col("level").isNull() & (F.col("s") != ""))
    starts = F.col("_plain") & ~F.coalesce(F.lag("_plain").over(order), F.lit(False))
    rows = rows.withColumn("_par", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heads = rows.filter("level is not null").select("doc_id", "n", "level", "title", F.lit(CONTAINER).alias("kind"), F.lit(None).cast("array<string>").alias("spans"), F.lit(None).cast("map<string,string>").alias("attrs"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"])
    paragraphs = rows.filter("_plain").groupBy("doc_id", "_par").agg(F.min("n").alias("n"), joined.alias("spans")).select("doc_id", "n", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"), F.lit(PARAGRAPH).alias("kind"), "spans", F.create_map().cast("map<string,string>").alias("attrs"))
    code = rows.filter("_code or _open").groupBy("doc_id", "_fences").agg(F.min("n").alias("n"), F.min_by("s", "n").alias("_f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_code"), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("_t"))
    language = F.nullif(strip(F.substring("_f", 4, 1000)), F.lit(""))
    code = code.select("doc_id", "n", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"), F.lit("code").alias("kind"), F.array("_t").alias("spans"), F.map_filter(F.create_map(F.lit("code_text"), F.col("_t"), F.lit("language"), language), lambda k, v: v.isNotNull()).alias("attrs"))
    blocks = _nest(heads.unionByName(paragraphs).unionByName(code))
    first = F.min_by("title", F.struct(F.coalesce(F.col("level"), F.lit(9)) != 1, "n"))
    roots = files.select("doc_id", "source_uri").join(blocks.groupBy("doc_id").agg(F.min(F.when(F.col("parent_n") == -1, F.when(F.col("level").isNull(), F.col("n")))).alias("_loose"), F.count("*").alias("_n"), first.alias("_first")), "doc_id", "left")
    implicit = roots.filter(F.col("_loose").isNotNull() | F.col("_n").isNull()).select("doc_id", F.lit(-1).alias("n"), F.lit(1).alias("level"), title_from_uri(F.col("source_uri")).alias("title"), F.lit(CONTAINER).alias("kind"), F.lit(-2).alias("parent_n"), F.lit(None).cast("array<string>").alias("spans"), F.lit(None).cast("map<string,string>").alias("attrs"))
    every = blocks.withColumn("parent_n", F.when((F.col("parent_n") == -1) & F.col("level").isNotNull(), F.lit(-2)).otherwise(F.col("parent_n"))).unionByName(implicit)
    name = lambda c: F.concat_ws("/", "doc_id", c.cast("string"))
    named = every.withColumn("node_id", name(F.col("n"))).withColumn("parent_id", F.when(F.col("parent_n") > -2, name(F.col("parent_n"))))
    return _node(_paths(named))


def _paths(rows: DataFrame, depth: int = 7) -> DataFrame:
    """path: the line numbers of the containers down to the node; a heading has 6 levels, so 7 steps reach every root."""
    up = rows.filter(F.col("kind") == CONTAINER).select("doc_id", F.col("n").alias("pn"), F.col("parent_n").alias("pp"))
    out = rows.withColumn("path", F.array(F.col("n").cast("int"))).withColumn("_at", F.col("parent_n"))
    for k in range(depth):
        p = up.select(F.col("doc_id").alias(f"_d{k}"), F.col("pn").alias(f"_n{k}"), F.col("pp").alias(f"_p{k}"))
        out = out.join(p, (F.col("doc_id") == F.col(f"_d{k}")) & (F.col("_at") == F.col(f"_n{k}")), "left")
        out = out.withColumn("path", F.when(F.col(f"_n{k}").isNotNull(), F.concat(F.array(F.col(f"_n{k}").cast("int")), "path")).otherwise(F.col("path"))).withColumn("_at", F.col(f"_p{k}")).drop(f"_d{k}", f"_n{k}", f"_p{k}")
    return out


def markdown_titles(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, title: the first heading of level 1, else from the address."""
    first = nodes.filter((F.col("kind") == CONTAINER) & (F.col("level") == 1)).groupBy("doc_id").agg(F.min_by("title", "path").alias("_t"))
    return files.select("doc_id", "source_uri").join(first, "doc_id", "left").select("doc_id", F.coalesce("_t", title_from_uri(F.col("source_uri"))).alias("title"))


def html_headings(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc_id, n, level, title, parent_n: headings of web pages and how they nest. An extension for tables of pages."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(0))
    rows = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(found).alias("n", "tag"))
    title = strip(F.regexp_replace(F.regexp_replace("tag", r"(?s)<[^>]*>", ""), "&amp;", "&"))
    rows = rows.select("doc_id", "n", F.regexp_extract("tag", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))
    return _nest(rows)


READERS: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable[[DataFrame], DataFrame] | None]] = {
    "markdown": (("md", "markdown"), ("text/markdown", "text/x-markdown"), markdown_nodes),
    "text": (("txt", "text"), ("text/plain",), text_nodes),
    "pdf": (("pdf",), ("application/pdf",), None),
}


def reader_for(ext: str | None = None, mime: str | None = None) -> str | None:
    """The first reader for an extension, with or without its dot, or a type, with or without parameters, in any case."""
    ext, mime = (ext or "").lower().lstrip("."), (mime or "").split(";")[0].strip().lower()
    return next((name for name, (exts, mimes, _) in READERS.items() if (ext and ext in exts) or (mime and mime in mimes)), None)


def reader_of(name: Column) -> Column:
    """The same for a column of file names."""
    ext, out = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)), F.lit(None).cast("string")
    for reader, (exts, _, _) in reversed(READERS.items()):
        out = F.when(ext.isin(*exts), reader).otherwise(out)
    return out


def import_jobs(requests: DataFrame) -> DataFrame:
    """job_id, source_uri, status of import requests: provider, path."""
    uri = F.concat(F.lit("sep://"), "provider", F.lit("/"), F.ltrim(F.col("path"), F.lit("/")))
    return requests.select(F.sha2(uri, 256).alias("job_id"), uri.alias("source_uri"), F.lit("queued").alias("status"))
