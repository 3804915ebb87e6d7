"""Nodes from spans that a PDF library has taken out of pages: the contract for paged sources.

pdf_spans: doc_id, page, page_w, page_h, block, line, span, text, font, size, flags, bx0, by0, bx1, by1 (points). pdf_pages: doc_id, page, n_images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clamp, extraction_confidence, is_garbage, is_mono
from quire.model import CONTAINER, PARAGRAPH
from quire.sources.files import _node

PAGES, START_CONFIDENCE, BOLD, ITALIC = 50, 0.5, 16, 2


def span_nodes(spans: DataFrame, pages: DataFrame, titles: DataFrame, max_pages: int = PAGES, ascii_only: bool = True) -> DataFrame:
    """One container a document and a paragraph a block, or code if all its spans are monospaced; debris of scans is left out.

    A page without text has an empty paragraph, marked needs_ocr if it has pictures. The style is that of the largest span. Documents are read to
    max_pages pages. titles: doc_id, title.
    """
    chosen = spans.filter(F.col("page") < max_pages)
    lines = F.array_sort(F.collect_list(F.struct("line", "span", "text")))
    blocks = chosen.groupBy("doc_id", "page", "block").agg(
        lines.alias("_l"), F.max_by("font", F.struct("size", -F.col("line"), -F.col("span"))).alias("font_family"), F.max("size").alias("font_size"), F.bool_and(is_mono(F.col("font"))).alias("is_mono"),
        F.bool_or(F.col("flags").bitwiseAND(BOLD) != 0).alias("_bold"), F.bool_or(F.col("flags").bitwiseAND(ITALIC) != 0).alias("_italic"),
        *(f("" + c).alias(f"_{c}") for c, f in (("bx0", F.min), ("by0", F.min), ("bx1", F.max), ("by1", F.max))), F.first("page_w").alias("_w"), F.first("page_h").alias("_h"),
    )
    text = F.array_join(F.transform("_l", lambda x: x["text"]), " ")
    blocks = blocks.withColumn("_t", text).filter((F.trim("_t") != "") & ~is_garbage(F.col("_t"), ascii_only))
    box = {k: clamp(F.col(c) / F.col(s), 0.0, 1.0) for k, c, s in (("x0", "_bx0", "_w"), ("y0", "_by0", "_h"), ("x1", "_bx1", "_w"), ("y1", "_by1", "_h"))}
    conf = extraction_confidence(F.col("_t"))
    style = F.map_filter(F.create_map(F.lit("bold"), F.when(F.col("_bold"), "true"), F.lit("italic"), F.when(F.col("_italic"), "true"), F.lit("code_text"), F.when(F.col("is_mono"), F.col("_t"))), lambda k, v: v.isNotNull())
    made = blocks.select(
        "doc_id", F.concat_ws("/", "doc_id", "page", "block").alias("node_id"), F.concat("doc_id", F.lit("/root")).alias("parent_id"), F.array(F.lit(0), "page", "block").alias("path"), F.when(F.col("is_mono"), "code").otherwise(PARAGRAPH).alias("kind"),
        F.transform("_l", lambda x: x["text"]).alias("spans"), "page", *(v.alias(k) for k, v in box.items()), "font_family", F.col("font_size").cast("double").alias("font_size"), "is_mono",
        conf.alias("ext_conf"), F.lit(START_CONFIDENCE).alias("cls_conf"), F.least(conf, F.lit(START_CONFIDENCE)).alias("conf"), style.alias("attrs"),
    )
    bare = pages.filter(F.col("page") < max_pages).join(made.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    empty = bare.select(
        "doc_id", F.concat_ws("/", "doc_id", "page", F.lit("empty")).alias("node_id"), F.concat("doc_id", F.lit("/root")).alias("parent_id"), F.array(F.lit(0), "page", F.lit(0)).alias("path"), F.lit(PARAGRAPH).alias("kind"), F.array().cast("array<string>").alias("spans"), "page",
        F.lit(0.1).alias("ext_conf"), F.lit(START_CONFIDENCE).alias("cls_conf"), F.lit(0.1).alias("conf"), F.when(F.col("n_images") > 0, F.create_map(F.lit("needs_ocr"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>")).alias("attrs"),
    )
    roots = titles.select("doc_id", F.concat("doc_id", F.lit("/root")).alias("node_id"), F.array(F.lit(0)).alias("path"), F.lit(CONTAINER).alias("kind"), F.lit(1).alias("level"), "title")
    return _node(roots).unionByName(_node(made)).unionByName(_node(empty))
