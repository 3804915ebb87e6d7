"""Documents out of node tables: JSON and LaTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import alignment, latex_escape, strip
from quire.model import CONTAINER, NODE, live, text_spaced


def document_json(nodes: DataFrame) -> DataFrame:
    """doc_id, json: a document's live nodes in order, with all their columns."""
    one = F.struct("path", F.struct(*(f.name for f in NODE if f.name not in ("doc_id", "is_tombstoned", "tombstone_reason"))).alias("n"))
    body = F.transform(F.array_sort(F.collect_list(one.dropFields("n.attrs").withField("a", F.to_json("attrs")))), lambda x: x["n"].withField("attrs", F.from_json(x["a"], "map<string,string>")))
    return live(nodes).groupBy("doc_id").agg(F.to_json(F.struct("doc_id", body.alias("nodes"))).alias("json"))


def read_document_json(docs: DataFrame) -> DataFrame:
    """The node table back from document_json(); texts that can't be read give no rows."""
    shape = NODE.simpleString()
    parsed = F.from_json("json", f"struct<doc_id:string,nodes:array<{shape}>>", {"mode": "PERMISSIVE"})
    rows = docs.select(parsed.alias("j")).filter("j.doc_id is not null").select(F.col("j.doc_id").alias("_d"), F.explode("j.nodes").alias("n")).select("_d", "n.*")
    fill = {"doc_id": F.col("_d"), "is_tombstoned": F.lit(False)}
    return rows.select(*(fill.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in NODE))


def full_text(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text: a document's title, its containers' titles and its blocks' texts in order, blank lines between; tombstoned nodes count too. docs: doc_id, title."""
    a = F.col("attrs")
    cells = F.array_join(F.transform(F.from_json(a["grid"], "array<array<string>>"), lambda r: F.array_join(r, " ")), "\n")
    own = F.array_join(F.filter(F.coalesce("spans", F.array().cast("array<string>")), lambda x: x != ""), "\n")
    text = F.when(F.col("kind") == CONTAINER, F.col("title")).otherwise(F.coalesce(a["code_text"], a["latex_expression"], a["raw_text"], a["entry_text"], cells, own))
    rows = nodes.select("doc_id", "path", text.alias("t")).filter("t <> ''")
    body = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda x: x["t"]).alias("_t"))
    title = F.filter(F.array("title"), lambda t: t.isNotNull() & (t != ""))
    return docs.join(body, "doc_id", "left").select("doc_id", F.array_join(F.concat(title, F.coalesce("_t", F.array().cast("array<string>"))), "\n\n").alias("text"))


#: The commands of heading levels.
COMMANDS = {1: "chapter", 2: "section", 3: "subsection", 4: "subsubsection"}
PREAMBLE = "\\documentclass[12pt]{report}\n\\usepackage{fontspec,amsmath,mdframed,enumitem,graphicx}\n\\begin{document}\n"
POSTAMBLE = "\\end{document}\n"


def _command(level: Column) -> Column:
    out = F.lit("paragraph")
    for k, name in COMMANDS.items():
        out = F.when(level == k, name).otherwise(out)
    return out


def _wrap(before: str, body: Column, after: str) -> Column:
    return F.concat(F.lit(before), body, F.lit(after))


def latex(nodes: DataFrame, docs: DataFrame, translations: DataFrame | None = None, lang: str = "") -> DataFrame:
    """doc_id, tex: the live nodes of a document in order, each as LaTeX. translations: doc_id, node_id, lang, text, in place of the source. docs: doc_id, title."""
    rows = live(nodes)
    said = F.lit(None).cast("string")
    if translations is not None:
        chosen = translations.filter(F.col("lang") == lang).select("doc_id", "node_id", F.col("text").alias("_said"))
        rows, said = rows.join(chosen, ["doc_id", "node_id"], "left"), F.col("_said")
    a, kind, esc = F.col("attrs"), F.col("kind"), latex_escape
    text = esc(F.coalesce(said, strip(text_spaced())))
    name = F.nullif(esc(F.coalesce(said, "title", F.lit(""))), F.lit(""))
    math = F.coalesce(a["latex_expression"], F.lit(""))
    safe = F.when(F.coalesce(a["needs_vision_ocr"], F.lit("false")) == "true", _wrap("\\text{", esc(math), "}")).otherwise(math)
    formula = F.when(a["formula_number"].isNotNull(), F.concat(F.lit("\\begin{equation}\\tag{"), esc(a["formula_number"]), F.lit("}\n"), safe, F.lit("\n\\end{equation}\n"))).otherwise(_wrap("\\[\n", safe, "\n\\]\n"))
    place = alignment(F.col("x0"), F.col("x1"))
    paragraph = F.when(place == "center", _wrap("\\begin{center}\n", text, "\n\\end{center}\n")).when(place == "right", _wrap("\\begin{flushright}\n", text, "\n\\end{flushright}\n")).otherwise(F.concat(text, F.lit("\n\n")))
    left = F.concat_ws("~", F.nullif(esc(F.coalesce(a["chapter_number"], F.lit(""))), F.lit("")), esc(F.coalesce(said, a["entry_text"], F.lit(""))))
    page = (a["target_page"].try_cast("int") + 1).cast("string")
    toc = F.when(page.isNotNull(), F.concat(F.lit("\\noindent "), left, F.lit("\\dotfill "), page, F.lit("\\\\\n"))).otherwise(_wrap("\\noindent ", left, "\\\\\n"))
    grid = F.from_json(a["grid"], "array<array<string>>")
    width = F.greatest(F.lit(1), F.array_max(F.transform(grid, lambda r: F.size(r))))
    table = F.concat(F.lit("\\begin{tabular}{|"), F.repeat(F.lit("l|"), width), F.lit("}\n\\hline\n"), F.array_join(F.transform(grid, lambda r: F.concat(F.array_join(F.transform(r, lambda c: latex_escape(F.coalesce(c, F.lit("")))), " & "), F.lit(" \\\\ \\hline"))), "\n"), F.lit("\n\\end{tabular}\n"))
    label = esc(F.coalesce(a["label"], F.initcap(a["callout_kind"]), F.lit("")))
    drawn = (
        F.when(kind == CONTAINER, F.concat(F.lit("\\"), _command(F.col("level")), F.lit("{"), name, F.lit("}\n")))
        .when(kind == "title_page", F.when(text != "", _wrap("\\begin{center}\n\\Large\n", text, "\n\\end{center}\n\\clearpage\n")))
        .when(kind == "blank_page", F.lit("\\clearpage\n"))
        .when(kind == "code", _wrap("\\begin{verbatim}\n", F.coalesce(a["code_text"], text_spaced()), "\n\\end{verbatim}\n"))
        .when(kind == "caption", F.when(F.coalesce(said, a["caption_text"], F.lit("")) != "", _wrap("\\textit{", esc(F.coalesce(said, a["caption_text"])), "}\n\n")))
        .when(kind == "footnote", F.concat(F.lit("\\par\\noindent{\\footnotesize "), esc(F.coalesce(a["marker"], F.lit(""))), F.lit(" "), esc(F.coalesce(said, a["rest"], F.lit(""))), F.lit("}\\par\n")))
        .when(kind == "callout", F.concat(F.lit("\\begin{mdframed}\n"), F.when(label != "", _wrap("\\textbf{", label, "}\\\\[0.2em]\n")).otherwise(""), esc(F.coalesce(said, a["rest"], F.lit(""))), F.lit("\n\\end{mdframed}\n")))
        .when(kind == "formula", F.when(math != "", formula))
        .when(kind == "toc_entry", toc)
        .when(kind == "table", table)
        .when(kind == "list_item", F.concat(F.lit("\\item "), text, F.lit("\n")))
        .when(kind == "bib_entry", F.concat(F.lit("\\bibitem{"), esc(F.coalesce(a["cite_key"], F.left("node_id", F.lit(8)))), F.lit("} "), esc(F.coalesce(said, a["raw_text"], F.lit(""))), F.lit("\n")))
        .when(kind.isin("figure", "diagram"), F.lit("\\begin{center}[figure]\\end{center}\n"))
        .when((kind == "paragraph") & (text != ""), paragraph)
    )
    rows = rows.withColumn("_tex", drawn)
    env = F.when(a["list_style"].isin("ordered", "alpha", "roman"), "enumerate").otherwise("itemize")
    option = F.when(a["list_style"] == "alpha", "[label=\\alph*)]").when(a["list_style"] == "roman", "[label=\\roman*.]").otherwise("")
    same = Window.partitionBy("doc_id", "parent_id", F.col("kind") == "bib_entry")
    entries = rows.withColumn("_first", (kind == "bib_entry") & (F.row_number().over(same.orderBy("path")) == 1)).withColumn("_last", (kind == "bib_entry") & (F.row_number().over(same.orderBy(F.desc("path"))) == 1)).withColumn("_many", F.count("*").over(same))
    open_bib = F.when(F.col("_first"), F.concat(F.lit("\\begin{thebibliography}{"), F.col("_many").cast("string"), F.lit("}\n"))).otherwise("")
    close_bib = F.when(F.col("_last"), F.lit("\\end{thebibliography}\n")).otherwise("")
    pieces = entries.select("doc_id", "path", F.concat(open_bib, F.coalesce("_tex", F.lit("")), close_bib).alias("t"))
    opened = rows.filter(kind == "list").select("doc_id", "path", F.concat(F.lit("\\begin{"), env, F.lit("}"), option, F.lit("\n")).alias("t"))
    closed = rows.filter(kind == "list").select("doc_id", F.concat("path", F.array(F.lit(2147483647))).alias("path"), F.concat(F.lit("\\end{"), env, F.lit("}\n")).alias("t"))
    every = pieces.unionByName(opened).unionByName(closed).filter("t <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda x: x["t"]), "")
    made = every.groupBy("doc_id").agg(body.alias("_body"))
    head = F.concat(F.lit("\\title{"), esc(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))), F.lit("}\n\\maketitle\n"))
    return docs.join(made, "doc_id", "left").select("doc_id", F.concat(F.lit(PREAMBLE), head, F.coalesce("_body", F.lit("")), F.lit(POSTAMBLE)).alias("tex"))
