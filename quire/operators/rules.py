"""Rules on texts: skills, profiles, page checks, glossaries, and the small upserts of an editor's tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import latex_escape, script_share
from quire.operators.text_search import find_terms

SAMPLE = 5000
VALIDATED = 16


def valid_patterns(patterns: list[str]) -> list[str]:
    out = []
    for p in patterns:
        try:
            re.compile(p)
            out.append(p)
        except re.error:
            continue
    return out


def match_skills(texts: DataFrame, skills: list[dict]) -> DataFrame:
    """texts with skills: the names of those of which a keyword, in any case, or a pattern, in its case, is in the text; a bad pattern counts for nothing."""
    def hit(skill: dict) -> Column:
        out = F.lit(False)
        for k in skill.get("keywords", ()):
            out = out | F.contains(F.lower("text"), F.lit(k.lower()))
        for p in valid_patterns(skill.get("patterns", ())):
            out = out | F.col("text").rlike(p)
        return F.when(out, F.lit(skill["name"]))

    return texts.withColumn("skills", F.filter(F.array(*(hit(s) for s in skills)) if skills else F.array().cast("array<string>"), lambda x: x.isNotNull()))


def resolve_profiles(docs: DataFrame, profiles: list[dict]) -> DataFrame:
    """docs with recipe: that of the profile with the most points, of equals the first; null if none has any. The publisher and each pattern give 2, each keyword 1, on title, uri and the first characters of the text."""
    sample = F.concat_ws(" ", "title", "source_uri", F.left("text", F.lit(SAMPLE)))
    low = F.lower(sample)

    def points(p: dict) -> Column:
        out = F.when(F.contains(low, F.lit(p["publisher"].lower())), 2).otherwise(0) if p.get("publisher") else F.lit(0)
        for k in p.get("keywords", ()):
            out = out + F.when(F.contains(low, F.lit(k.lower())), 1).otherwise(0)
        for r in valid_patterns(p.get("patterns", ())):
            out = out + F.when(sample.rlike(r), 2).otherwise(0)
        return out

    best = F.array_max(F.array(*(F.struct(points(p).alias("points"), F.lit(-i).alias("order"), F.lit(p["recipe"]).alias("recipe")) for i, p in enumerate(profiles))))
    return docs.withColumn("recipe", F.when(best["points"] > 0, best["recipe"]))


#: What a translated page is tested for: (category, severity, pattern that shows the fault, pattern or text that excuses it).
PAGE_RULES = (
    ("untranslated", "error", r"(?iu)EXAMPLE\s+\d+\.\d+", r"(?iu)ПРИМЕР\s+\d+\.\d+"),
    ("untranslated", "warning", r"(?iu)Solution:", r"(?iu)Решение:"),
    ("corrupt_text", "error", r"\x{FFFD}", None),
    ("problematic_unicode", "warning", r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", None),
    ("unformatted_code", "warning", r"MOV AX,", r"`|lstlisting|\\texttt"),
    ("numbered_lists", "warning", r"\n\d+\.\s+[A-ZА-Я]", r"\\begin\{enumerate\}"),
)
FENCED = r"```|\\begin\{lstlisting\}"
NO_TEXT = (74, 18)


def page_issues(pages: DataFrame) -> DataFrame:
    """chapter, page, category, severity: one row a fault, of the first 16 pages of a chapter. pages: chapter, page, final (or null), original (or null), has_debug."""
    first = F.min("page").over(Window.partitionBy("chapter"))
    rows = pages.withColumn("_t", F.coalesce(F.nullif("final", F.lit("")), "original", F.lit(""))).withColumn("_k", F.col("page") - first).filter(F.col("_k") < VALIDATED)
    tests = [(c, s, F.col("_t").rlike(bad) & (~F.col("_t").rlike(good) if good else F.lit(True))) for c, s, bad, good in PAGE_RULES]
    tests.append(("debug_blocks", "error", F.col("has_debug") & ~F.col("_t").rlike(FENCED)))
    found = F.filter(F.array(*(F.when(hit, F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))) for c, s, hit in tests)), lambda x: x.isNotNull())
    return rows.select("chapter", "page", F.explode(found).alias("f")).select("chapter", "page", "f.*")


def page_report(pages: DataFrame) -> DataFrame:
    """chapter, errors, warnings, passed, found, missing, russian, english: shares of letters in percent of all characters."""
    text = F.coalesce("final", "original", F.lit(""))
    issues = page_issues(pages).groupBy("chapter").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))), lambda x: x["t"]), "")
    by = pages.groupBy("chapter").agg(F.count_if(text != "").alias("found"), F.count_if(text == "").alias("missing"), joined.alias("_all"))
    out = by.join(issues, "chapter", "left").fillna(0, ["errors", "warnings"])
    return out.select("chapter", "errors", "warnings", (F.col("errors") == 0).alias("passed"), "found", "missing", F.coalesce(script_share(F.col("_all"), "Cyrillic"), F.lit(NO_TEXT[0])).alias("russian"), F.coalesce(script_share(F.col("_all"), "Latin"), F.lit(NO_TEXT[1])).alias("english"))


def layered(manual: Column, autofix: Column, original: Column) -> Column:
    """A page's value: the hand's, else the fixer's, else the original."""
    return F.coalesce(manual, autofix, original)


def page_flags(text: Column) -> Column:
    return F.struct(text.rlike("```|MOV|ADD").alias("has_code"), F.contains(text, F.lit("|---")).alias("has_table"), F.contains(text, F.lit("DEBUG")).alias("has_debug"))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def chapter_latex(pages: DataFrame) -> DataFrame:
    """chapter, tex: pages in order; headings become sections, worked examples boxes, fences listings."""
    t = latex_escape(F.coalesce("final", "original", F.lit("")))
    for mark, command in ((r"\\#\\#\\# ", "subsubsection"), (r"\\#\\# ", "subsection"), (r"\\# ", "section")):
        t = F.regexp_replace(t, rf"(?m)^{mark}(.*)$", rf"\\{command}{{$1}}")
    t = F.regexp_replace(t, r"(?ms)^Example (\d+[-–]\d+)(.*?)(?=\n\n|\z)", r"\\begin{examplebox}{$1}$2\\end{examplebox}")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", t.alias("t")))), lambda x: x["t"]), "\n\n")
    return pages.groupBy("chapter").agg(body.alias("tex"))


def upsert_terms(rows: DataFrame) -> DataFrame:
    """term, translation, category, seq: the last entry of each term in any case; the category is general if none is given."""
    last = rows.groupBy(F.lower("term").alias("_k")).agg(F.max_by(F.struct("term", "translation", F.coalesce("category", F.lit("general")).alias("category"), "seq"), "seq").alias("t"))
    return last.select("t.*")


def approve(suggestions: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new terms, suggestions with their status). An approved suggestion translates to its context, or to itself. approved: suggestion_id, ok."""
    judged = suggestions.join(approved, "suggestion_id", "left")
    terms = judged.filter("ok").select("term", F.coalesce(F.nullif("context", F.lit("")), "term").alias("translation"), F.lit("general").alias("category"), F.col("suggestion_id").alias("seq"))
    return terms, judged.withColumn("status", F.when(F.col("ok"), "approved").when(~F.col("ok"), "rejected").otherwise(F.col("status"))).drop("ok")


def search_terms(terms: DataFrame, query: str) -> DataFrame:
    return terms.filter(F.contains(F.lower("term"), F.lit(query.lower())) | F.contains(F.lower("translation"), F.lit(query.lower())))


def terms_on_pages(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """chapter, page, term: terms that the page's text holds, in any case; all terms are looked for in one pass of a text."""
    return find_terms(pages, terms, F.coalesce("final", "original", F.lit("")), ["chapter", "page"])


def merged(old: Column, new: Column) -> Column:
    """Two maps, the new keys winning."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def list_merged(old: Column, new: Column) -> Column:
    """The values of old, then those of new that old hasn't, each once, in their order; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))


def upsert_given(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old and new by key; of a row in both, fields that are null in new stay."""
    fields = [c for c in old.columns if c != key]
    right = new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in fields))
    both = old.join(right, F.col(key) == F.col("_k"), "full")
    return both.select(F.coalesce(key, "_k").alias(key), *(F.coalesce(f"_{c}", c).alias(c) for c in fields))


#: The stages of a chapter.
STAGES = ("extract", "ocr", "analyze", "translate", "glossary", "validate", "figures", "latex", "compile")


def stage_state(chapters: DataFrame, runs: DataFrame) -> DataFrame:
    """chapter, stage, status: pending without a run. runs: chapter, stage, status, seq; the last one holds, and reset makes it pending."""
    last = runs.groupBy(F.col("chapter").alias("_c"), F.col("stage").alias("_s")).agg(F.max_by("status", "seq").alias("_st"))
    every = chapters.select("chapter", F.explode(F.array(*(F.lit(s) for s in STAGES))).alias("stage"))
    status = F.when(F.coalesce("_st", F.lit("reset")) == "reset", "pending").otherwise(F.col("_st"))
    return every.join(last, (F.col("chapter") == F.col("_c")) & (F.col("stage") == F.col("_s")), "left").select("chapter", "stage", status.alias("status"))


def queue_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def claim(jobs: DataFrame) -> DataFrame:
    """All pending jobs become running."""
    return jobs.withColumn("status", F.when(F.col("status") == "pending", "running").otherwise(F.col("status")))


def search_documents(docs: DataFrame, query: str, status: str = "ALL") -> DataFrame:
    found = F.contains(F.lower("title"), F.lit(query.lower())) | F.contains(F.lower("job_id"), F.lit(query.lower()))
    return docs.filter(found & (F.lit(status == "ALL") | (F.col("status") == status)))


def page_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, page (from 1), text: live blocks by line, in tree order."""
    from quire.model import text_spaced

    rows = nodes.filter(~F.col("is_tombstoned") & (F.col("kind") != "container") & F.col("page").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", text_spaced().alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("doc_id", (F.col("page") + 1).alias("page")).agg(joined.alias("text"))


#: States of a hosted kernel, and ours.
KERNEL_STATES = {"queued": "starting", "running": "up", "complete": "cold", "cancelRequested": "stopping", "cancelAcknowledged": "cold", "error": "error"}


def backend_state(kernel: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in KERNEL_STATES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kernel), F.lit("error"))


def runner_origin(url: Column) -> Column:
    """scheme://host:port of an http address with a port and a public host, else null."""
    host, port = F.try_parse_url(url, F.lit("HOST")), F.regexp_extract(url, r"^https?://[^/:]+:(\d{1,5})(?:/|$)", 1)
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[)")
    ok = url.rlike(r"^https?://") & (port != "") & ~private & (port.try_cast("int") <= 65535)
    return F.when(ok, F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), host, F.lit(":"), port))


def first_reachable(agents: DataFrame) -> DataFrame:
    """role, host: the first reachable agent by ordinal. agents: role, host, ordinal, reachable."""
    return agents.filter("reachable").groupBy("role").agg(F.min_by("host", "ordinal").alias("host"))


def add_agents(agents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agents with the new ones, those refused since their host is there). new: one row a host."""
    known = agents.select(F.col("host").alias("_h"))
    same = F.col("host") == F.col("_h")
    return agents.unionByName(new.join(known, same, "left_anti"), allowMissingColumns=True), new.join(known, same, "left_semi")


def update_agents(agents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agents with name, active_model and roles of their host's change, the changes of unknown hosts). changes: host, name, active_model, roles."""
    fields = ("name", "active_model", "roles")
    right = changes.select(F.col("host").alias("_h"), *(F.col(c).alias(f"_{c}") for c in fields))
    rows = agents.join(right, F.col("host") == F.col("_h"), "left")
    out = rows.select(*(F.when(F.col("_h").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in agents.columns))
    return out, changes.join(agents.select(F.col("host").alias("_h")), F.col("host") == F.col("_h"), "left_anti")


def delete_agents(agents: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the other agents, the hosts that no agent has). hosts: host."""
    return agents.join(hosts, "host", "left_anti"), hosts.join(agents, "host", "left_anti")


#: What the manifest of a chapter says that has none.
NO_MANIFEST = {"sections": "[]", "figures": "[]", "examples": "[]", "tables": "[]", "debug_sessions": "[]", "numbered_lists": "[]", "element_order": "{}"}


def chapter_manifests(chapters: DataFrame, manifests: DataFrame) -> DataFrame:
    """chapter, manifest (JSON): the last one that was set, else one of 30 pages without contents. manifests: chapter, manifest, seq."""
    last = manifests.groupBy(F.col("chapter").alias("_c")).agg(F.max_by("manifest", "seq").alias("_m"))
    empty = F.concat(F.lit('{"manifest_version":1,"chapter":'), F.col("chapter").cast("string"), F.lit(',"pages":{"start":1,"end":30,"count":30},'), F.lit(",".join(f'"{k}":{v}' for k, v in NO_MANIFEST.items()) + "}"))
    return chapters.join(last, F.col("chapter") == F.col("_c"), "left").select("chapter", F.coalesce("_m", empty).alias("manifest"))


def one_loader_a_task(loaders: DataFrame) -> DataFrame:
    """Tasks with more than one loader."""
    return loaders.groupBy("task").agg(F.count("*").alias("n")).filter("n > 1")
