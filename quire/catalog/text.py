"""Queries on texts and lines."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.catalog.base import LINES, lines, number, table, line_nodes
from quire.functions import markers, metrics
from quire.functions import text as t
from quire.operators import analyzers, artifacts, evaluation, review, rules

# The measures of a line in SQL; the lines of these tables hold no white space but single spaces, and no control characters.
STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
MEASURES = f"""
    measured AS (
        SELECT *, {STRIPPED} AS s FROM lines
    ), counted AS (
        SELECT *, length(s) AS size, length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) AS alpha,
            CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '\\s+')) END AS words FROM measured
    ), sentences AS (
        SELECT *, contains(s, '.') AND words > 3 AS sentence, alpha / size AS share FROM counted
    ), confident AS (
        SELECT *,
            CASE WHEN size = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, least(0.95::DOUBLE, 0.55::DOUBLE
                + CASE WHEN size >= 30 THEN 0.20::DOUBLE WHEN size >= 10 THEN 0.10::DOUBLE WHEN size < 3 THEN -0.10::DOUBLE ELSE 0::DOUBLE END + 1::DOUBLE * 0.10::DOUBLE
                + CASE WHEN share > 0.5::DOUBLE THEN 0.05::DOUBLE WHEN share < 0.15::DOUBLE THEN -0.10::DOUBLE ELSE 0::DOUBLE END)) END AS ext,
            CASE WHEN size = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, least(0.95::DOUBLE, 0.50::DOUBLE
                + CASE WHEN sentence AND size > 80 THEN 0.30::DOUBLE WHEN sentence THEN 0.20::DOUBLE WHEN size > 50 THEN 0.10::DOUBLE ELSE 0::DOUBLE END
                + CASE WHEN words >= 5 THEN 0.05::DOUBLE WHEN words = 1 THEN -0.15::DOUBLE ELSE 0::DOUBLE END
                + CASE WHEN share > 0.6::DOUBLE THEN 0.05::DOUBLE WHEN share < 0.3::DOUBLE THEN -0.10::DOUBLE ELSE 0::DOUBLE END + CASE WHEN size < 5 THEN -0.15::DOUBLE ELSE 0::DOUBLE END)) END AS cls
        FROM sentences
    )"""


def block_review_load(spark, sf_dir):
    """Blocks of each language, those that a person should review, and the mean confidence."""
    rows = lines(spark, sf_dir).withColumn("clean", t.collapse(F.col("line")))
    rows = rows.withColumn("conf", t.least_confidence(F.col("clean")))
    return rows.groupBy("lang").agg(F.count("*").alias("blocks"), F.count_if(F.col("conf") < review.THRESHOLD).alias("flagged"), F.round(F.avg("conf"), 6).alias("mean_conf"))


def normalize_blocks(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("line", F.concat(F.lit("  "), F.replace(F.col("line"), F.lit(", "), F.lit(",  \t")))).withColumn("m", t.normalized(F.col("line")))
    return rows.select("doc_id", "n", F.sha2("m.text", 256).alias("text_hash"), F.col("m.changed").alias("changed"), F.round("m.confidence", 6).alias("confidence"))


def span_review(spark, sf_dir):
    """Lines whose white space costs their span so much confidence that a person should look at it."""
    nodes = line_nodes(spark, sf_dir, F.concat(F.lit("  "), F.replace("line", F.lit(", "), F.lit(",  \t")))).filter("kind = 'paragraph'")
    tasks = review.flag(nodes, parts=review.span_parts(nodes))
    return tasks.select(F.col("doc_id").cast("long").alias("doc_id"), F.element_at(F.split("node_id", "/"), 2).cast("int").alias("n"), F.round("conf", 6).alias("conf"))


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(t.token_estimate(F.col("text"))).cast("long").alias("tokens"), F.max(t.token_estimate(F.col("text"))).alias("most"))


def extraction_confidence(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "n", F.round(t.extraction_confidence(F.col("line")), 6).alias("confidence"))


def classification_confidence(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "n", F.round(t.classification_confidence(F.col("line")), 6).alias("confidence"))


def ocr_garbage_rate(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.groupBy("lang").agg(F.count("*").alias("blocks"), F.count_if(t.is_garbage(F.col("line"))).alias("strict"), F.count_if(t.is_garbage(F.col("line"), ascii_only=False)).alias("sane"))


def _lines_as_nodes(spark, sf_dir):
    return line_nodes(spark, sf_dir).filter("kind = 'paragraph'")


def entity_registry(spark, sf_dir):
    once, _ = analyzers.entities(_lines_as_nodes(spark, sf_dir))
    return once.select(F.col("doc_id").cast("long").alias("doc_id"), F.upper("name").alias("name"), "entity_type")


def entity_mentions(spark, sf_dir):
    once, found = analyzers.entities(_lines_as_nodes(spark, sf_dir))
    named = found.join(once.select("doc_id", "entity_id", "entity_type", F.upper("name").alias("name")), ["doc_id", "entity_id"])
    return named.groupBy("entity_type", "name").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


def mention_offsets(spark, sf_dir):
    """Mentions that repeat, and that begin like others, after the text of each line."""
    nodes = line_nodes(spark, sf_dir, F.concat("line", F.lit(" R10 then R1 and R1: MOV R1 0xFF MOV"))).filter("kind = 'paragraph'")
    once, found = analyzers.entities(nodes)
    named = found.join(once.select("doc_id", "entity_id", F.col("entity_type")), ["doc_id", "entity_id"])
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), number().alias("n"), "entity_type", "start")


def script_share_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", t.script_share(F.col("text"), "Cyrillic").alias("cyrillic"), t.script_share(F.col("text"), "Latin").alias("latin"))


def latex_escaped(spark, sf_dir):
    marked = F.concat(F.replace(F.col("text"), F.lit(","), F.lit("_")), F.lit(" 50% #1 {a} ~x^2 \\ &"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.latex_escape(marked), 256).alias("tex_hash"))


def _marks() -> Column:
    """Marks for lines by their number."""
    marks = ("• ", "12. ", "b) ", "iv. ", "⚠ Warning: ", "Note: ", "[7] ", "¹² ", "* ", "Figure 2-3 ", "Table 4 ", "1.2 ")
    out = F.lit("")
    for k, m in enumerate(marks):
        out = F.when((F.col("doc_id") + F.col("n")) % 16 == k, m).otherwise(out)
    return out


MARKED = "marked AS (SELECT doc_id, n, CASE (doc_id + n) % 16 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(("• ", "12. ", "b) ", "iv. ", "⚠ Warning: ", "Note: ", "[7] ", "¹² ", "* ", "Figure 2-3 ", "Table 4 ", "1.2 "))) + " ELSE '' END || line AS line FROM lines)"


def _marked(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "n", F.concat(_marks(), "line").alias("line"))


def list_markers(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("m", markers.list_marker(F.col("line"))).filter("m is not null")
    return rows.select("doc_id", "n", "m.style", "m.marker", F.char_length("m.rest").alias("rest_chars"))


def callout_labels(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("m", markers.callout(F.col("line"))).filter("m is not null")
    return rows.select("doc_id", "n", "m.kind", "m.severity", "m.label", F.char_length("m.rest").alias("rest_chars"))


def footnote_markers(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("m", markers.footnote_marker(F.col("line"))).filter("m is not null")
    return rows.select("doc_id", "n", "m.marker", "m.number", F.char_length("m.rest").alias("rest_chars"))


def caption_labels(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("m", markers.caption(F.col("line"))).filter("m is not null")
    return rows.select("doc_id", "n", "m.target", "m.label", F.char_length("m.rest").alias("rest_chars"))


def bib_entries(spark, sf_dir):
    line = F.concat(F.when(F.col("n") % 2 == 0, "[7] ").otherwise(""), F.lit("Knuth, D. The Art, "), F.col("line"), F.lit(" (1968)."))
    rows = lines(spark, sf_dir).withColumn("e", markers.bib_entry(line))
    return rows.select("doc_id", "n", "e.key", F.get("e.authors", F.lit(0)).alias("first_author"), F.size("e.authors").alias("n_authors"), "e.year", F.char_length("e.title").alias("title_chars"))


def toc_entries(spark, sf_dir):
    line = F.concat(F.when(F.col("n") % 2 == 0, F.concat((F.col("n") + 1).cast("string"), F.lit(". "))).otherwise(""), "line", F.lit(" ..... "), (F.col("n") + 3).cast("string"))
    rows = lines(spark, sf_dir).withColumn("line", line).withColumn("e", markers.toc_entry(F.col("line")))
    return rows.select("doc_id", "n", markers.looks_like_toc(F.col("line")).alias("is_toc"), F.sha2("e.text", 256).alias("text_hash"), "e.number", "e.page")


def glued_toc_lines(spark, sf_dir):
    line = F.concat(F.lit("Section 2 "), "line", F.lit(" .... 12 2."), (F.col("n") + 1).cast("string"), F.lit(" Second 15 Appendix A Tables xii"))
    rows = lines(spark, sf_dir).select("doc_id", "n", F.posexplode(markers.toc_lines(line)).alias("k", "part")).withColumn("e", markers.toc_line(F.col("part")))
    return rows.select("doc_id", "n", "k", "e.level", "e.number", "e.page", F.sha2("e.display", 256).alias("display_hash"))


def formula_lines(spark, sf_dir):
    line = F.when(F.col("n") % 3 == 0, F.concat(F.lit("x_1 = (a + 2) * "), F.col("n").cast("string"), F.lit(" (2."), F.col("n").cast("string"), F.lit(")"))).when(F.col("n") % 3 == 1, F.lit("∑∫ α → β")).otherwise(F.col("line"))
    rows = lines(spark, sf_dir).withColumn("f", markers.formula(line, F.when(F.col("n") % 7 == 0, "CMMI10").otherwise("Times"))).filter("f is not null")
    return rows.select("doc_id", "n", F.char_length("f.latex").alias("chars"), "f.number", "f.signal")


def artifact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("content"), F.lit("document").alias("type"), "source", F.col("doc_id").alias("seq"))
    return artifacts.put_artifacts(docs.withColumnRenamed("source", "producer")).select("artifact_id", "producer", "seq", "size")


def gc_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("artifact_id"), "doc_id", "lang")
    snapshots = docs.filter("lang = 'de'").groupBy(F.col("lang").alias("snapshot_id")).agg(F.collect_set("artifact_id").alias("refs"))
    pins = docs.filter("doc_id % 3 = 0").select("artifact_id")
    return artifacts.garbage(docs.select("artifact_id").distinct(), snapshots, pins)


def cache_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", artifacts.cache_key(F.lit("normalize"), F.lit("1.0.0"), F.array("source", "lang", F.sha2("text", 256)), F.lit("{}")).alias("cache_key"))


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", t.classification_confidence(F.col("text")).alias("p"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def calibration_bins(spark, sf_dir):
    b = evaluation.calibration_bins(_labelled(spark, sf_dir), "p", "quality")
    return b.select("bin", "n", F.round("mean_conf", 6).alias("mean_conf"), F.round("accuracy", 6).alias("accuracy"))


def calibration_ece(spark, sf_dir):
    return evaluation.ece(_labelled(spark, sf_dir), "p", "quality").select(F.round("ece", 6).alias("ece"))


def _passage_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", "text", F.lag("text").over(Window.orderBy("item_id")).alias("other")).filter("other is not null")


def cer_of_passages(spark, sf_dir):
    """The benchmark is a bounded query set, so its order is one window."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return _passage_pairs(spark, sf_dir).select("item_id", F.round(metrics.cer(plain(F.col("text")), plain(F.col("other"))), 6).alias("cer"))


def wer_of_passages(spark, sf_dir):
    return _passage_pairs(spark, sf_dir).select("item_id", F.round(metrics.wer(F.col("text"), F.col("other")), 6).alias("wer"))


def teds_of_grids(spark, sf_dir):
    """A row of the grid is a sentence, a cell a word; all of both texts count."""
    grid = lambda c: F.transform(F.split(c, r"\. "), lambda s: F.split(s, " "))
    return _passage_pairs(spark, sf_dir).select("item_id", F.round(metrics.teds(grid(F.col("text")), grid(F.col("other"))), 6).alias("teds"))


SKILLS = [{"name": "assembly", "keywords": ["license"], "patterns": [r"\bMOV\b", "(bad"]}, {"name": "legal", "keywords": ["copyright", "COPYRIGHT"], "patterns": []}, {"name": "mail", "keywords": [], "patterns": [r"[a-z]+@[a-z]+"]}]
PROFILES = [{"publisher": "src1", "keywords": ["the", "copyright"], "patterns": [r"\d{4}"], "recipe": "plain"}, {"publisher": "", "keywords": ["de la", "que"], "patterns": ["ción"], "recipe": "romance"}]


def skill_matches(spark, sf_dir):
    return rules.match_skills(table(spark, sf_dir, "documents").select("doc_id", "text"), SKILLS).select("doc_id", F.array_join("skills", ",").alias("skills"))


def profile_recipes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("source_uri"), "text")
    return rules.resolve_profiles(docs, PROFILES).select("doc_id", "recipe")


def _pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.when(F.col("doc_id") % 5 == 0, "EXAMPLE 2.1 Solution: ").otherwise(""), "text", F.when(F.col("doc_id") % 7 == 0, "\n1. A MOV AX, 1").otherwise(""))
    return docs.select(F.floor(F.col("doc_id") / 20).alias("chapter"), (F.col("doc_id") % 20).alias("page"), F.when(F.col("doc_id") % 11 != 3, text).alias("final"), F.lit(None).cast("string").alias("original"), (F.col("doc_id") % 13 == 0).alias("has_debug"))


def page_issues(spark, sf_dir):
    return rules.page_issues(_pages(spark, sf_dir)).select("chapter", "page", "category", "severity")


def page_report(spark, sf_dir):
    return rules.page_report(_pages(spark, sf_dir))


def taxonomy_report(spark, sf_dir):
    rows = lines(spark, sf_dir)
    category = F.when(t.is_garbage(F.col("line")), "text").when(F.char_length("line") > 200, "layout").otherwise("graph")
    errors = rows.select("lang", category.alias("category"), F.when(F.col("n") % 10 == 0, "Critical").otherwise("minor").alias("severity"))
    return evaluation.taxonomy_report(errors, ["lang"]).select("lang", "total", "blocking", F.to_json("counts").alias("counts"))


QUERIES = {f.__name__: f for f in (block_review_load, normalize_blocks, span_review, token_estimate, extraction_confidence, classification_confidence, ocr_garbage_rate, entity_registry, entity_mentions, mention_offsets, script_share_report, latex_escaped, list_markers, callout_labels, footnote_markers, caption_labels, bib_entries, toc_entries, glued_toc_lines, formula_lines, artifact_dedup, gc_candidates, cache_key, calibration_bins, calibration_ece, cer_of_passages, wer_of_passages, teds_of_grids, skill_matches, profile_recipes, page_issues, page_report, taxonomy_report)}

WORD = "MOV|ADD|SUB|MUL|DIV|LDR|STR|CMP|BNE|BEQ|BGT|BLT|BGE|BLE|AND|ORR|EOR|LSL|LSR|ASR|NOP|SWI|SVC|BL|BX|PUSH|POP|LDM|STM"
# RE2 has ASCII word ends; text is padded so that letters like É count as letters of a word.
MENTIONS = f"""found AS (
        SELECT doc_id, unnest(list_transform(list_filter(regexp_extract_all(regexp_replace(line, '([^\\p{{L}}\\p{{N}}_]+)', ' ', 'g') || ' ', '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, 'R1[0-5]|R[0-9]|{WORD}|0x[0-9A-Fa-f]{{2,}}')),
            lambda w: CASE WHEN regexp_full_match(w, 'R1[0-5]|R[0-9]') THEN 'register' WHEN regexp_full_match(w, '{WORD}') THEN 'instruction' ELSE 'concept_term' END || ':' || upper(w))) AS e FROM lines
    ), named AS (SELECT doc_id, split_part(e, ':', 1) AS entity_type, split_part(e, ':', 2) AS name FROM found)"""
LABELLED = f"""lines AS (SELECT doc_id, text AS line FROM documents), {MEASURES}, p AS (SELECT cls AS p, quality FROM confident JOIN labels USING (doc_id)),
    binned AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS c, avg(quality) AS a FROM p GROUP BY 1)"""
PAGES = """pages2 AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS chapter, doc_id % 20 AS page, doc_id % 13 = 0 AS has_debug,
        CASE WHEN doc_id % 11 <> 3 THEN CASE WHEN doc_id % 5 = 0 THEN 'EXAMPLE 2.1 Solution: ' ELSE '' END || text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '1. A MOV AX, 1' ELSE '' END ELSE '' END AS t FROM documents),
    seen AS (SELECT *, page - min(page) OVER (PARTITION BY chapter) AS k FROM pages2),
    issues AS (SELECT chapter, page, unnest(list_filter([
        CASE WHEN regexp_matches(t, '(?i)EXAMPLE\\s+\\d+\\.\\d+') AND NOT regexp_matches(t, '(?i)ПРИМЕР\\s+\\d+\\.\\d+') THEN 'untranslated:error' END,
        CASE WHEN regexp_matches(t, '(?i)Solution:') AND NOT regexp_matches(t, '(?i)Решение:') THEN 'untranslated:warning' END,
        CASE WHEN contains(t, chr(65533)) THEN 'corrupt_text:error' END,
        CASE WHEN contains(t, chr(8203)) OR contains(t, chr(8204)) OR contains(t, chr(8205)) OR contains(t, chr(65279)) THEN 'problematic_unicode:warning' END,
        CASE WHEN contains(t, 'MOV AX,') AND NOT regexp_matches(t, '`|lstlisting|\\\\texttt') THEN 'unformatted_code:warning' END,
        CASE WHEN regexp_matches(t, '\\n\\d+\\.\\s+[A-ZА-Я]') AND NOT contains(t, '\\begin{enumerate}') THEN 'numbered_lists:warning' END,
        CASE WHEN has_debug AND NOT contains(t, '```') AND NOT contains(t, '\\begin{lstlisting}') THEN 'debug_blocks:error' END], lambda x: x IS NOT NULL)) AS i FROM seen WHERE k < 16)"""

ORACLE_SQL = {
    "block_review_load": f"WITH {LINES}, {MEASURES} SELECT lang, count(*) AS blocks, count(*) FILTER (least(ext, cls) < 0.8::DOUBLE) AS flagged, round(avg(least(ext, cls)), 6) AS mean_conf FROM confident GROUP BY lang",
    "normalize_blocks": f"""WITH {LINES}, dirty AS (SELECT doc_id, n, '  ' || replace(line, ', ', ',  ' || chr(9)) AS d FROM lines), clean AS (SELECT *, trim(regexp_replace(d, '\\s+', ' ', 'g')) AS c FROM dirty)
        SELECT doc_id, n::INT AS n, sha256(c) AS text_hash, c <> d AS changed, CASE WHEN c <> d THEN round(greatest(0.5::DOUBLE, 1::DOUBLE - abs(length(d) - length(c)) / greatest(length(d), 1)), 6) END AS confidence FROM clean""",
    "span_review": f"""WITH {LINES}, dirty AS (SELECT doc_id, n, '  ' || replace(line, ', ', ',  ' || chr(9)) AS d FROM lines), clean AS (SELECT *, trim(regexp_replace(d, '\\s+', ' ', 'g')) AS c FROM dirty),
            m AS (SELECT doc_id, n, CASE WHEN c <> d THEN greatest(0.5::DOUBLE, 1::DOUBLE - abs(length(d) - length(c)) / greatest(length(d), 1)) ELSE 1 END AS conf FROM clean)
        SELECT doc_id, n::INT AS n, round(conf, 6) AS conf FROM m WHERE conf < 0.8::DOUBLE""",
    "token_estimate": "WITH e AS (SELECT source, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS k FROM documents) SELECT source, CAST(sum(k) AS BIGINT) AS tokens, CAST(max(k) AS INT) AS most FROM e GROUP BY source",
    "extraction_confidence": f"WITH {LINES}, {MEASURES} SELECT doc_id, n::INT AS n, round(ext, 6) AS confidence FROM confident",
    "classification_confidence": f"WITH {LINES}, {MEASURES} SELECT doc_id, n::INT AS n, round(cls, 6) AS confidence FROM confident",
    "ocr_garbage_rate": f"""WITH {LINES}, {MEASURES}, w AS (SELECT lang, size, share,
            len(list_filter(regexp_extract_all(s, '[A-Za-z]{{3,}}'), lambda x: regexp_matches(x, '[aeiouAEIOUyY]') AND len(list_distinct(string_split(lower(x), ''))) >= 2)) AS strict_words,
            len(list_filter(regexp_extract_all(s, '\\p{{L}}{{3,}}'), lambda x: (regexp_matches(x, '[aeiouAEIOUyY]') OR strlen(x) > length(x)) AND len(list_distinct(string_split(lower(x), ''))) >= 2)) AS sane_words FROM sentences)
        SELECT lang, count(*) AS blocks, count(*) FILTER (size >= 4 AND (share < 0.5::DOUBLE OR strict_words = 0)) AS strict, count(*) FILTER (size >= 4 AND (share < 0.5::DOUBLE OR sane_words = 0)) AS sane FROM w GROUP BY lang""",
    "entity_registry": f"WITH {LINES}, {MENTIONS} SELECT DISTINCT doc_id, name, entity_type FROM named",
    "entity_mentions": f"WITH {LINES}, {MENTIONS} SELECT entity_type, name, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM named GROUP BY ALL",
    "mention_offsets": f"""WITH {LINES}, said AS (SELECT doc_id, n, line || ' R10 then R1 and R1: MOV R1 0xFF MOV' AS t FROM lines), marked AS (SELECT *, regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') AS s FROM said),
            parts AS (SELECT doc_id, n, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) AS k FROM marked),
            placed AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id, n ORDER BY k) - length(w) - 1 AS start FROM parts)
        SELECT doc_id, n::INT AS n, CASE WHEN regexp_full_match(w, 'R1[0-5]|R[0-9]') THEN 'register' WHEN regexp_full_match(w, '{WORD}') THEN 'instruction' ELSE 'concept_term' END AS entity_type, start::INT AS start
        FROM placed WHERE regexp_full_match(w, 'R1[0-5]|R[0-9]|{WORD}|0x[0-9A-Fa-f]{{2,}}')""",
    "script_share_report": "SELECT doc_id, floor(100 * length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) / nullif(length(text), 0) + 0.5)::INT AS cyrillic, floor(100 * length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / nullif(length(text), 0) + 0.5)::INT AS latin FROM documents",
    "latex_escaped": r"""WITH m AS (SELECT doc_id, replace(text, ',', '_') || ' 50% #1 {a} ~x^2 \ &' AS t FROM documents)
        SELECT doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '\', chr(1)), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}')) AS tex_hash FROM m""",
    "list_markers": f"""WITH {LINES}, {MARKED}, m AS (SELECT *, regexp_extract(line, '^\\s*(?:[•·‣∙◦▪▫■□●○*\\-–—]|\\d{{1,3}}[.)]|(?i:[a-zа-я])[.)]|(?i:[ivxlcdm]+)[.)])\\s+', 0) AS head FROM marked)
        SELECT doc_id, n::INT AS n, CASE WHEN regexp_matches(head, '\\d') THEN 'ordered' WHEN NOT regexp_matches(head, '[.)]') THEN 'bullet' WHEN length(trim(head)) > 2 THEN 'roman' ELSE 'alpha' END AS style,
            trim(head) AS marker, (length(line) - length(head))::INT AS rest_chars FROM m WHERE head <> ''""",
    "callout_labels": f"""WITH {LINES}, {MARKED} SELECT doc_id, n::INT AS n, CASE WHEN line LIKE '⚠%' THEN 'warning' ELSE 'note' END AS kind, CASE WHEN line LIKE '⚠%' THEN 'warning' ELSE 'info' END AS severity,
            CASE WHEN line LIKE '⚠%' THEN '⚠ Warning' ELSE 'Note' END AS label, length(regexp_replace(line, '^(⚠ Warning:|Note:)\\s*', ''))::INT AS rest_chars FROM marked WHERE line LIKE '⚠ Warning:%' OR line LIKE 'Note:%'""",
    "footnote_markers": f"""WITH {LINES}, {MARKED}, m AS (SELECT *, regexp_extract(line, '^\\s*(?:[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\\d{{1,3}}[.)]|[*†‡§¶])\\s+', 0) AS head FROM marked)
        SELECT doc_id, n::INT AS n, trim(head) AS marker, try_cast(regexp_extract(translate(head, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), '\\d+') AS BIGINT) AS number, (length(line) - length(head))::INT AS rest_chars FROM m WHERE head <> ''""",
    "caption_labels": f"""WITH {LINES}, {MARKED}, m AS (SELECT *, regexp_extract(line, '^(?i:(Figure|Fig\\.|Table|Example))\\s+(\\d+[-–.]\\d+|\\d+)\\s*', ['kind', 'label']) AS c, regexp_extract(line, '^(?i:Figure|Fig\\.|Table|Example)\\s+(?:\\d+[-–.]\\d+|\\d+)\\s*', 0) AS head FROM marked)
        SELECT doc_id, n::INT AS n, CASE WHEN lower(c.kind) IN ('figure', 'fig.') THEN 'figure' ELSE lower(c.kind) END AS target, c.label AS label, (length(line) - length(head))::INT AS rest_chars FROM m WHERE head <> ''""",
    "bib_entries": f"""WITH {LINES}, r AS (SELECT doc_id, n, trim(regexp_replace('Knuth, D. The Art, ' || line || ' (1968).', '\\s+', ' ', 'g')) AS body FROM lines),
            y AS (SELECT *, regexp_extract(regexp_replace(body, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '(?:^| )(1[89]\\d{{2}}|20\\d{{2}}|21\\d{{2}})(?: |$)', 1)::INT AS year, regexp_extract(body, '^Knuth, D\\.\\s+(.*)$', 1) AS rest FROM r)
        SELECT doc_id, n::INT AS n, CASE WHEN n % 2 = 0 THEN '7' ELSE 'knuth' || year END AS key, 'Knuth' AS first_author, 2 AS n_authors, year,
            length(trim(CASE WHEN regexp_matches(rest, '^[^.]{{2,300}}\\.') THEN regexp_extract(rest, '^([^.]{{2,300}})\\.', 1) ELSE rest END))::INT AS title_chars FROM y""",
    "toc_entries": f"""WITH {LINES}, l AS (SELECT doc_id, n, CASE WHEN n % 2 = 0 THEN (n + 1) || '. ' ELSE '' END || line || ' ..... ' || (n + 3) AS line FROM lines),
            c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\.{{2,}}', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM l),
            e AS (SELECT *, trim(regexp_replace(t, '\\s(\\d{{1,4}})\\s*$', '')) AS x, trim(regexp_replace(trim(line), '\\s(\\d{{1,4}})\\s*$', '')) AS y FROM c)
        SELECT doc_id, n::INT AS n, length(trim(line)) BETWEEN 5 AND 120 AND len(list_filter(regexp_split_to_array(y, '\\s+'), lambda w: length(w) >= 3 AND regexp_matches(w, '\\p{{L}}'))) > 0 AS is_toc, sha256(x) AS text_hash,
            CASE WHEN regexp_matches(x, '^\\d+(\\.\\d+){{0,3}}\\.?\\s+') THEN regexp_extract(x, '^(\\d+(?:\\.\\d+){{0,3}}\\.?)\\s+', 1) WHEN regexp_matches(x, '^[A-ZА-ЯЁa-zа-яё][.)]\\s+') THEN left(x, 1) || '.' WHEN regexp_matches(x, '^[IVXLCDM]+[.)]\\s+') THEN regexp_extract(x, '^([IVXLCDM]+)', 1) || '.'
                WHEN regexp_matches(x, '^(Chapter|Part|Section|Appendix)\\s+\\w+\\s+') THEN regexp_extract(x, '^((?:Chapter|Part|Section|Appendix)\\s+\\w+)', 1) END AS number, (n + 2)::INT AS page FROM e""",
    "formula_lines": f"""WITH {LINES}, {MEASURES}, f AS (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN 'x_1 = (a + 2) * ' || n || ' (2.' || n || ')' WHEN n % 3 = 1 THEN '∑∫ α → β' ELSE line END AS l, n % 7 = 0 AS font FROM lines),
            g AS (SELECT *, trim(l) AS s, length(regexp_replace(trim(l), '[^\\p{{L}}]', '', 'g')) AS a, length(regexp_replace(trim(l), '[^0-9+\\-*/^=()\\[\\]{{}}]', '', 'g')) AS d, regexp_extract(rtrim(l), '[(\\[]\\s*([0-9.]+)\\s*[)\\]]\\s*$', 1) AS num FROM f)
        SELECT doc_id, n::INT AS n, length(CASE WHEN num <> '' THEN rtrim(regexp_replace(rtrim(l), '[(\\[]\\s*[0-9.]+\\s*[)\\]]\\s*$', '')) ELSE l END)::INT AS chars, nullif(num, '') AS number, CASE WHEN font THEN 'font' ELSE 'density' END AS signal
        FROM g WHERE s <> '' AND (font OR n % 3 = 1 OR (length(s) <= 60 AND contains(s, '=') AND len(regexp_split_to_array(s, '\\s+')) <= 8 AND a > 0 AND d > 0 AND d / greatest(1, a) >= 0.5))""",
    "artifact_dedup": "SELECT sha256(text) AS artifact_id, arg_min(source, doc_id) AS producer, min(doc_id) AS seq, max(strlen(text))::BIGINT AS size FROM documents GROUP BY 1",
    "gc_candidates": "SELECT DISTINCT sha256(text) AS artifact_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de' OR doc_id % 3 = 0)",
    "cache_key": """SELECT doc_id, sha256('{"analyzer":"normalize","config":"{}","inputs":["' || array_to_string(list_sort([source, lang, sha256(text)]), '","') || '"],"version":"1.0.0"}') AS cache_key FROM documents""",
    "calibration_bins": f"WITH {LABELLED} SELECT i::INT AS bin, coalesce(n, 0) AS n, coalesce(round(c, 6), 0) AS mean_conf, coalesce(round(a, 6), 0) AS accuracy FROM range(10) r(i) LEFT JOIN binned ON bin = i",
    "calibration_ece": f"WITH {LABELLED} SELECT coalesce(round(sum(n * abs(a - c)) / sum(n), 6), 0) AS ece FROM binned",
    "cer_of_passages": "WITH a AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM benchmark), p AS (SELECT item_id, text, lag(text) OVER (ORDER BY item_id) AS other FROM a) SELECT item_id, round(levenshtein(text, other) / length(text)::DOUBLE, 6) AS cer FROM p WHERE other IS NOT NULL",
    "skill_matches": r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'license') OR regexp_matches(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'), '(^| )MOV( |$)') THEN 'assembly' END,
        CASE WHEN contains(lower(text), 'copyright') THEN 'legal' END, CASE WHEN regexp_matches(text, '[a-z]+@[a-z]+') THEN 'mail' END], lambda x: x IS NOT NULL), ',') AS skills FROM documents""",
    "profile_recipes": r"""WITH s AS (SELECT doc_id, source || ' ' || lang || ' ' || left(text, 5000) AS t FROM documents), p AS (SELECT doc_id,
            2 * contains(lower(t), 'src1')::INT + contains(lower(t), 'the')::INT + contains(lower(t), 'copyright')::INT + 2 * regexp_matches(t, '\d{4}')::INT AS a,
            contains(lower(t), 'de la')::INT + contains(lower(t), 'que')::INT + 2 * contains(t, 'ción')::INT AS b FROM s)
        SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN 'plain' ELSE 'romance' END AS recipe FROM p""",
    "page_issues": f"WITH {PAGES} SELECT chapter, page, split_part(i, ':', 1) AS category, split_part(i, ':', 2) AS severity FROM issues",
    "page_report": f"""WITH {PAGES}, by_chapter AS (SELECT chapter, count(*) FILTER (t <> '') AS found, count(*) FILTER (t = '') AS missing, string_agg(t, '') AS a FROM pages2 GROUP BY 1),
            faults AS (SELECT chapter, count(*) FILTER (i LIKE '%:error') AS e, count(*) FILTER (i LIKE '%:warning') AS w FROM issues GROUP BY 1)
        SELECT chapter, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(e, 0) = 0 AS passed, found, missing,
            coalesce(floor(100 * length(regexp_replace(a, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) / nullif(length(a), 0) + 0.5)::INT, 74) AS russian, coalesce(floor(100 * length(regexp_replace(a, '[^a-zA-Z]', '', 'g')) / nullif(length(a), 0) + 0.5)::INT, 18) AS english
        FROM by_chapter LEFT JOIN faults USING (chapter)""",
    "taxonomy_report": f"""WITH {LINES}, {MEASURES}, w AS (SELECT *, len(list_filter(regexp_extract_all(s, '[A-Za-z]{{3,}}'), lambda x: regexp_matches(x, '[aeiouAEIOUyY]') AND len(list_distinct(string_split(lower(x), ''))) >= 2)) AS good FROM sentences),
            c AS (SELECT lang, n, CASE WHEN size >= 4 AND (share < 0.5::DOUBLE OR good = 0) THEN 'text' WHEN length(line) > 200 THEN 'layout' ELSE 'graph' END AS category FROM w),
            k AS (SELECT lang, category, count(*) AS m, count(*) FILTER (n % 10 = 0) AS b FROM c GROUP BY ALL)
        SELECT lang, CAST(sum(m) AS BIGINT) AS total, CAST(sum(b) AS BIGINT) AS blocking, '{{' || string_agg('"' || category || '":' || m, ',' ORDER BY category) || '}}' AS counts FROM k GROUP BY lang""",
}
