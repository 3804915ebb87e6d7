"""Parsers of marked lines: each gives a struct, or null where the line doesn't have the mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import collapse, letters, n_words, strip, words

# Characters, words and thresholds that decide which lines are marked.
BULLETS = "•·‣∙◦▪▫■□●○*\\-–—"
MATH_FONTS = ("cmmi", "cmsy", "cmex", "msam", "msbm", "stix", "symbol", "math", "mtmi", "mtsy", "mtex", "asana", "esint", "yhmath")
MATH_CHARS = "∫∑∏∐√∞±∓×÷≠≈≤≥≪≫∈∉⊂⊆⊃⊇∪∩∀∃∄∇∂ℝℤℕℚℂ∆ΩαβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨ→←↔⇒⇐⇔≡≺≻⊕⊗⊥∠"
CALLOUT_WORDS = (
    ("caution|осторожно", "caution", "critical"),
    ("warning|внимание|предупреждение", "warning", "warning"),
    ("danger|опасно", "warning", "critical"),
    ("important|важно", "important", "warning"),
    ("tip|подсказка|совет", "tip", "info"),
    ("note|заметка|замечание|примечание", "note", "info"),
    ("info|информация", "note", "info"),
)
CALLOUT_ICONS = (("⚠", "warning", "warning"), ("❗", "important", "warning"), ("‼", "warning", "critical"), ("ℹ", "note", "info"), ("💡", "tip", "info"), ("📝", "note", "info"))
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
BIBLIOGRAPHY_TITLES = ("bibliography", "references", "works cited", "литература", "библиография", "список литературы", "источники")
CAPTION_TYPES = {"figure": "figure", "fig.": "figure", "рис.": "figure", "table": "table", "таблица": "table", "example": "example", "пример": "example"}
PAGE_AT_END = r"(?U)\s(\d{1,4}|[ivxlcdm]+|[IVXLCDM]+)\s*$"
TOC_MAX, TOC_MIN = 120, 5
NUMERIC_MAX, NUMERIC_SHARE = 40, 0.3


def list_marker(c: Column) -> Column:
    """style (bullet, ordered, roman, alpha), marker, rest."""
    pattern = rf"(?iuU)^\s*(?:([{BULLETS}])|(\d{{1,3}})[.)]|([a-zа-я])[.)]|([ivxlcdm]+)[.)])\s+"
    bullet, number, alpha, roman = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3, 4))
    style = F.when(bullet != "", "bullet").when(number != "", "ordered").when(F.char_length(roman) > 1, "roman").when((alpha != "") | (roman != ""), "alpha")
    head = F.regexp_extract(c, pattern, 0)
    made = F.struct(style.alias("style"), strip(head).alias("marker"), F.substring(c, F.char_length(head) + 1, F.char_length(c)).alias("rest"))
    return F.when(c.rlike(pattern), made)


def is_math_font(font: Column) -> Column:
    name, out = F.lower(F.coalesce(font, F.lit(""))), F.lit(False)
    for hint in MATH_FONTS:
        out = out | F.contains(name, F.lit(hint))
    return out


def formula(c: Column, font: Column) -> Column:
    """latex, number (or null), signal (font or density) of a block that is a formula."""
    text = strip(c)
    size = F.char_length(text)
    density = F.char_length(F.regexp_replace(text, f"[^{MATH_CHARS}]", "")) / size
    marks = F.char_length(F.regexp_replace(text, r"[^\p{Nd}+\-*/^=()\[\]{}]", ""))
    algebra = (size <= 60) & F.contains(text, F.lit("=")) & (n_words(text) <= 8) & (letters(text) > 0) & (marks > 0) & (marks / F.greatest(F.lit(1), letters(text)) >= 0.5)
    by_font = is_math_font(font) & (size > 0)
    looks = (size > 0) & (size <= 120) & ((density >= 0.15) | algebra)
    end = r"[(\[]\s*([0-9.]+)\s*[)\]]\s*$"
    tail = F.regexp_replace(c, r"(?U)\s+$", "")
    number = F.regexp_extract(tail, end, 1)
    body = F.when(number != "", F.regexp_replace(F.regexp_replace(tail, end, ""), r"(?U)\s+$", "")).otherwise(c)
    return F.when(by_font | looks, F.struct(body.alias("latex"), F.nullif(number, F.lit("")).alias("number"), F.when(by_font, "font").otherwise("density").alias("signal")))


def _kinds(rows, at: int) -> Column:
    """A map from each word or icon to the kind (1) or severity (2) of its row."""
    return F.create_map(*(F.lit(x) for row in rows for key in row[0].split("|") for x in (key, row[at])))


def callout(c: Column) -> Column:
    """kind, severity, label, rest: an icon, perhaps with a keyword after it, or a keyword, and a separator."""
    keywords = "|".join(p for p, _, _ in CALLOUT_WORDS)
    said = rf"(?iuU)^\s*({keywords})\s*[!:.—–\-]\s*(.*)$"
    icons = rf"(?U)^\s*({'|'.join(i for i, _, _ in CALLOUT_ICONS)})[ .!:—-]*"
    icon, word = F.regexp_extract(c, icons, 1), F.regexp_extract(c, said, 1)
    after = F.regexp_replace(c, icons, "")
    named = F.regexp_extract(after, said, 1)
    by_icon = F.struct(
        F.try_element_at(_kinds(CALLOUT_ICONS, 1), icon).alias("kind"),
        F.try_element_at(_kinds(CALLOUT_ICONS, 2), icon).alias("severity"),
        F.when(named == "", icon).otherwise(F.concat_ws(" ", icon, named)).alias("label"),
        F.when(named == "", after).otherwise(F.regexp_extract(after, said, 2)).alias("rest"),
    )
    by_word = F.struct(
        F.try_element_at(_kinds(CALLOUT_WORDS, 1), F.lower(word)).alias("kind"),
        F.try_element_at(_kinds(CALLOUT_WORDS, 2), F.lower(word)).alias("severity"),
        word.alias("label"),
        F.regexp_extract(c, said, 2).alias("rest"),
    )
    return F.when(icon != "", by_icon).when(word != "", by_word)


def footnote_marker(c: Column) -> Column:
    """marker, number (null for a symbol), rest."""
    pattern = rf"(?U)^\s*(?:([{SUPERSCRIPTS}]+)|(\d{{1,3}})[.)]|([*†‡§¶]))\s+"
    high, number, symbol, head = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3, 0))
    value = F.when(high != "", F.translate(high, SUPERSCRIPTS, "0123456789")).when(number != "", number)
    marker = F.when(high != "", high).when(number != "", strip(head)).otherwise(symbol)
    made = F.struct(marker.alias("marker"), value.try_cast("bigint").alias("number"), F.substring(c, F.char_length(head) + 1, F.char_length(c)).alias("rest"))
    return F.when(c.rlike(pattern), made)


def is_bibliography_title(title: Column) -> Column:
    name, out = F.lower(strip(F.coalesce(title, F.lit("")))), F.lit(False)
    for hint in BIBLIOGRAPHY_TITLES:
        out = out | F.contains(name, F.lit(hint))
    return out


def bib_entry(c: Column) -> Column:
    """key, authors, year, title, raw."""
    raw = collapse(c)
    number = F.regexp_extract(raw, r"^\[(\d+)\]\s*(.*)$", 1)
    body = F.when(number != "", strip(F.regexp_extract(raw, r"^\[(\d+)\]\s*(.*)$", 2))).otherwise(raw)
    year = F.nullif(F.regexp_extract(body, r"(?U)\b(1[89]\d{2}|20\d{2}|21\d{2})\b", 1), F.lit("")).try_cast("int")
    split = r"^([^.]{2,120}?)\.\s+([A-ZА-Я0-9].*)$"
    field = F.regexp_replace(F.regexp_extract(body, split, 1), r"^[ .,]+|[ .,]+$", "")
    authors = F.filter(F.transform(F.split(field, r",\s+(?=[A-ZА-Я])|;\s+"), strip), lambda a: a != "")
    rest = strip(F.regexp_extract(body, split, 2))
    upto = F.regexp_extract(rest, r"^([^.]{2,300})\.", 1)
    has = body.rlike(split)
    title = F.when(has, F.when(upto != "", strip(upto)).otherwise(rest)).otherwise(body)
    authors = F.when(has, authors).otherwise(F.array().cast("array<string>"))
    last = F.lower(F.regexp_replace(F.coalesce(F.try_element_at(words(F.coalesce(F.get(authors, F.lit(0)), F.lit(""))), F.lit(-1)), F.lit("")), r"(?U)\W+", ""))
    made = F.concat(F.when(last == "", "ref").otherwise(last), F.coalesce(year.cast("string"), F.lit("nd")))
    return F.struct(F.when(number != "", number).otherwise(made).alias("key"), authors.alias("authors"), year.alias("year"), title.alias("title"), raw.alias("raw"))


def looks_like_toc(c: Column) -> Column:
    text = strip(c)
    size = F.char_length(text)
    left = strip(F.regexp_replace(text, PAGE_AT_END, ""))
    return (size >= TOC_MIN) & (size <= TOC_MAX) & text.rlike(PAGE_AT_END) & F.exists(words(left), lambda w: (F.char_length(w) >= 3) & w.rlike(r"\p{L}"))


def toc_entry(c: Column) -> Column:
    """text, number (or null), page (from 0, null if roman)."""
    text = F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.{2,}", " "), r"(?U)\s+", " ")
    page = F.regexp_extract(text, PAGE_AT_END, 1)
    left = F.when(page != "", strip(F.regexp_replace(text, PAGE_AT_END, ""))).otherwise(text)
    lead = r"(?U)^\s*(?:(\d+(?:\.\d+){0,3}\.?)|([A-ZА-ЯЁa-zа-яё])[.)]|([IVXLCDM]+)[.)]|((?:Глава|Chapter|Часть|Part|Раздел|Section|Appendix|Приложение))\s+([\d\wА-Яа-я]+))\s+"
    hier, letter, roman, word, number = (F.regexp_extract(left, lead, k) for k in (1, 2, 3, 4, 5))
    found = F.when(hier != "", hier).when(letter != "", F.concat(letter, F.lit("."))).when(roman != "", F.concat(roman, F.lit("."))).when(word != "", F.concat_ws(" ", word, number))
    return F.struct(left.alias("text"), found.alias("number"), (page.try_cast("int") - 1).alias("page"))


TOC_KINDS = "Section|Chapter|Appendix|Part|Глава|Раздел|Приложение"


def toc_lines(c: Column) -> Column:
    """The entries of a line into which a scanner has glued several: cut before a section word or a number with a dot."""
    parts = F.split(strip(c), rf"(?iuU)\s+(?=(?:{TOC_KINDS})\b|\d+\.\d)")
    return F.filter(parts, lambda p: p != "")


#: What ends such an entry (blanks or two dots, and a page), and what begins it (a word, a number).
TOC_TAIL = r"(?iuU)(?:[.\s]{2,}|\s)(\d{1,4}|[ivxlcdm]+)?$"
TOC_FRONT = rf"(?iuU)^({TOC_KINDS})?\s*([A-Z0-9]+(?:\.\d+)*)?\s*"


def toc_line(c: Column) -> Column:
    """level, number, title, page, display of one such entry; its page is printed, from 1, and null if roman. The level is one more than the number has dots. Both ends are taken off, and the title is what is left.

    What isn't an entry has a null body, and all that follows from it is null; so no part stands in a branch of its own, and each is worked out once.
    """
    text = strip(c)
    body = F.when(text.rlike(TOC_TAIL), F.regexp_replace(text, TOC_TAIL, ""))
    kind, number = F.regexp_extract(body, TOC_FRONT, 1), F.regexp_extract(body, TOC_FRONT, 2)
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, TOC_FRONT, ""), r"^[ .·—-]+|[ .·—-]+$", ""), r"(?U)^\s+|\s+$", "")
    some = lambda x: F.nullif(x, F.lit(""))
    prefix = F.concat_ws(" ", some(kind), some(number))
    page = F.regexp_extract(text, TOC_TAIL, 1).try_cast("int")
    display = F.concat_ws(" … ", F.coalesce(some(F.concat_ws(". ", some(prefix), some(title))), text), page.cast("string"))
    level = F.coalesce(F.char_length(F.regexp_replace(number, r"[^.]", "")) + 1, F.lit(1))
    return F.struct(level.alias("level"), some(prefix).alias("number"), F.coalesce(title, text).alias("title"), page.alias("page"), display.alias("display"))


def caption(c: Column) -> Column:
    """target (figure, table, example), label, rest."""
    pattern = r"(?iu)^(Figure|Fig\.|Table|Example|Пример|Таблица|Рис\.)\s+(\d+[-–.]\d+|\d+)\s*(.*)"
    table = F.create_map(*(F.lit(x) for pair in CAPTION_TYPES.items() for x in pair))
    made = F.struct(F.try_element_at(table, F.lower(F.regexp_extract(c, pattern, 1))).alias("target"), F.regexp_extract(c, pattern, 2).alias("label"), F.regexp_extract(c, pattern, 3).alias("rest"))
    return F.when(c.rlike(pattern), made)


def looks_numeric(c: Column) -> Column:
    text = strip(c)
    digits = F.char_length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    return (F.char_length(text) > 0) & (F.char_length(text) <= NUMERIC_MAX) & (digits >= 1) & (digits / F.char_length(text) >= NUMERIC_SHARE)


REGISTER, INSTRUCTION, HEX = (
    r"\b(R1[0-5]|R[0-9])\b",
    r"\b(MOV|ADD|SUB|MUL|DIV|LDR|STR|CMP|BNE|BEQ|BGT|BLT|BGE|BLE|AND|ORR|EOR|LSL|LSR|ASR|NOP|SWI|SVC|BL|BX|PUSH|POP|LDM|STM)\b",
    r"\b(0x[0-9A-Fa-f]{2,})\b",
)


def mentions(c: Column) -> Column:
    """Array of (type, name, gap): registers, instructions and hexadecimal numbers, in the order of each; gap: the characters between a mention and the one of its kind before."""
    kinds = ((REGISTER, "register"), (INSTRUCTION, "instruction"), (HEX, "concept_term"))

    def found(pattern: str, kind: str) -> Column:
        words, between = F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(1)), F.split(c, "(?U)" + pattern)
        return F.zip_with(words, F.slice(between, F.lit(1), F.size(words)), lambda w, b: F.struct(F.lit(kind).alias("type"), w.alias("name"), F.char_length(b).alias("gap")))

    return F.concat(*(found(*k) for k in kinds))
