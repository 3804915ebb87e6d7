"""Text measures as column expressions: white space, confidences, garbage, tokens, scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
MONO_FAMILIES = ("courier", "consolas", "mono", "source code", "fira code", "dejavu sans mono")
UNTITLED = "Untitled Document"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    """The words between white space; none for blank text."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def letters(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def digits(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{Nd}]+", ""))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def token_estimate(c: Column) -> Column:
    """0 if empty, else a quarter of the length, 1 at least."""
    size = F.char_length(F.coalesce(c, F.lit("")))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def normalized(c: Column) -> Column:
    """Struct: text with collapsed white space, changed, confidence (null if unchanged)."""
    text, size = collapse(c), F.char_length(c)
    lost = F.abs(size - F.char_length(text)) / F.greatest(size, F.lit(1))
    changed = text != c
    return F.struct(text.alias("text"), changed.alias("changed"), F.when(changed, F.greatest(F.lit(0.5), 1.0 - lost)).alias("confidence"))


def measured(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(m) for the text, size and letters of the stripped text, which are worked out once however often `of` asks for them."""
    first = F.transform(F.array(strip(c)), lambda t: F.struct(t.alias("text"), F.char_length(t).alias("size"), letters(t).alias("letters")))
    return F.get(F.transform(first, of), F.lit(0))


# The steps of both scores.
def _extraction(m: Column) -> Column:
    size = m["size"]
    odd = (size - F.char_length(F.regexp_replace(m["text"], r"(?:[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs})+", ""))).cast("double")
    printable, alpha = 1.0 - odd / size, m["letters"] / size
    score = F.lit(0.55) + F.when(size >= 30, 0.20).when(size >= 10, 0.10).when(size < 3, -0.10).otherwise(0.0) + printable * 0.10
    score = score + F.when(alpha > 0.5, 0.05).when(alpha < 0.15, -0.10).otherwise(0.0)
    return F.when(size == 0, 0.1).otherwise(clamp(score, 0.10, 0.95))


def _classification(m: Column) -> Column:
    def score(x: Column) -> Column:
        size, count = m["size"], x["words"]
        sentence, alpha = x["stop"] & (count > 3), m["letters"] / size
        points = F.lit(0.50) + F.when(sentence & (size > 80), 0.30).when(sentence, 0.20).when(size > 50, 0.10).otherwise(0.0)
        points = points + F.when(count >= 5, 0.05).when(count == 1, -0.15).otherwise(0.0)
        return points + F.when(alpha > 0.6, 0.05).when(alpha < 0.3, -0.10).otherwise(0.0) + F.when(size < 5, -0.15).otherwise(0.0)

    more = F.struct((F.regexp_count(m["text"], F.lit(SPACE)) + 1).alias("words"), F.contains(m["text"], F.lit(".")).alias("stop"))
    return F.when(m["size"] == 0, 0.10).otherwise(clamp(F.get(F.transform(F.array(more), score), F.lit(0)), 0.10, 0.95))


def extraction_confidence(c: Column) -> Column:
    return measured(c, _extraction)


def classification_confidence(c: Column) -> Column:
    return measured(c, _classification)


def least_confidence(c: Column) -> Column:
    """The lesser of both, of one reading of the text."""
    return measured(c, lambda m: F.least(_extraction(m), _classification(m)))


def is_garbage(c: Column, ascii_only: bool = True) -> Column:
    """Debris of scanned pictures: under half letters, or no proper word of three letters with a vowel and two different letters.

    ascii_only counts words of A-Z alone, so text in other scripts is garbage; otherwise words are of any letters, and vowels are asked of A-Z words only.
    """
    text = strip(c)
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})" if ascii_only else r"(\p{L}{3,})"), F.lit(1))
    vowel = (lambda w: w.rlike("[aeiouAEIOUyY]")) if ascii_only else (lambda w: w.rlike("[aeiouAEIOUyY]") | w.rlike(r"[^\x00-\x7F]"))
    proper = F.exists(found, lambda w: vowel(w) & ~F.lower(w).rlike(r"^(.)\1*$"))
    return (F.char_length(text) >= 4) & ((letters(text) / F.char_length(text) < 0.5) | ~proper)


def is_mono(font: Column) -> Column:
    name, out = F.lower(F.coalesce(font, F.lit(""))), F.lit(False)
    for family in MONO_FAMILIES:
        out = out | F.contains(name, F.lit(family))
    return out


def title_from_uri(uri: Column) -> Column:
    """The last part of the path without its extension."""
    base = F.split_part(F.element_at(F.split(F.regexp_replace(uri, r"/+$", ""), "/"), -1), F.lit("?"), F.lit(1))
    title = F.when(F.contains(base, F.lit(".")), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return F.when(F.coalesce(title, F.lit("")) == "", UNTITLED).otherwise(title)


def alignment(x0: Column, x1: Column) -> Column:
    """center, right or left, from a box on a page of width 1."""
    return F.when((F.abs((x0 + x1) / 2 - 0.5) < 0.08) & (x0 > 0.15), "center").when((x1 > 0.82) & (x0 > 0.5), "right").otherwise("left")


#: What LaTeX needs for each of its special characters.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(c: Column) -> Column:
    """Each special character once: what an escape adds isn't escaped again."""
    table = F.create_map(*(F.lit(x) for pair in LATEX.items() for x in pair))
    return F.when(c.rlike(r"[\\&%$#_{}~^]"), F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")).otherwise(c)


def script_share(c: Column, script: str) -> Column:
    """Percent of code points of a script ('Cyrillic' or 'Latin'), rounded half up; null for empty text."""
    inside = {"Cyrillic": r"[^\x{0400}-\x{04FF}]", "Latin": r"[^a-zA-Z]"}[script]
    return F.floor(100 * F.char_length(F.regexp_replace(c, inside, "")) / F.nullif(F.char_length(c), F.lit(0)) + 0.5).cast("int")


def valid_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    inside = [(v >= 0.0) & (v <= 1.0) for v in (x0, y0, x1, y1)]
    return inside[0] & inside[1] & inside[2] & inside[3] & (x0 <= x1) & (y0 <= y1)


def repaired_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a, b, c, d = (clamp(v, 0.0, 1.0) for v in (x0, y0, x1, y1))
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))
