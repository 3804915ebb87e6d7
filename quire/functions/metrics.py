"""Distances and quality figures as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import clamp, strip, words

TEDS_BAR, LINK_BAR, WER_BAR = 0.95, 0.90, 0.05


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays; nulls in them are alike. Each distinct element becomes a character of its own, and levenshtein() compares the two texts of these, in two rows of memory."""
    plain = lambda c: F.transform(c, lambda x: F.coalesce(F.concat(F.lit("v"), x.cast("string")), F.lit("n")))
    both = F.struct(plain(a).alias("a"), plain(b).alias("b"))
    known = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.concat(s["a"], s["b"])).alias("k"))

    def coded(tokens: Column, k: Column) -> Column:
        at = lambda t: F.array_position(k, t)
        point = lambda t: F.lpad(F.hex(F.when(at(t) >= 0xD800, at(t) + 0x800).otherwise(at(t))), 8, "0")  # noqa: E731  the gap of surrogates is left out
        return F.decode(F.unhex(F.array_join(F.transform(tokens, point), "")), "UTF-32")

    # transform() over one element works out each part once
    bound = F.transform(F.transform(F.array(both), known), lambda s: F.levenshtein(coded(s["a"], s["k"]), coded(s["b"], s["k"])))
    return F.when(a.isNotNull() & b.isNotNull(), F.get(bound, F.lit(0)))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edits over the reference's words, over 1 at times; an empty reference has 0 if the other is empty too, else 1."""
    a, b = words(reference), words(hypothesis)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(a, b) / F.size(a))


def cer(reference: Column, hypothesis: Column) -> Column:
    size = F.char_length(reference)
    return F.when(size == 0, F.when(F.char_length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / size)


def grid_tags(grid: Column) -> Column:
    """The tokens of a nested list: an opening mark, the values in order and a closing mark a list."""
    row = lambda r: F.concat(F.array(F.lit("list_start")), F.transform(r, lambda v: F.concat(F.lit("v:"), strip(F.coalesce(v, F.lit("None"))))), F.array(F.lit("list_end")))
    return F.concat(F.array(F.lit("list_start")), F.flatten(F.transform(grid, row)), F.array(F.lit("list_end")))


def teds(expected: Column, found: Column) -> Column:
    """1 less the token edits over the longer one; 1 for two empty grids."""
    a, b = grid_tags(expected), grid_tags(found)
    both_empty = (F.size(expected) == 0) & (F.size(found) == 0)
    return F.when(both_empty, 1.0).otherwise(clamp(1.0 - edit_distance(a, b) / F.greatest(F.size(a), F.size(b)), 0.0, 1.0))


def _tokens(value) -> list[str]:
    """The tags and values of a JSON value in order: keys sorted, an opening and a closing tag for each, and for each list."""
    out, waiting = [], [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict):
            for key in sorted(x, reverse=True):
                waiting += [(f"</{key}>",), x[key], (f"<{key}>",)]
        elif isinstance(x, list):
            waiting += [("</list>",), *reversed(x), ("<list>",)]
        else:
            out.append(str(x).strip())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_tokens(texts: pd.Series) -> pd.Series:
    """Structure tokens of JSON texts, nested to any depth; null for what is no JSON."""

    def read(text: str | None) -> list[str] | None:
        try:
            return None if text is None else _tokens(json.loads(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(read)


def teds_of_json(expected: Column, found: Column) -> Column:
    """teds() of two tables written as JSON of any shape; null if either is none. Two without any token are alike."""
    a, b = json_tokens(expected), json_tokens(found)
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(longest == 0, 1.0).otherwise(clamp(1.0 - edit_distance(a, b) / longest, 0.0, 1.0)))


def calibrated(raw: Column, offset: Column) -> Column:
    return clamp(raw - offset, 0.0, 1.0)


def first_k_hits(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k over distinct relevant ones; a hit that comes twice counts twice."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, 0.0).otherwise(F.size(first_k_hits(retrieved, relevant, k)) / n)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    at = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    first = F.array_min(F.filter(at, lambda x: x.isNotNull()))
    return F.coalesce(1.0 / first, F.lit(0.0))


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary gain; the ideal ranking has as many hits as relevant entries, repeats included."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    best = F.least(F.size(relevant), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return F.when(best <= 0, 0.0).otherwise(F.aggregate(gains, F.lit(0.0), lambda s, g: s + g) / ideal)


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two ranges over the narrower one; 0 if that has no width."""
    width = F.least(a1 - a0, b1 - b0)
    return F.when(width <= 0, 0.0).otherwise((F.least(a1, b1) - F.greatest(a0, b0)) / width)


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in columns a_x0 ... and b_x0 ..."""
    c = lambda p, k: F.col(f"{p}_{k}")
    wide = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    high = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    return F.coalesce(wide * high / F.nullif(area(a) + area(b) - wide * high, F.lit(0.0)), F.lit(0.0))
