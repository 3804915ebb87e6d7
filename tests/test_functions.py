import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import markers, metrics, text


def values(spark, rows, **exprs):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *(e.alias(k) for k, e in exprs.items())).orderBy("i").collect()]


C = lambda: F.col("c")


def py_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_white_space_is_unicode(spark):
    got = values(spark, ["  a  b\t\n", "", " "], s=text.strip(C()), c=text.collapse(C()), n=text.n_words(C()))
    assert got == [("a  b", "a b", 2), ("", "", 0), ("", "", 0)]


def test_confidences(spark):
    rows = ["", "ab", "a" * 10, "Some plain words of a longer line, which ends in a period. And more of it.", "12345 67890 12345", "..."]
    got = values(spark, rows, e=text.extraction_confidence(C()), k=text.classification_confidence(C()))
    want = [(0.1, 0.1), (0.6, 0.25), (0.8, 0.4), (0.9, 0.8), (0.65, 0.4), (0.55, 0.1)]
    for g, w in zip(got, want):
        assert g == pytest.approx(w)


def test_long_sentence_scores_high(spark):
    (got,) = values(spark, ["A plain sentence of more than eighty characters, with quite a few words in it, ends here."], k=text.classification_confidence(C()))
    assert got[0] == pytest.approx(0.90)


def test_garbage(spark):
    rows = [", 1IIIIiK,8I ,..i!C\"'-", "abc", "Plain words", "привет мир", "xxxx zzz", "aaaa"]
    got = values(spark, rows, strict=text.is_garbage(C()), sane=text.is_garbage(C(), ascii_only=False))
    assert got == [(True, True), (False, False), (False, False), (True, False), (True, True), (True, True)]


def test_titles_alignment_rects_and_latex(spark):
    got = values(spark, ["/a/b/My Book.v2.pdf?x=1", "/a/.pdf", "", "s3://b/name/"], t=text.title_from_uri(C()))
    assert [g[0] for g in got] == ["My Book.v2", "Untitled Document", "Untitled Document", "name"]
    got = values(spark, [r"a&b_{c}\^~$#%"], t=text.latex_escape(C()))
    assert got[0][0] == r"a\&b\_\{c\}\textbackslash{}\textasciicircum{}\textasciitilde{}\$\#\%"
    df = spark.createDataFrame([(0.3, 0.7), (0.6, 0.9), (0.1, 0.4)], "x0 double, x1 double")
    assert [r[0] for r in df.select(text.alignment(F.col("x0"), F.col("x1"))).collect()] == ["center", "right", "left"]
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.5, 0.0, 0.2, 1.0), (-0.1, 0.0, 1.0, 1.5)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    assert [r[0] for r in df.select(text.valid_rect(*cols)).collect()] == [True, False, False]
    assert [tuple(r[0]) for r in df.select(text.repaired_rect(*cols)).collect()] == [(0.0, 0.0, 1.0, 1.0), (0.2, 0.0, 0.5, 1.0), (0.0, 0.0, 1.0, 1.0)]


def test_token_estimate_and_shares(spark):
    got = values(spark, ["", "abc", "a" * 9, "Да yes"], t=text.token_estimate(C()), r=text.script_share(C(), "Cyrillic"), l=text.script_share(C(), "Latin"))
    assert got == [(0, None, None), (1, 0, 100), (2, 0, 100), (1, 33, 50)]


def test_list_markers(spark):
    rows = ["• one", "1. two", "12) three", "a. four", "iv) five", "i) six", "- seven", "plain", "1999. no", "б) по-русски", "1.no space"]
    got = values(spark, rows, m=markers.list_marker(C()))
    assert [tuple(g[0])[:2] if g[0] else None for g in got] == [("bullet", "•"), ("ordered", "1."), ("ordered", "12)"), ("alpha", "a."), ("roman", "iv)"), ("alpha", "i)"), ("bullet", "-"), None, None, ("alpha", "б)"), None]
    assert got[0][0].rest == "one"


def test_callouts(spark):
    rows = ["Note: see below", "WARNING! hot", "⚠ Caution: x", "💡 idea", "Внимание: осторожно", "Notes about it", "important - read", "Danger. high"]
    got = [tuple(g[0]) if g[0] else None for g in values(spark, rows, m=markers.callout(C()))]
    assert got == [("note", "info", "Note", "see below"), ("warning", "warning", "WARNING", "hot"), ("warning", "warning", "⚠ Caution", "x"), ("tip", "info", "💡", "idea"), ("warning", "warning", "Внимание", "осторожно"), None, ("important", "warning", "important", "read"), ("warning", "critical", "Danger", "high")]


def test_footnotes_formulas_captions(spark):
    got = [tuple(g[0]) if g[0] else None for g in values(spark, ["¹² text", "3. text", "† text", "text"], m=markers.footnote_marker(C()))]
    assert got == [("¹²", 12, "text"), ("3.", 3, "text"), ("†", None, "text"), None]
    got = [tuple(g[0]) if g[0] else None for g in values(spark, ["∑αβ = γ (2.1)", "f(x) = a + 2*(b^2)", "Plain prose = nothing here to see at all really, no", "x"], m=markers.formula(C(), F.lit("Times")))]
    assert got == [("∑αβ = γ", "2.1", "density"), ("f(x) = a + 2*(b^2)", None, "density"), None, None]
    assert values(spark, ["x"], m=markers.formula(C(), F.lit("CMMI10")))[0][0].signal == "font"
    got = [tuple(g[0]) if g[0] else None for g in values(spark, ["Figure 2-1 A box", "fig. 3 B", "Рис. 4.2 В", "Table 7", "Figures 2"], m=markers.caption(C()))]
    assert got == [("figure", "2-1", "A box"), ("figure", "3", "B"), ("figure", "4.2", "В"), ("table", "7", ""), None]


def test_bibliography_and_toc(spark):
    got = [g[0] for g in values(spark, ["[3] Knuth, D. The Art of Programming. Addison, 1968.", "Smith J. A Title, 2001", "no author here"], m=markers.bib_entry(C()))]
    assert (got[0].key, got[0].authors, got[0].year, got[0].title) == ("3", ["Knuth", "D"], 1968, "The Art of Programming")
    assert (got[1].key, got[1].year) == ("j2001", 2001) and (got[2].key, got[2].authors, got[2].title) == ("refnd", [], "no author here")
    rows = ["1.2  Registers .......... 45", "A. Intro 7", "IV. Fourth xii", "Chapter 5 The End 99", "Preface 3"]
    got = [tuple(g[0]) for g in values(spark, rows, m=markers.toc_entry(C()))]
    assert got == [("1.2 Registers", "1.2", 44), ("A. Intro", "A.", 6), ("IV. Fourth", "IV.", None), ("Chapter 5 The End", "Chapter 5", 98), ("Preface", None, 2)]
    assert [g[0] for g in values(spark, ["Registers 45", "45", "A b 45", "No page here", "x" * 130 + " 4"], m=markers.looks_like_toc(C()))] == [True, False, False, False, False]


def test_glued_contents_lines(spark):
    got = values(spark, ["Section 2 Addressing .... 12 2.1 Modes 15 Appendix A Tables xii"], parts=markers.toc_lines(C()))
    assert got == [(["Section 2 Addressing .... 12", "2.1 Modes 15", "Appendix A Tables xii"],)]
    got = [tuple(g[0]) for g in values(spark, got[0][0] + ["alone"], m=markers.toc_line(C()))]
    assert got == [(1, "Section 2", "Addressing", 12, "Section 2. Addressing … 12"), (2, "2.1", "Modes", 15, "2.1. Modes … 15"), (1, "Appendix A", "Tables", None, "Appendix A. Tables"), (1, None, "alone", None, "alone")]


def test_mentions(spark):
    (got,) = values(spark, ["MOV R1, #0xFF then R16 movR2 ADD"], m=markers.mentions(C()))
    assert [tuple(x) for x in got[0]] == [("register", "R1", 4), ("instruction", "MOV", 0), ("instruction", "ADD", 26), ("concept_term", "0xFF", 9)]


def test_wer_cer_and_distance(spark):
    df = spark.createDataFrame([("the quick brown fox jumps over the lazy dog", "the quick brown cat jumps over the lazy cow"), ("", ""), ("", "a"), ("a", ""), ("a b", "x y z")], "a string, b string")
    got = [r[0] for r in df.select(metrics.wer(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2 / 9, 0, 1, 1, 1.5])
    rng = random.Random(1)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(metrics.edit_distance(F.col("a"), F.col("b"))).collect()] == [py_levenshtein(a, b) for a, b in pairs]


def test_teds(spark):
    g = [["a", "b"], ["c", "d"]]
    df = spark.createDataFrame([(g, g), (g, [["a", "b"], ["c", "x"]]), ([], []), (g, [])], "a array<array<string>>, b array<array<string>>")
    got = [r[0] for r in df.select(metrics.teds(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and 0 < got[1] < 1 and got[2] == 1.0 and 0 <= got[3] < 0.5


def test_retrieval(spark):
    df = spark.createDataFrame([(["x", "a", "y", "b", "z"], ["a", "b", "c"]), (["x"], []), ([], ["a"]), (["a", "a"], ["a"])], "got array<string>, want array<string>")
    g, w = F.col("got"), F.col("want")
    rows = [tuple(r) for r in df.select(metrics.recall_at(g, w, 3), metrics.recall_at(g, w, 5), metrics.reciprocal_rank(g, w), metrics.ndcg_at(g, w, 5)).collect()]
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert rows[0] == pytest.approx((1 / 3, 2 / 3, 0.5, (1 / math.log2(3) + 1 / math.log2(5)) / ideal))
    assert rows[1] == (0, 0, 0, 0) and rows[2] == (0, 0, 0, 0) and rows[3][0] == 2.0
