"""Edit distance, nested tables and contents lines against plain Python."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from quire.functions import markers, metrics
from quire.operators import evaluation


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_equals_the_table(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "ab", "", None, "é", "😀", "v", "n"])
    rows = [([word() for _ in range(rng.randint(0, 12))], [word() for _ in range(rng.randint(0, 12))]) for _ in range(120)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    got = {r.k: r.d for r in df.select("k", metrics.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {k: distance(a, b) for k, (a, b) in enumerate(rows)}
    numbers = spark.createDataFrame([([1, 2, 3], [1, 3])], "a array<int>, b array<int>")
    assert numbers.select(metrics.edit_distance(F.col("a"), F.col("b"))).first()[0] == 1


def test_more_distinct_tokens_than_fit_below_the_surrogates(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda x: F.concat(F.lit("x"), x.cast("string"))).alias("a"))
    assert df.select(metrics.edit_distance(F.col("a"), F.array(F.lit("x1"), F.lit("x3")))).first()[0] == 1


def test_long_distance_is_quick(spark):
    rng = random.Random(2)
    a = [f"w{rng.randint(0, 900)}" for _ in range(5000)]
    b = [x for x in a if rng.random() > 0.1]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").persist()
    df.count()
    df.select(metrics.edit_distance(F.col("b"), F.col("b"))).first()
    began = time.perf_counter()
    assert df.select(metrics.edit_distance(F.col("a"), F.col("b"))).first()[0] == len(a) - len(b)
    assert time.perf_counter() - began < 5  # the machine may be busy; alone it takes under one


def tags(x):
    if isinstance(x, dict):
        return [t for k in sorted(x) for t in (f"<{k}>", *tags(x[k]), f"</{k}>")]
    return ["<list>", *(t for y in x for t in tags(y)), "</list>"] if isinstance(x, list) else [str(x).strip()]


def test_nested_tables(spark):
    pairs = [
        ({"rows": [[1, " a "], {"z": None, "b": True}], "a": 1.5}, {"rows": [[1, "a"], {"b": True, "z": None}], "a": 1.5}),
        ({"rows": [["a", "b"], ["c"]]}, {"rows": [["a", "b"], ["d"]], "more": {"deep": [[[]]]}}),
        ({}, {}), ({}, []), ("x", {"x": "x"}),
    ]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(pairs)] + [(9, "{", "{}"), (10, None, "{}")], "k int, a string, b string")
    got = {r.k: r.t for r in df.select("k", metrics.teds_of_json(F.col("a"), F.col("b")).alias("t")).collect()}
    for k, (a, b) in enumerate(pairs):
        x, y = tags(a), tags(b)
        assert abs(got[k] - (1 - distance(x, y) / max(len(x), len(y)) if x or y else 1)) < 1e-12
    assert got[9] is None and got[10] is None
    samples = spark.createDataFrame([(1, "a b", "a b", '{"a": [1, 2]}', '{"a": [1, 2]}'), (2, None, None, '{"a": [1, 2]}', None), (3, None, None, None, None)], "sample_id int, reference string, hypothesis string, expected_grid string, found_grid string")
    judged = {r.sample_id: (r.teds, r.passed) for r in evaluation.evaluate_samples(samples).collect()}
    assert judged == {1: (1.0, True), 2: (1 - 4 / 6, False), 3: (1.0, True)}


ENTRY = re.compile(r"^(Section|Chapter|Appendix|Part|Глава|Раздел|Приложение)?\s*([A-Z0-9]+(?:\.\d+)*)?\s*(.*?)(?:\s*[.\s]{2,}\s*|\s+)(\d{1,4}|[ivxlcdm]+)?\s*$", re.I)


def test_contents_lines_equal_one_pattern(spark):
    rng = random.Random(3)
    parts = ["Section", "part", "Глава", "Chapter", "1", "2.3", "12345", "7", "xii", "mix", "Alpha", "beta", ".", "..", "....", ". .", " ", "  ", "—", "-", "·", "a.b", "A", "ё"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", markers.toc_line(F.col("t")).alias("e"))
    got = {r.k: r.e for r in df.collect()}
    for k, text in enumerate(texts):
        t = text.strip()
        m = ENTRY.match(t)
        want = (None, t, None)
        if m:
            page = int(m[4]) if m[4] and m[4].isdigit() else None
            want = (" ".join(x for x in (m[1], m[2]) if x) or None, m[3].strip(" .·—-").strip(), page)
        assert (got[k].number, got[k].title, got[k].page) == want, text
        shown = ". ".join(x for x in want[:2] if x) or t
        assert got[k].display == (shown if want[2] is None else f"{shown} … {want[2]}") or not m
