"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from quire.llm import spelling
from quire.llm.queries import op13_spelling


def near(u: str, v: str) -> bool:
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def pairs_of(words):
    return sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))


def expected(docs, every=199, least_length=6, least_n=5, ratio=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                gap = h % len(run)
                run = run[:gap] + run[gap + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    beside = {w: [] for w in words}
    for u, v in pairs_of(words):
        beside[u].append(v)
        beside[v].append(u)
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(beside[w]), form[w] and words[form[w]]) for w, n in words.items())


def words_at_random(n, letters="abé×", most=8, seed=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)})


def test_walk_finds_each_pair_once():
    words = words_at_random(600)
    assert sorted(tuple(sorted(p)) for p in spelling.near_in(words, 0)) == pairs_of(words)
    assert list(spelling.near_in([], 0)) == []


def test_walk_of_very_long_words():
    a = "x" * 20_000
    words = [a, a + "y", "y" + a, a[:9000] + "z" + a[9001:], a + "yy"]
    assert sorted(tuple(sorted(p)) for p in spelling.near_in(words, 0)) == pairs_of(words)


@pytest.mark.parametrize("group", [5, 60, 20_000])
def test_pairs_hang_on_no_split(spark, group):
    words = words_at_random(500)
    got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), group).collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in got) == pairs_of(words)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    stems = ["Éclairs", "strasse", "straße", "letters", "letterss", "lettersss", "lettres", "abcdef", "abcdeg", "abcdefg", "naïveté", "NAÏVETÉ", "short", "don't-know", "ÿÿÿÿÿÿ"]
    docs = [(k, " ".join(rng.choice(stems[: rng.randint(1, len(stems))]) for _ in range(rng.randint(0, 90)))) for k in range(120)]
    docs += [(7, docs[7][1]), (None, "letters " * 40), (200, None), (201, ""), (202, "letters" * 3000)] + [(300 + k, "lattersx " * 2) for k in range(4)]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_spelling(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == expected(docs)
    assert any(r[1] for r in got)


def test_forms_follow_to_the_last_and_ties_go_to_the_smallest(spark):
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aaaaac": 5, "zzzzzz": 9}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert (got["aaaaaa"].form, got["aaaaaa"].root, got["aaaaaa"].n_near) == ("aaaaab", "aaabbb", 2)
    assert (got["zzzzzz"].form, got["zzzzzz"].root, got["zzzzzz"].n_near, got["zzzzzz"].form_n) == (None, "zzzzzz", 0, None)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(none)).collect() == []
