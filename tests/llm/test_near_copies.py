import random

import numpy as np

import corpus_pipeline
from quire.llm import simhash


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06):
            texts.append(" ".join(word() if rng.random() < share else w for w in base))
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[k * 9 : k * 9 + 110]) for k in range(9)]  # neighbours alike, ends not
    return texts + ["", None, " \n", "one two", "One TWO", "one three"]


def test_components_equal_brute_force(spark):
    texts = planted()
    out = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want)) and sum(n != i for i, n in enumerate(want)) > 20
    assert sorted(r.doc_id for r in out if r.kept) == sorted(set(want))


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = planted()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(brute_components(texts)))


def test_all_candidates_between_parts_count(spark, monkeypatch):
    """The forest's links are all refused, so what is linked must come from the second step, in tiles of a few sets."""
    real = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda *x: real(*x).limit(0))
    monkeypatch.setattr(simhash, "OPEN", 3)
    texts = planted()
    out = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(brute_components(texts)))


def test_many_copies_that_are_no_links_make_few_rows(spark):
    """Hundreds of texts of which each pair is a candidate and none is similar enough, and one link among them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = [" ".join(word() if j % 10 == 5 and j // 10 % 3 == k % 3 or rng.random() < 0.012 else w for j, w in enumerate(base)) for k in range(300)]
    texts.append(texts[17] + " end")
    out = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want)) and 3 < len(set(want)) < 301


def test_forest_spans_what_its_links_span():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, grown, made = 60, simhash.Forest(60), []
        x, y = rng.integers(0, n, (2, 80))
        for i in range(0, 80, 20):
            new = grown.add(x[i : i + 20], y[i : i + 20])
            made += zip(x[i : i + 20][new], y[i : i + 20][new])
        label = list(range(n))
        for p, q in zip(x, y):
            low, high = sorted((label[p], label[q]))
            label = [low if v == high else v for v in label]
        assert len(made) == n - len(set(label)) and len(set(zip(label, grown.label))) == len(set(label)) == len(set(grown.label.tolist()))


def test_bits_that_differ_follow_the_angle():
    rng = np.random.default_rng(1)
    far = []
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        y = np.unique(np.concatenate((x[33:], rng.integers(0, 2**63, 33, dtype=np.uint64))))
        far.append(sum(int(np.bitwise_count(np.uint64(a % 2**64) ^ np.uint64(b % 2**64))) for a, b in zip(simhash.wide_fingerprint(x), simhash.wide_fingerprint(y))))
    assert abs(np.mean(far) - 256 * np.arccos(2 * 0.802 / 1.802) / np.pi) < 1.5 and max(far) <= simhash.WIDE


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "x y z")], "doc_id long, text string")
    assert sum(r.kept for r in simhash.near_copies(df).collect()) == 2
    assert simhash.near_copies(df.limit(0)).count() == 0
