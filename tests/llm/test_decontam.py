import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import decontam


def brute_tiles(item, doc, tile=5):
    """Greedy string tiling by trying all places each time."""
    mine, theirs, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mine[i + k] and not theirs[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < tile:
            return covered
        for x in range(k):
            mine[i + x] = theirs[j + x] = True
        covered += k


def fast_tiles(item, doc, tile=5):
    a, b = decontam.word_hashes(" ".join(item)), decontam.word_hashes(" ".join(doc))
    seeds, mine = decontam.running(a, tile), decontam.running(b, tile)
    whole = decontam.tiled(a, b, tile)
    assert round(decontam.coverage(a, seeds, b, mine, 0.0, tile) * len(a)) == whole, "only words near seeds count"
    return whole


def test_tiling_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abc") for _ in range(rng.randint(5, 50))]
        assert fast_tiles(item, doc, 3) == brute_tiles(item, doc, 3), (item, doc)


ITEMS = [f"{w} alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau {w}" for w in ("first", "second")] + ["too short", "", None]


def judged(spark, texts, items=ITEMS, **more):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, Coverage string")
    bench = spark.createDataFrame([(10 + k, t) for k, t in enumerate(items)] + [(None, "a b c d e f")], "item_id long, text string")
    return {r.doc_id: r for r in decontam.decontaminate(docs, bench, **more).collect()}


def test_whole_reordered_and_partial_passages(spark):
    w = ITEMS[0].split()
    reordered = " ".join(w[14:21] + ["and"] + w[7:14] + ["then"] + w[:7])
    small = " ".join(w[3:9])
    got = judged(spark, ["x y z " + ITEMS[0].upper().replace(" ", ", ") + " end", reordered, "noise " + small + " noise", "a clean text of its own with no such words at all", "", None, "too short", " ".join(w[4:16])])
    assert [got[k].contaminated for k in range(8)] == [True, True, False, False, False, False, False, True]
    assert got[0].item_id == 10 and got[0].coverage == 1.0 and got[0].n_items == 2 and got[1].coverage == 1.0
    assert got[2].item_id is None and got[2].coverage == 0.0


def test_tables_give_the_same_as_one_block(spark):
    texts = [" ".join(random.Random(k).choices(ITEMS[k % 2].split(), k=60)) + (ITEMS[k % 2] if k % 3 == 0 else "") for k in range(30)] + ["", None, ITEMS[1], ITEMS[1]]
    items = ITEMS + [" ".join(random.Random(100 + k).choices(ITEMS[k % 2].split(), k=30)) for k in range(50)] + [ITEMS[0]]
    whole, parts = judged(spark, texts, items), judged(spark, texts, items, block=40)
    assert whole == parts and sum(r.contaminated for r in whole.values()) > 8 and whole[32].item_id == 11


def test_repeated_words_and_long_text(spark):
    items = ["la " * 60]
    got = judged(spark, ["la " * 3000, "la la la la", "word " * 200_000 + "la " * 40], items)
    assert got[0].coverage == 1.0 and not got[1].contaminated and got[2].coverage == round(40 / 60, 6)


def test_memory_of_repeated_words_is_bounded():
    import tracemalloc

    block, text = decontam.Block(["la " * 1000, "la la ti " * 400]), "la " * 400_000 + "la la ti " * 300
    tracemalloc.start()
    share, place, n = block.judge(text, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (share, place, n) == (1.0, 0, 2) and peak < 150 * 401_000


def test_ids_of_any_type_and_names_that_clash(spark):
    names = ["text", "found", "place", "item", "row", "own", "key", "n", "coverage", "at"]
    docs = spark.createDataFrame([(1, ITEMS[0], *range(1, len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[1:]))
    bench = spark.createDataFrame([("b-2", ITEMS[0]), ("a-1", ITEMS[0])], "item_id string, text string")
    for block in (10**6, 10):
        out = decontam.decontaminate(docs, bench, block=block)
        assert out.columns == ["doc_id", *(n for n in names if n != "coverage"), "n_items", "coverage", "item_id", "contaminated"]
        r = out.first()
        assert r.item_id == "a-1" and r.n_items == 2 and all(r[n] == k for k, n in enumerate(names) if n not in ("text", "coverage"))


def test_query_equals_brute_force(spark, tmp_path):
    from quire.llm import queries

    rng = random.Random(2)
    passages = [" ".join(rng.choices("abcdefghijklmnop", k=14)) for _ in range(6)]
    docs = [(i, " ".join(rng.choices("abcdefghijklmnop", k=8)) + " " + " ".join(passages[i % 6].split()[: rng.randint(0, 14)]) + " z", "en", "s") for i in range(40)] + [(40, None, "en", "s"), (41, "", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for d, text, *_ in docs:
        shares = [(brute_tiles(p.split(), (text or "").split()) / 14, -k) for k, p in enumerate(passages)]
        hit = [x for x in shares if x[0] >= 0.5]
        want.add((d, bool(hit), -max(hit)[1] if hit else None, round(max(hit)[0], 6) if hit else 0.0, len(hit)))
    assert {tuple(r) for r in queries.op4_decontaminate(spark, str(tmp_path)).collect()} == want and any(w[1] for w in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.decontaminate(docs, none).collect()] == [False]
    assert decontam.decontaminate(docs.filter(F.lit(False)), none).count() == 0


def test_pieces_keep_words_whole():
    text = " ".join(f"word{i}" for i in range(500))
    assert "".join(decontam.text_pieces(text, 17)) == text and all(p.endswith(" ") for p in list(decontam.text_pieces(text, 17))[:-1])
