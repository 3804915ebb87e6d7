import hashlib
import random

from quire.llm.exact_dedup import exact_dedup, maybe_repeated

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "Ä", "ä", "É x", "é X", "İ", "ǅ", "KK"] + [rng.choice(["aB", "Ab", "ab", "ÄB", "Äb"]) * rng.randint(1, 3) for _ in range(80)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, KEEP_ID string"), keep_text=True).collect()
    norm = {i: (t or "").translate(LOW) for i, t, _ in rows}
    for r in out:
        group = [i for i, t in norm.items() if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert len(out) == len(rows)


def test_full_filter_still_gives_all(spark):
    rows = [(i, f"t{i % 300}") for i in range(600)]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bits_per_row=1, max_bits=32768).collect()
    assert sum(r.kept for r in out) == 300 and all(r.group_size == 2 for r in out)


def test_filter_passes_all_that_repeats(spark):
    df = spark.createDataFrame([(h, h * 7) for h in [1, 2, 3, 3, 4, 5, 5, 5]], "a long, b long")
    out = maybe_repeated(df, ["a", "b"]).collect()
    assert all(r.maybe for r in out if r.a in (3, 5)) and not all(r.maybe for r in out)


def test_null_ids_and_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "b"), (None, "b")], "doc_id long, text string")
    out = exact_dedup(df).collect()
    assert sum(r.kept for r in out) == 2 and {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(None, None, 2), (3, 3, 3), (None, 3, 3)}


def test_empty_table(spark):
    out = exact_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and set(out.columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}


def test_extra_columns_may_have_any_name(spark):
    names = ["row", "id", "sha", "h0", "h1", "tag", "maybe", "of", "top", "n", "slot", "bucket0", "bitmap1", "_bucket0", "_sha", "_tag", "Kept"]
    df = spark.createDataFrame([(i, f"t{i % 3}", *range(len(names))) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = exact_dedup(df)
    assert out.columns == ["doc_id", *names[:-1], "keep_id", "group_size", "kept", "text_sha256"]
    assert all(r[n] == k for r in out.collect() for k, n in enumerate(names[:-1]))
