import random
import re
import zlib  # noqa: F401

import numpy as np
import xxhash

from quire.llm import components, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fingerprint). id to the smallest id reachable."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 2:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(rows))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "One", "One two", "A b c", "ÄB äb É x  y z", "x " * 5000] + [" ".join(rng.choice(["a", "B", "çé", "dd", "\U0001f600"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for text in texts:
        assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text), text


def test_fingerprint_of_long_text_goes_by_pieces(monkeypatch):
    rng = random.Random(2)
    text = "  ".join(rng.choice(["alpha", "be", "g", "deltadelta"]) for _ in range(900))
    want = simhash.fingerprint(text)
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(simhash, "word_pieces", lambda data, s=size, f=simhash.word_pieces: f(data, s))
        assert simhash.fingerprint(text) == want
        monkeypatch.undo()


def test_forest_spans_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(k)) for k in range(6))])
    pairs = simhash.forest(near, None, 2) 
    assert len(pairs) < len(near)
    rows = [(i, int(v)) for i, v in enumerate(near)]
    want = brute_components(rows)
    root = {int(v): int(v) for v in near}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert len({find(int(v)) for v in near}) == len(set(want))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.u: r.root for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[100 + k] == 100 for k in range(1, 50)) and found[201] == 200
    assert len(found) == 60 + 49 + 1


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 4) for _ in range(200)) for _ in range(30)]
    texts = base + [t.upper() for t in base[:10]] + [t + " end" for t in base] + ["", None, "  ", "one", "one"]
    rows = [(k * 3 % 101 if k else 101, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Fingerprint string")
    out = simhash.near_groups(df, keep_text=True).collect()
    want = brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])
    assert {(r.doc_id, r.component_id) for r in out} == {(d, w) for (d, _, _), w in zip(rows, want)}
    assert {r.doc_id: r.fingerprint for r in out} == {d: format(brute_fingerprint(t), "016x") for d, t, _ in rows}
    kept = [r for r in out if r.kept]
    assert sorted(r.component_id for r in kept) == sorted(set(want)) and all(r.doc_id == r.component_id for r in kept)


def test_null_ids_repeated_rows_and_finer_blocks(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "x y z w"), (5, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    out = simhash.near_groups(df, blocks=8).collect()
    assert sum(r.kept for r in out) == 2 and {(r.doc_id, r.component_id) for r in out} == {(None, None), (5, 5), (None, 5)}


def test_empty_table(spark):
    out = simhash.near_groups(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id", "kept"]


def test_links_over_the_top_bit(spark):
    """Bits 63 and another differ; and of values that differ in nearly all bits none is a link."""
    base = 0x0123456789ABCDEF
    values = [base, base ^ (1 << 63) ^ 1, ~base & (2**64 - 1), (base ^ (1 << 62) ^ (1 << 5)) & (2**64 - 1)]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert links == {(min(signed[0], v), max(signed[0], v)) for v in (signed[1], signed[3])}
    import numpy as np

    assert not simhash.forest(np.array([0, 5], dtype=np.int64), np.array([-1, -6], dtype=np.int64), 2)


def test_extra_columns_may_have_any_name(spark):
    names = ["fp", "tag", "first", "top", "of", "head", "row", "u", "root", "Kept", "id"]
    df = spark.createDataFrame([(i, f"a b c d {i % 2}", *range(len(names))) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = simhash.near_groups(df)
    assert out.columns == ["doc_id", *(n for n in names if n != "Kept"), "fingerprint", "component_id", "kept"]
    assert all(r[n] == k for r in out.collect() for k, n in enumerate(names) if n != "Kept")
