import inspect
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted(order) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(order).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_a_row_for_each_document(spark, db, name):
    ids = sorted(r[0] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r[0] for r in db.execute("SELECT doc_id FROM documents").fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept and docs.count() == len(now)
        assert docs.columns == columns + (["shard", "slot"] if name == "shard" else [])
        if name == "quality":
            gone = [labels[d] for d in kept - now if d in labels]
            assert gone and sum(gone) <= 0.1 * len(gone) and sum(labels[d] == 0 for d in now if d in labels) <= 2
        kept = now


def test_pipeline_runs_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "slot" in out.columns


def texts_of(spark, folder=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_equals_brute_force(spark):
    import xxhash

    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for d, text in texts_of(spark).items():
        words = [w for w in (text or "").encode().translate(low).replace(b"\x0b", b" ").split() if w]
        hashed = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))] if words else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {(d, format(v, "016x"), find(d)) for d, v in prints.items()}


def test_op2_columns_and_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op2_quality(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in rows} == set(texts_of(spark, "/root/testdata/sf0.01"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and sum(held) >= 0.97 * len(held)


def test_op5_columns(spark):
    texts = texts_of(spark)
    rows = queries.op5_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    """Documents of plain prose, with near and exact copies, benchmark passages, null texts, repeated rows, and sources of 1 to 200 documents."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(n))
    passages = [prose(4) for _ in range(5)]
    texts = [prose(rng.randint(8, 30)) for _ in range(200)]
    near = []
    for t in texts[:40]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    leaks = [prose(3) + " " + passages[k % 5] + " " + prose(3) for k in range(10)]
    junk = ["BUY!! NOW!! CHEAP!! " * rng.randint(5, 40) for _ in range(60)]
    said = texts + near + texts[50:60] + leaks + junk + [None, None, ""]
    rows = [(i, t, "en", "tiny" if i == 3 else None if i == 5 else f"s{i % 2}") for i, t in enumerate(said)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, lang string, source string")
    first_junk = len(said) - 63
    labels = [(i, int(i < first_junk)) for i in range(len(said) - 3)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.staged(stage(spark, now, str(tmp_path)), name)
        seen[name] = sorted(r.doc_id for r in now.select("doc_id").collect())
    good = set(seen["quality"])
    assert good >= set(range(first_junk)) and not good & {i for i, q in labels if not q} and seen["quality"].count(7) == 2

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(said[d]) for d in good}
    root = {d: d for d in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert seen["near_dedup"] == sorted({find(d) for d in good}) and len(seen["near_dedup"]) <= len(good) - 45
    dirty = {d for d in seen["near_dedup"] if any(len(shingles((said[d] or "").replace(".", "")) & shingles(p.replace(".", ""))) > 20 for p in passages)}
    assert seen["decontaminate"] == [d for d in seen["near_dedup"] if d not in dirty] and len(dirty) == 10
    assert seen["mix"] == seen["shard"] == seen["decontaminate"]
    shards = {}
    for r in now.collect():
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_stages_keep_columns_that_operators_name_alike(spark, tmp_path):
    names = ["score", "predicted", "kept", "component_id", "contaminated", "coverage", "item_id", "slot", "block", "in_mix", "row", "tag", "key", "Text_crc32"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF), name)
        rows = out.collect()
        own = names if name != "shard" else [n for n in names if n != "slot"]
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in own), name
        assert out.columns == (docs.columns if name != "shard" else [c for c in docs.columns if c != "slot"] + ["shard", "slot"])
        docs = out
