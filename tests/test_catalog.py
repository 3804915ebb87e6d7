import duckdb
import pytest

from quire import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = db.execute(catalog.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted((tidy(r) for r in df.select(order).collect()), key=repr) == sorted(map(tidy, found.fetchall()), key=repr)


def test_entry():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "block_review_load" in queries


def test_teds_of_grids_reads_whole_passages(spark):
    def tags(passage):
        return ["["] + [t for s in passage.split(". ") for t in ["<", *(f"v:{w.strip()}" for w in s.split(" ")), ">"]] + ["]"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    want = {}
    for (_, other), (item, passage) in zip(items, items[1:]):
        a, b = tags(passage), tags(other)
        want[item] = 1 - distance(a, b) / max(len(a), len(b))
    got = {r.item_id: r.teds for r in catalog.QUERIES["teds_of_grids"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
