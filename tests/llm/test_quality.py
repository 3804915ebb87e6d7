import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality

GOOD = ["The river ran past the old mill, and nobody had counted its stones in years.", "Rain fell again on the roofs of the town; a few lamps burned on.", "She wrote three letters that week and sent none of them to the coast."]
BAD = ["BUY!! NOW!! CHEAP!! STUFF!! HERE!! TODAY!! GO!!", "aa | bb | cc | dd | ee | ff | gg | hh", "word word word word word word word word word"]


def corpus(spark, n=600):
    rows = [(i, " ".join((GOOD if i % 3 else BAD)[(i * 7 + k) % 3] for k in range(1 + i % 4)), "clash") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(n)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = quality.scored(docs, quality.fit(docs, labels)).withColumn("held", quality.in_held_out("doc_id")).collect()
    held = [r for r in out if r.held]
    assert len(out) == 600 and len(held) > 60 and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.predicted == int(bool(r.doc_id % 3)) for r in held]) > 0.98


def test_held_out_is_crc32_mod_5(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", quality.in_held_out("doc_id")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus(spark)
    flipped = labels.withColumn("quality", F.when(quality.in_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert a.rules == b.rules and a.intercept == b.intercept


def test_column_equals_rules_in_numpy(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    for r in quality.scored(docs, model).limit(50).collect():
        x = dict(zip(quality.STATS, quality.statistics(r.text)))
        total = model.intercept + sum(w for rule, w in model.rules if all((x[s] > b) == up for s, up, b in rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12


def test_lasso_gives_sparse_weights_at_the_optimum():
    rng = np.random.default_rng(1)
    z = rng.random((400, 30)) < 0.4
    y = (rng.random(400) < 1 / (1 + np.exp(-(3 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    w, b = quality.lasso_logistic(z.astype(float), y, 0.02, 3000)
    assert (w == 0).sum() > 15 and w[0] > 0.5 and w[1] < -0.2
    grad = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / 400
    assert np.all(np.abs(grad[w == 0]) <= 0.02 + 1e-4) and np.allclose(grad[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)


def test_statistics_of_long_text_do_not_hang_on_its_length():
    a, b = quality.statistics(" ".join(GOOD) * 1), quality.statistics(" ".join([" ".join(GOOD)] * 40_000))
    names = dict(zip(quality.STATS, zip(a, b)))
    assert all(abs(x - y) < 0.3 * max(x, 0.1) for s, (x, y) in names.items() if s not in ("log_words", "distinct"))


def test_nulls_empties_contradictions_and_repeats(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " \n"), (3, "\x00 ok")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    out = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 5 and all(r.score == 0.5 for r in out), "no label counts, so the score is the smoothed share"


def test_one_class_and_empty_tables(spark):
    docs, labels = corpus(spark, 100)
    ones = quality.fit(docs, labels.withColumn("quality", F.lit(1)))
    assert not ones.rules and 0.9 < 1 / (1 + np.exp(-ones.intercept)) < 1
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_sample_counts_distinct_usable_labels(spark):
    labels = spark.range(2000).crossJoin(spark.range(100).select(F.col("id").alias("again"))).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    n = quality.usable(labels).count()
    assert n == spark.range(2000).filter(~quality.in_held_out("id")).count()
    assert quality.learned_from(docs, labels).count() == n
    assert quality.learned_from(docs, labels, sample=100).count() == 100
    few = [r.id for r in quality.learned_from(docs, labels, sample=300).collect()]
    assert len(few) == 300 and set(r.id for r in quality.learned_from(docs, labels, sample=100).collect()) <= set(few)


def test_repeated_documents_give_the_same_rules_in_any_layout(spark):
    docs, labels = corpus(spark)
    many = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" once more")))).unionByName(docs)
    sampled = quality.learned_from(many, labels)
    assert sampled.groupBy("id").count().agg(F.max("count")).first()[0] == 2
    a, b = quality.fit(many, labels), quality.fit(many.repartition(7), labels.repartition(3))
    assert a.rules == b.rules and a.intercept == b.intercept


def test_extra_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a text", 1, 2, 3)], "doc_id long, text string, stats int, value int, Score int")
    out = quality.scored(df, quality.RuleEnsemble([], 0.0))
    assert out.columns == ["doc_id", "text", "stats", "value", "score", "predicted"] and out.first()[2:] == (1, 2, 0.5, 1)
