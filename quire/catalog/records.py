"""Queries on events, labels, vectors and orders: jobs, review, retrieval, links, logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.catalog.base import LINES, line_nodes, number, table
from quire.catalog.text import MEASURES
from quire.functions.text import least_confidence
from quire.operators import artifacts, evaluation, review, rules
from quire.storage import staged
from quire.streaming import jobs


def job_latest_status(spark, sf_dir):
    """A user's events as those of a job."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("job_id"), "ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event"), F.col("event_type").alias("status"), F.col("value").alias("progress"), F.get_json_object("props", "$.k").alias("stage"))
    return jobs.job_progress(rows)


def idle_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = e.schema["ts"].dataType
    return jobs.busy_sessions(e, "user_id").select("user_id", F.col("start").cast(kind).alias("starts"), F.col("end").cast(kind).alias("ends"), "n")


def queue_depth(spark, sf_dir):
    change = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1)
    rows = jobs.queue_depth(table(spark, sf_dir, "events"), "user_id", change)
    return rows.groupBy("user_id").agg(F.max("in_flight").alias("most"), F.count_if("refused").alias("refused"))


def job_counts(spark, sf_dir):
    return evaluation.jobs_by_status(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")).withColumnRenamed("count", "n")


def runner_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("runner_id"), "ts", F.col("event_type").isin("view", "purchase").alias("ok"))
    return jobs.runner_states(e).groupBy("runner_id", "state").agg(F.count("*").alias("n"), F.max("errors").alias("most"))


def runner_up_seconds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("runner_id"), F.date_trunc("second", "ts").alias("ts"), F.when(F.col("event_type") == "view", "up").otherwise("cold").alias("state"))
    return evaluation.up_seconds(e.groupBy("runner_id", "ts").agg(F.max("state").alias("state")))


LIFE = ("start", "alive", "ready", "infer_ok", "error", "error", "error", "shutdown", "down")


def runner_life(spark, sf_dir):
    """A user's events as those of a runner's life, by their numbers; a cool-down of six hours."""
    event = F.element_at(F.array(*(F.lit(e) for e in LIFE)), (F.col("event_id") % 9 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("runner_id"), "ts", F.col("event_id").alias("seq"), event.alias("event"))
    return jobs.runner_life(e, 21_600).groupBy("runner_id", "state").agg(F.count("*").alias("n"), F.max("errors").alias("most"), F.count_if("refused").alias("refused"))


def manager_telemetry(spark, sf_dir):
    change = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1)
    e = jobs.queue_depth(table(spark, sf_dir, "events"), "user_id", change)
    requests = e.select("user_id", F.col("event_type").alias("task"), F.col("value").alias("seconds"), (F.col("event_id") % 5 != 0).alias("ok"), F.col("in_flight").alias("depth"))
    return evaluation.telemetry(requests, "user_id").select("user_id", "total", "errors", F.round("mean_seconds", 9).alias("mean_seconds"), "tasks", F.col("high_water").cast("long").alias("high_water"))


def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return jobs.windowed_counts(e, size="1 hour").select(F.col("start").cast(e.schema["ts"].dataType).alias("starts"), "event_type", "n", F.round("value", 4).alias("value"))


def limited_announcements(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("runner_id"), F.col("event_type").alias("url"), "ts", "event_id")
    return jobs.too_soon(e, 3600).groupBy("runner_id").agg(F.count_if("limited").alias("limited"))


def audit_chain_check(spark, sf_dir):
    """A log a user, of which lines are changed afterwards; the links after them are broken."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("line"), "event_id")
    order = Window.partitionBy("log_id").orderBy("event_id")
    log = e.withColumn("seq", F.row_number().over(order)).withColumn("prev_hash", F.coalesce(F.sha2(F.lag("line").over(order), 256), F.lit(artifacts.GENESIS)))
    changed = log.withColumn("line", F.when(F.col("event_id") % 97 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return artifacts.broken_links(changed).select("log_id", F.col("seq").cast("long").alias("seq"))


def audit_log_built(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"), F.lit("bot").alias("actor"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("target"), F.col("props").alias("payload"))
    log = artifacts.audit_rows(e)
    return log.select("log_id", F.col("seq").cast("long").alias("seq"), "prev_hash", F.sha2("line", 256).alias("hash"))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.filter("vec_id % 20 = 0")


def retrieval_quality(spark, sf_dir):
    """Items of a query's label are relevant: ranked pairs are compared by label, and what is wanted is counted by label."""
    v, queries = _vectors(spark, sf_dir)
    ranked = staged(evaluation.nearest_neighbours(v, queries, 10), "ranked")  # read twice
    label = lambda name: v.select(F.col("vec_id").alias(f"{name}_id"), F.col("label").alias(name))
    relevant = ranked.join(label("item"), "item_id").join(label("query"), "query_id").filter("item = query").select("query_id", "item_id")
    wanted = queries.join(v.groupBy("label").agg((F.count("*") - 1).alias("want")), "label").select(F.col("vec_id").alias("query_id"), "want")
    m = evaluation.retrieval_by_counts(ranked, relevant, wanted, 10)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


def nearest_vectors(spark, sf_dir):
    return evaluation.nearest_neighbours(*_vectors(spark, sf_dir), 10).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


def link_quality(spark, sf_dir):
    """Links of orders to parts: those of the first three lines against those of large quantity, by 50 samples."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("sample_id"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("has").alias("relation"), "l_linenumber", "l_quantity")
    out = evaluation.link_f1(rows.filter("l_linenumber <= 3"), rows.filter("l_quantity > 20"), "sample_id")
    return out.select("sample_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def sample_verdicts(spark, sf_dir):
    """A passage against itself, or without its last word."""
    items = table(spark, sf_dir, "benchmark")
    hyp = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"\s+\S+$", ""))
    rows = items.select(F.col("item_id").alias("sample_id"), F.col("text").alias("reference"), hyp.alias("hypothesis"), F.lit(None).cast("array<array<string>>").alias("expected_grid"), F.lit(None).cast("array<array<string>>").alias("found_grid"))
    return evaluation.evaluate_samples(rows).select("sample_id", F.round("wer", 6).alias("wer"), "teds", "f1", "passed")


def _flagged_nodes(spark, sf_dir):
    conf = least_confidence(F.col("line"))
    return line_nodes(spark, sf_dir, conf=conf)


def hitl_queue(spark, sf_dir):
    return review.flag(_flagged_nodes(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("doc_id"), number().alias("n"), F.round("conf", 6).alias("conf"), "status")


def corrected_blocks(spark, sf_dir):
    """Lines of documents of label 0 are corrected, in every third a new text; what is below the threshold after that."""
    nodes = _flagged_nodes(spark, sf_dir)
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    c = nodes.filter("kind = 'paragraph'").join(bad, "doc_id", "left_semi").select("doc_id", "node_id", F.col("node_id").alias("task_id"), F.when(number() % 3 == 0, F.create_map(F.lit("text"), F.lit("fixed"))).otherwise(F.create_map(F.lit("note"), F.lit("seen"))).alias("payload"), F.lit("ann").alias("reviewer"), F.lit("approved").alias("decision"), F.lit(1).alias("at"))
    fixed, history, _ = review.apply_corrections(nodes, c)
    left = review.flag(fixed).groupBy("doc_id").agg(F.count("*").alias("left"))
    done = history.groupBy("doc_id").agg(F.count("*").alias("corrected"), F.count_if(F.col("after") == "fixed").alias("rewritten"))
    return left.join(done, "doc_id", "full").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("corrected", F.lit(0)).alias("corrected"), F.coalesce("rewritten", F.lit(0)).alias("rewritten"))


def _terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term"), F.col("p_brand").alias("translation"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"), F.col("p_partkey").alias("seq"))


def glossary(spark, sf_dir):
    return rules.upsert_terms(_terms(spark, sf_dir))


def glossary_search(spark, sf_dir):
    return rules.search_terms(rules.upsert_terms(_terms(spark, sf_dir)), "ring").select("term", "translation")


def glossary_on_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit(1).alias("chapter"), F.col("doc_id").alias("page"), F.col("text").alias("final"), F.lit(None).cast("string").alias("original"))
    terms = spark.range(1).select(F.explode(F.array(*(F.lit(w) for w in ("Copyright", "ERER", "tion the", "cheit")))).alias("term"))
    return rules.terms_on_pages(docs, terms).select("page", "term")


def document_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lower("lang").alias("job_id"), F.when(F.col("doc_id") % 2 == 0, "DONE").otherwise("QUEUED").alias("status"))
    return rules.search_documents(docs, "SRC1", "DONE").select("doc_id")


def stage_board(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("chapter"), F.element_at(F.array(*(F.lit(s) for s in rules.STAGES)), (F.col("event_id") % 9 + 1).cast("int")).alias("stage"), F.when(F.col("event_type") == "error", "reset").otherwise(F.col("event_type")).alias("status"), F.col("event_id").alias("seq"))
    return rules.stage_state(e.select(F.col("user_id").alias("chapter")).distinct(), runs)


def figures_upserted(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 < 2").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_custkey % 3 > 0").select("c_custkey", F.lit(None).cast("string").alias("name"), F.lower("c_mktsegment").alias("segment"))
    return rules.upsert_given(old, new, "c_custkey")


def first_agents(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("role"), F.concat(F.lit("host"), F.col("o_custkey").cast("string")).alias("host"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 7 == 3).alias("reachable"))
    return rules.first_reachable(s)


def page_hosts(spark, sf_dir):
    url = F.concat(F.regexp_extract("url", r"^https?://[^/:?#]+", 0), F.lit(":8443/x"))
    return table(spark, sf_dir, "pages").select("page_id", rules.runner_origin(url).alias("origin"))


_ALL = (job_latest_status, idle_sessions, queue_depth, job_counts, runner_states, runner_up_seconds, runner_life, manager_telemetry, event_windows, limited_announcements, audit_chain_check, audit_log_built, retrieval_quality, nearest_vectors, link_quality, sample_verdicts, hitl_queue, corrected_blocks, glossary, glossary_search, glossary_on_pages, document_search, stage_board, figures_upserted, first_agents, page_hosts)
QUERIES = {f.__name__: f for f in _ALL}

RANKED = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, q.label AS ql, i.vec_id AS item_id, i.label AS il, round(list_dot_product(i.v, q.v) / (sqrt(list_dot_product(i.v, i.v)) * sqrt(list_dot_product(q.v, q.v))), 9) AS score FROM e q JOIN e i ON i.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"""
CONF = f"{LINES}, {MEASURES}, f AS (SELECT doc_id, n, least(ext, cls) AS conf FROM confident)"
TERMS = "t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS term, p_brand AS translation, CASE WHEN p_size > 25 THEN p_type END AS category, p_partkey AS seq FROM part), g AS (SELECT arg_max({'term': term, 'translation': translation, 'category': coalesce(category, 'general'), 'seq': seq}, seq) AS x FROM t GROUP BY lower(term))"

ORACLE_SQL = {
    "job_latest_status": "WITH m AS (SELECT user_id AS job_id, arg_max({'ts': ts, 's': event_type, 'p': value, 'k': props->>'$.k'}, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS l FROM events GROUP BY user_id) SELECT job_id, l.ts AS ts, l.s AS status, l.p AS progress, l.k AS stage FROM m",
    "idle_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 900 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 900 SECOND AS ends, count(*) AS n FROM s GROUP BY user_id, k""",
    "queue_depth": "WITH f AS (SELECT user_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) SELECT user_id, CAST(max(f) AS BIGINT) AS most, count(*) FILTER (f > 8) AS refused FROM f GROUP BY user_id",
    "job_counts": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1",
    "runner_states": """WITH r AS (SELECT user_id, ts, event_type IN ('view', 'purchase') AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, ok) AS run FROM r), e AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, ok) AS errors FROM g)
        SELECT user_id AS runner_id, CASE WHEN errors >= 3 THEN 'stopping' WHEN errors > 0 THEN 'error' ELSE 'up' END AS state, count(*) AS n, CAST(max(errors) AS BIGINT) AS most FROM e GROUP BY ALL""",
    "runner_up_seconds": """WITH s AS (SELECT user_id, date_trunc('second', ts) AS ts, max(CASE WHEN event_type = 'view' THEN 'up' ELSE 'cold' END) AS state FROM events GROUP BY ALL), l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM s)
        SELECT user_id AS runner_id, CAST(sum(epoch(nx)::BIGINT - epoch(ts)::BIGINT) AS BIGINT) AS seconds FROM l WHERE state = 'up' AND nx IS NOT NULL GROUP BY 1""",
    "runner_life": f"""WITH e AS (SELECT user_id AS runner_id, ts, event_id AS seq, {list(LIFE)}[event_id % 9 + 1] AS event FROM events),
            r AS (SELECT *, count(*) FILTER (event NOT IN ('error', 'start')) OVER (PARTITION BY runner_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM e),
            c AS (SELECT *, count(*) FILTER (event = 'error') OVER (PARTITION BY runner_id, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS errors FROM r),
            t AS (SELECT *, max(CASE WHEN event = 'error' AND errors = 3 THEN floor(epoch(ts)) END) OVER (PARTITION BY runner_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS third FROM c),
            f AS (SELECT *, event = 'start' AND coalesce(floor(epoch(ts)) - third < 21600, false) AS refused FROM t),
            b AS (SELECT *, CASE WHEN event = 'error' THEN CASE WHEN errors >= 3 THEN 'stopping' ELSE 'error' END WHEN NOT refused THEN CASE event WHEN 'start' THEN 'starting' WHEN 'alive' THEN 'warming' WHEN 'ready' THEN 'up' WHEN 'infer_ok' THEN 'up' WHEN 'shutdown' THEN 'stopping' ELSE 'cold' END END AS brings FROM f),
            s AS (SELECT *, coalesce(last_value(brings IGNORE NULLS) OVER (PARTITION BY runner_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 'cold') AS state FROM b)
        SELECT runner_id, state, count(*) AS n, max(errors) AS most, count(*) FILTER (refused) AS refused FROM s GROUP BY ALL""",
    "manager_telemetry": """WITH q AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM events),
            t AS (SELECT user_id, event_type, count(*) AS n FROM q GROUP BY ALL), j AS (SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS tasks FROM t GROUP BY user_id)
        SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 5 = 0) AS errors, round(avg(value), 9) AS mean_seconds, any_value(tasks) AS tasks, greatest(0, max(depth))::BIGINT AS high_water FROM q JOIN j USING (user_id) GROUP BY user_id""",
    "event_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS starts, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "limited_announcements": "WITH l AS (SELECT user_id, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) < 3600 AND lag(event_type) OVER w <> event_type AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id AS runner_id, count(*) FILTER (limited) AS limited FROM l GROUP BY 1",
    "audit_chain_check": "WITH s AS (SELECT user_id, event_id, row_number() OVER w AS seq, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id AS log_id, seq FROM s WHERE before % 97 = 0",
    "audit_log_built": """WITH RECURSIVE e AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
                '{"at":"' || lpad(event_id::VARCHAR, 12, '0') || '","actor":"bot","action":"' || event_type || '","target":"' || user_id || '","payload_hash":"' || sha256(props) || '","prev_hash":"' AS head FROM events),
            c AS (SELECT log_id, seq, repeat('0', 64) AS prev_hash, sha256(head || repeat('0', 64) || '"}') AS hash FROM e WHERE seq = 1
                UNION ALL SELECT e.log_id, e.seq, c.hash, sha256(e.head || c.hash || '"}') FROM c JOIN e ON e.log_id = c.log_id AND e.seq = c.seq + 1)
        SELECT log_id, seq, prev_hash, hash FROM c""",
    "retrieval_quality": f"""WITH {RANKED}, top AS (SELECT * FROM r WHERE rank <= 10), w AS (SELECT query_id, count(*) FILTER (il = ql) AS want FROM s GROUP BY 1),
            g AS (SELECT query_id, count(*) FILTER (il = ql) AS hits, coalesce(max(1.0::DOUBLE / rank) FILTER (il = ql), 0) AS mrr, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (il = ql), 0) AS dcg FROM top GROUP BY 1)
        SELECT query_id, round(CASE WHEN want = 0 THEN 0 ELSE hits / want::DOUBLE END, 6) AS recall, round(mrr, 6) AS mrr, round(CASE WHEN want = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(want, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END, 6) AS ndcg FROM g JOIN w USING (query_id)""",
    "nearest_vectors": f"WITH {RANKED} SELECT query_id, item_id, rank FROM r WHERE rank <= 10",
    "link_quality": """WITH e AS (SELECT DISTINCT l_orderkey % 50 AS sample_id, l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3), f AS (SELECT DISTINCT l_orderkey % 50 AS sample_id, l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20),
            j AS (SELECT coalesce(e.sample_id, f.sample_id) AS sample_id, count(e.l_orderkey) AS want, count(f.l_orderkey) AS got, count(*) FILTER (e.l_orderkey IS NOT NULL AND f.l_orderkey IS NOT NULL) AS hit FROM e FULL JOIN f USING (sample_id, l_orderkey, l_partkey) GROUP BY 1),
            m AS (SELECT sample_id, CASE WHEN got > 0 THEN hit / got::DOUBLE ELSE 0 END AS p, CASE WHEN want > 0 THEN hit / want::DOUBLE ELSE 1 END AS r FROM j)
        SELECT sample_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""",
    "sample_verdicts": r"""WITH w AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 0::DOUBLE ELSE round(1 / len(regexp_split_to_array(trim(text), '\s+'))::DOUBLE, 6) END AS wer FROM benchmark) SELECT item_id AS sample_id, wer, 1::DOUBLE AS teds, 1::DOUBLE AS f1, wer <= 0.05 AS passed FROM w""",
    "hitl_queue": f"WITH {CONF} SELECT doc_id, n::INT AS n, round(conf, 6) AS conf, 'pending' AS status FROM f WHERE conf < 0.8::DOUBLE",
    "corrected_blocks": f"""WITH {CONF}, b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), m AS (SELECT doc_id, count(*) FILTER (conf < 0.8::DOUBLE AND b.doc_id IS NULL) AS "left", count(b.doc_id) AS corrected, count(b.doc_id) FILTER (n % 3 = 0) AS rewritten FROM f LEFT JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT * FROM m WHERE "left" > 0 OR corrected > 0""",
    "glossary": f"WITH {TERMS} SELECT x.term AS term, x.translation AS translation, x.category AS category, x.seq AS seq FROM g",
    "glossary_search": f"WITH {TERMS} SELECT x.term AS term, x.translation AS translation FROM g WHERE contains(lower(x.term), 'ring') OR contains(lower(x.translation), 'ring')",
    "glossary_on_pages": "SELECT doc_id AS page, term FROM documents, (SELECT unnest(['Copyright', 'ERER', 'tion the', 'cheit']) AS term) WHERE contains(lower(text), lower(term))",
    "document_search": "SELECT doc_id FROM documents WHERE contains(source, 'src1') AND doc_id % 2 = 0",
    "stage_board": """WITH s AS (SELECT user_id AS chapter, event_id % 9 + 1 AS k, arg_max(CASE WHEN event_type = 'error' THEN 'reset' ELSE event_type END, event_id) AS st FROM events GROUP BY ALL), n AS (SELECT unnest(['extract', 'ocr', 'analyze', 'translate', 'glossary', 'validate', 'figures', 'latex', 'compile']) AS stage, unnest(range(1, 10)) AS k)
        SELECT c.chapter, n.stage, CASE WHEN coalesce(st, 'reset') = 'reset' THEN 'pending' ELSE st END AS status FROM (SELECT DISTINCT user_id AS chapter FROM events) c CROSS JOIN n LEFT JOIN s ON s.chapter = c.chapter AND s.k = n.k""",
    "figures_upserted": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer",
    "first_agents": "SELECT o_orderpriority AS role, arg_min('host' || o_custkey, o_orderkey) AS host FROM orders WHERE o_orderkey % 7 = 3 GROUP BY 1",
    "page_hosts": "SELECT page_id, regexp_extract(url, '^https?://[^/:?#]+', 0) || ':8443' AS origin FROM pages",
}
