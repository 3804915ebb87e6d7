"""Queries that search: vectors by an index of cells, terms by an automaton, substrings by posting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.base import table
from quire.catalog.records import RANKED, _vectors
from quire.operators import text_search, vector_index
from quire.storage import new_path


def _nearest(spark, sf_dir, probes=None):
    vectors, queries = _vectors(spark, sf_dir)
    found = vector_index.centres(vectors)
    index = vector_index.build(vectors, found)
    probes = probes or vector_index.probes_for(index, found, queries, 10)
    return vector_index.search(index, found, queries, 10, probes).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


def indexed_neighbours(spark, sf_dir):
    """As many cells are probed as a recall of 0.95 takes on at most 200 queries."""
    return _nearest(spark, sf_dir)


def indexed_neighbours_of_all_cells(spark, sf_dir):
    return _nearest(spark, sf_dir, 1 << 30)


def _terms(spark, sf_dir):
    """The distinct words of six characters or more in `benchmark`."""
    words = F.filter(F.split("text", " "), lambda w: F.char_length(w) >= 6)
    return table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).distinct()


def terms_in_documents(spark, sf_dir):
    found = text_search.find_terms(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), F.col("text"), ["doc_id"])
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("ids"))


def substrings_in_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = text_search.holding(docs, _terms(spark, sf_dir), [], "doc_id", "text", "term", "term")
    return found.groupBy("term").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def part_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    text_search.write_index(parts, folder := new_path(spark, "search-index"), "p_partkey", "p_name")
    return text_search.search_index(spark, folder, "RING", "p_partkey")


QUERIES = {f.__name__: f for f in (indexed_neighbours, indexed_neighbours_of_all_cells, terms_in_documents, substrings_in_documents, part_search)}

_WORDS = "w AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE length(term) >= 6)"
ORACLE_SQL = {
    "indexed_neighbours_of_all_cells": f"WITH {RANKED} SELECT query_id, item_id, rank FROM r WHERE rank <= 10",
    "terms_in_documents": f"WITH {_WORDS} SELECT term, count(*) AS n, min(doc_id) AS first, CAST(sum(doc_id) AS BIGINT) AS ids FROM w JOIN documents ON contains(lower(text), lower(term)) GROUP BY term",
    "substrings_in_documents": f"WITH {_WORDS} SELECT term, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM w JOIN documents ON contains(text, term) GROUP BY term",
    "part_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')",
}
