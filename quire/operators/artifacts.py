"""Content-addressed artifacts, snapshots, locks, caches and audit records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def put_artifacts(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """artifact_id, content, type, producer, seq, size: one a content hash; the first manifest stays for content that comes again.

    new: content, type, producer, seq; stored: what an earlier call returned.
    """
    rows = new.select(F.sha2("content", 256).alias("artifact_id"), "content", "type", "producer", "seq")
    if stored is not None:
        rows = rows.unionByName(stored.select(*rows.columns))
    return rows.groupBy("artifact_id").agg(F.min_by(F.struct("content", "type", "producer", "seq"), "seq").alias("a")).select("artifact_id", "a.*").withColumn("size", F.octet_length("content").cast("long"))


def corrupted(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose content isn't what their id says."""
    return artifacts.filter(F.sha2("content", 256) != F.col("artifact_id"))


def missing_refs(snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """snapshot_id, artifact_id of references to nothing. snapshots: snapshot_id, refs (array)."""
    return snapshots.select("snapshot_id", F.explode("refs").alias("artifact_id")).join(artifacts.select("artifact_id"), "artifact_id", "left_anti").select("snapshot_id", "artifact_id")


def garbage(artifacts: DataFrame, snapshots: DataFrame, pins: DataFrame) -> DataFrame:
    """artifact_id of what is neither pinned nor in a snapshot."""
    kept = snapshots.select(F.explode("refs").alias("artifact_id")).union(pins.select("artifact_id")).distinct()
    return artifacts.select("artifact_id").join(kept, "artifact_id", "left_anti")


def cache_key(analyzer: Column, version: Column, inputs: Column, config: Column) -> Column:
    """SHA-256 of a JSON text with the sorted inputs; config: a JSON text that the caller has sorted."""
    return F.sha2(F.to_json(F.struct(analyzer.alias("analyzer"), config.alias("config"), F.array_sort(inputs).alias("inputs"), version.alias("version"))), 256)


def cache_hits(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Entries for the keys that have not expired. cache: key, value, stored_at, ttl (seconds, null: for ever)."""
    fresh = F.col("ttl").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= F.col("ttl"))
    return keys.join(cache.filter(fresh), "key")


def lock(parts: DataFrame, key: str = "build_id") -> DataFrame:
    """build_id, hashes: the sorted map of part to SHA-256. parts: build_id, part, content."""
    return parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", F.sha2("content", 256))))).alias("hashes"))


def same_build(a: DataFrame, b: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """key, reproducible: equal in every field, nulls too."""
    right = b.select(F.col("key").alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return a.join(right, F.col("key") == F.col("_k"), "left").select("key", (F.col("_k").isNotNull() & ok).alias("reproducible"))


def audit_rows(events: DataFrame) -> DataFrame:
    """log_id, seq, line, prev_hash: each line of a log with the hash of the line before, which is part of it.

    A line's hash hangs on all lines before it, so a log is one task's; its rows come sorted, and only the last hash is carried on, so a log of any length fits. events: log_id, at, actor, action, target, payload. Null fields are left out of a line; null logs are one.
    """
    fields = F.struct("at", "actor", "action", "target", F.sha2("payload", 256).alias("payload_hash"))
    order = [F.col("log_id"), F.col("e.at"), F.col("e.actor"), F.col("e.action"), F.col("e.target"), F.col("e.payload_hash")]
    rows = events.select("log_id", fields.alias("e")).repartition("log_id").sortWithinPartitions(*order).select("log_id", F.to_json("e").alias("head"))

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, prev, seq = None, GENESIS, 0
        for batch in batches:
            if not len(batch):
                continue
            ids, out = batch["log_id"], []
            keys = ids.astype(object).where(ids.notna(), None)
            for key, head in zip(keys, batch["head"]):
                if key != log or not seq:
                    log, prev, seq = key, GENESIS, 0
                line = f"{head[:-1]}{',' if len(head) > 2 else ''}\"prev_hash\":\"{prev}\"}}"
                seq += 1
                out.append((seq, line, prev))
                prev = hashlib.sha256(line.encode()).hexdigest()
            yield pd.DataFrame({"log_id": ids, **dict(zip(("seq", "line", "prev_hash"), zip(*out)))})

    return rows.mapInPandas(chained, f"log_id {events.schema['log_id'].dataType.simpleString()}, seq int, line string, prev_hash string")


def broken_links(log: DataFrame) -> DataFrame:
    """log_id, seq of lines whose prev_hash isn't the hash of the line before; all lines are tested at once."""
    order = Window.partitionBy("log_id").orderBy("seq")
    want = F.coalesce(F.sha2(F.lag("line").over(order), 256), F.lit(GENESIS))
    return log.withColumn("_want", want).filter(~F.col("prev_hash").eqNullSafe(F.col("_want"))).select("log_id", "seq")


def audit_for(log: DataFrame, target: str) -> DataFrame:
    return log.filter(F.col("target") == target)


def fits(available: dict[str, float]) -> Column:
    """All limits that a job asks for are within what is available; its columns are cpu, memory_mb, disk_mb, gpu."""
    out = F.lit(True)
    for name, most in available.items():
        out = out & (F.coalesce(F.col(name), F.lit(0)) <= most)
    return out


def granted(asked: Column, offered: Column) -> Column:
    """Capabilities that are asked for and offered."""
    return F.array_sort(F.array_intersect(asked, offered))


def digest_mark(subject: Column, key: Column) -> Column:
    """SHA-256 of 'id:key'. It tells changes, but is no signature: who has the key can make it."""
    return F.sha2(F.concat_ws(":", subject, key), 256)
