"""One stream of events to several listeners: tables by batch, each batch written once however often it's run.

A sink is a folder with one folder a batch, and a batch counts once its folder has the mark that Spark's writer leaves last. A batch that is run again, after a kill between two sinks, say, leaves finished sinks alone and
writes the others anew, from the same events. Listeners keep the number of the last batch they have seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.storage import new_path
from quire.streaming.jobs import TERMINAL

JOB_BUCKETS = 16  # folders by job in a batch, so that the listener of one job reads one of them
DONE = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def job_bucket(job: Column) -> Column:
    return F.pmod(F.hash(job.cast("string")), F.lit(JOB_BUCKETS))


def listeners(ended: tuple[str, ...] = TERMINAL) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The sinks of job events (job_id, ts, status, ...): all of them, the same by job, and those that end a job."""
    return {"all": lambda e: e, "by_job": lambda e: e.withColumn("bucket", job_bucket(F.col("job_id"))).repartition("bucket").sortWithinPartitions("job_id", "ts"), "ended": lambda e: e.filter(F.col("status").isin(*ended))}


def write_batch(batch: DataFrame, number: int, folder: str, sinks: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Writes a batch to each sink that doesn't have it whole; a column `bucket` of a sink's rows makes folders. Extra columns are kept."""
    spark = batch.sparkSession
    batch = batch.persist()  # read once for all sinks
    try:
        for name, rows_of in sinks.items():
            path = f"{folder}/{name}/batch={number:09d}"
            mark, fs = _fs(spark, f"{path}/{DONE}")
            if fs.exists(mark):
                continue
            rows = rows_of(batch)
            (rows.write.partitionBy("bucket") if "bucket" in rows.columns else rows.write).mode("overwrite").parquet(path)
    finally:
        batch.unpersist()


def fan_out(events: DataFrame, folder: str, checkpoint: str, sinks: dict[str, Callable[[DataFrame], DataFrame]] | None = None, keep_on: bool = False):
    """Deals a stream out to sinks in the folder; ends when the source is read, or goes on with keep_on. Returns the streaming query."""
    sinks = sinks or listeners()
    writer = events.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder, sinks)).option("checkpointLocation", checkpoint)
    query = (writer if keep_on else writer.trigger(availableNow=True)).start()
    if not keep_on:
        query.awaitTermination()
    return query


def batches(spark: SparkSession, folder: str, sink: str, after: int = -1) -> list[int]:
    """The whole batches of a sink beyond one, in order; a batch that waits for its mark holds those after it back."""
    root, fs = _fs(spark, f"{folder}/{sink}")
    if not fs.exists(root):
        return []
    found = {int(f.getPath().getName()[6:]): fs.exists(_fs(spark, f"{f.getPath()}/{DONE}")[0]) for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")}
    whole = []
    for number in sorted(found):
        if not found[number]:
            break
        whole.append(number)
    return [n for n in whole if n > after]


def listen(spark: SparkSession, folder: str, sink: str = "all", job_id=None, after: int = -1) -> tuple[DataFrame | None, int]:
    """What a listener of a sink has not seen, of one job if given (sink by_job), and the number to ask with next. None: nothing yet."""
    fresh = batches(spark, folder, sink, after)
    if not fresh:
        return None, after
    rows = spark.read.option("basePath", f"{folder}/{sink}").parquet(*(f"{folder}/{sink}/batch={n:09d}" for n in fresh))
    if job_id is not None:
        bucket = spark.range(1).select(job_bucket(F.lit(job_id))).first()[0]
        rows = rows.filter((F.col("bucket") == bucket) & (F.col("job_id") == job_id)) if "bucket" in rows.columns else rows.filter(F.col("job_id") == job_id)
    return rows, fresh[-1]


def drop_batches(spark: SparkSession, folder: str, sink: str, before: int) -> int:
    """Deletes a sink's batches below a number that all its listeners have seen; how many they were."""
    old = [n for n in batches(spark, folder, sink) if n < before]
    for n in old:
        path, fs = _fs(spark, f"{folder}/{sink}/batch={n:09d}")
        fs.delete(path, True)
    return len(old)


def dealt_by_now(events: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> str:
    """A folder of sinks, in the shared one, with all that a stream's source has by now."""
    spark = events.sparkSession
    fan_out(events, folder := new_path(spark, "sinks"), new_path(spark, "sinks-state"), sinks)
    return folder
