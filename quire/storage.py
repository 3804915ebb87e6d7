"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if Spark runs in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


_made: list[list[DataFrame]] = []  # what staged() gave, for each staged_alone() that is under way


#: Held while staged_alone() works: shuffle files go with the write that made them, not when the driver happens to collect its garbage, and files are packed closer.
COMPACT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage, and lost executors don't lose it."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, label))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if _made:
        _made[-1].append(out)
    return out


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings are these meanwhile."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table of make(), staged; tables that are staged on the way go as soon as it is written, or if it fails, and so do the files of its shuffles."""
    out = None
    _made.append([])
    try:
        with held(spark, COMPACT):
            out = staged(make(), label)
    finally:
        discard(*(df for df in _made.pop() if df is not out))
    if _made:
        _made[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that staged() returned and that nothing reads any more."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def n_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at a path that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def text_folder(spark: SparkSession, pieces: Iterable[str], label: str) -> str:
    """A folder in the shared one with a file for each text, written by the driver. The texts are lines that Spark's readers take."""
    folder = new_path(spark, label)
    for k, text in enumerate(pieces):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{k:05d}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(text.encode()))
        out.close()
    return folder
