"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it names none, a temporary one if all runs on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sieveworks-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str, on_exit: bool) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(at) if on_exit else store.delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors repeat no earlier work.

    The files go by drop_cut(), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")  # the written files replace the shuffles that made them
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    _delete(spark, path, on_exit=True)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files of frames made by cut() that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._cut_path, on_exit=False)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most `rows` rows and about `size` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, n * size // max(1, batch.nbytes)))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def covered(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    """The places that spans (by start) cover, as separate [start, end] in order."""
    out: list[list[int]] = []
    for _, a, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
