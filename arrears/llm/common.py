"""Shared helpers of the training-data operators: table access, staged tables in
the cluster's shared folder, and byte files that executors write and range-read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import checkpoint_dir

#: Rows of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *cols: str) -> DataFrame:
    """(doc_id, text, ...): null texts become empty; whatever else the table holds is
    left out, so that names of its extra columns cannot clash with ours."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *cols)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Give a worker's freed memory back to the system at the end of a partition: workers are
    reused by later stages, and what long texts leave behind would stay with them."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` gives, which this worker keeps for its later tasks until another operator's
    come: then ``forget`` drops it, as one worker serves all stages of a pipeline in turn."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    if _KEPT:
        _KEPT.clear()
        release()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost
    executors cost a re-read only."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove staged tables whose consumers have all been written."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def open_fs(uri: str):
    """(file system, path) of a folder that executors share; any store that Arrow knows."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write: Callable) -> None:
    """Create one file; ``write`` gets the open stream.  Callers use a fresh name per task
    attempt and publish it through rows of a table, so a retried task leaves no half file
    that a reader could pick up."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        write(out)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 1000) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for each key.

    A key may hold a third of all rows, so keys with over 1/``most`` of the rows - fewer
    than ``most`` of them, whatever the input - are broadcast and joined map-side; the
    others meet in an ordinary shuffle join, where none is large.  ``groups`` and ``rows``
    should be staged tables; ``size`` names the groups' row count."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * most > F.lit(total)
    big = F.broadcast(groups.where(heavy))
    hot = rows.join(big, key)
    cold = rows.join(F.broadcast(groups.where(heavy).select(key)), key, "left_anti").join(groups.where(~heavy), key)
    return hot.unionByName(cold)
