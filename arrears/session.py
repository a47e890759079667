"""Spark session helpers.

The cluster names a shared folder in ``spark.checkpoint.dir``; we read it from
the session and only create our own when it is unset *and* we run in local
mode (tests, bench).  On a cluster without that setting we refuse to guess a
machine-local folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "arrears") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(os.environ.get("ARREARS_SHUFFLE_PARTITIONS", str(2 * int(cpus))))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # shuffles here are narrow (keys + a few numbers) while the work after
        # them is wide (69 features per row): keep enough partitions for the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # wide feature rows generate large whole-stage methods: let the JIT compile them
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.driver.memory", os.environ.get("ARREARS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder, creating a local one
    only for local-mode sessions where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared checkpoint folder is "
            "required on a cluster")
    path = tempfile.mkdtemp(prefix="arrears-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: lineage is cut, the data survives executor loss, and
    re-reads get column pruning and filter pushdown (an RDD checkpoint would
    serialise row by row and lose both).  Never ``localCheckpoint``.  The shuffle
    files of the write go as soon as the table is there: nothing reads them again."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    with _shuffles_dropped(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _owned(path)
    out = spark.read.parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables (``cut_lineage``) whose readers have all been written."""
    for table in tables:
        remove(table.sparkSession, table._staged_at)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """(file system, path) of a folder that executors share; any store that Arrow knows."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


#: Spark removes a query's shuffle files when it ends, not when the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes, _writing, _former = threading.Lock(), 0, None


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """``DROP_SHUFFLES`` while tables are written, by however many threads; then as it was."""
    global _writing, _former
    with _writes:
        if not _writing:
            _former = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
        _writing += 1
    try:
        yield
    finally:
        with _writes:
            _writing -= 1
            if not _writing:
                spark.conf.set(DROP_SHUFFLES, _former) if _former is not None else spark.conf.unset(DROP_SHUFFLES)


_OWNED: list[str] = []


def _owned(path: str) -> None:
    """Tables written by this process are removed when it exits (local
    folders only; a cluster folder follows the cluster's retention)."""
    local = path[len("file:"):] if path.startswith("file:") else path
    if local.startswith("/"):
        if not _OWNED:
            atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _OWNED])
        _OWNED.append(local)


#: Bytes of a row group: a million rows of a fact table, compressed.
ROW_GROUP = 16 << 20


def ensure_parallelism(scan: DataFrame) -> DataFrame:
    """Round-robin repartition of a table scan that is too small to give every core a
    split (few large row groups feeding wide work).  It asks the optimizer for the scan's size,
    runs nothing, and changes nothing once the splits suffice: Spark cuts a scan into as many
    splits as there are cores, and writers' row groups seldom pass ``ROW_GROUP`` bytes."""
    spark = scan.sparkSession
    target = spark.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = min(ROW_GROUP, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return scan if size // split >= target else scan.repartition(target)
