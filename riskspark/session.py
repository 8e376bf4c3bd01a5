"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "riskspark", **conf: str) -> SparkSession:
    """A session with adaptive execution; partitions are coalesced and skewed joins split at run time."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions than there are cores (a file with one row group is one task).

    A large input has more partitions than cores and is left where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which the driver and all executors see.

    Where none is set, a temporary one is made on a local master (tests); on a cluster that is an error, as a machine's own folder is not shared.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskspark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are removed as soon as it has ended; the session's own setting is put back."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Arrow batches within ``small_batches``: with Spark's default of 10000 whole texts or 64 MB, one batch alone takes tens of MB in the JVM and some times that in each Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, what is run hands rows to Python in batches of at most so many rows and bytes; the session's own settings are put back, and kept where they are smaller."""
    before = {k: spark.conf.get(k) for k in BATCH}
    rows = int(before["spark.sql.execution.arrow.maxRecordsPerBatch"])
    for k, v in BATCH.items():
        if k.endswith("maxBytesPerBatch") or rows <= 0 or rows > int(v):
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Above the size of any file: both the most bytes of a task and what counts for opening a file.
WHOLE = {"spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40)}


@contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """Within, each file that is read is one task, neither cut nor put together with others: for tables that were dealt to as many files as there are cores.  The session's own settings are put back."""
    before = {k: spark.conf.get(k) for k in WHOLE}
    for k, v in WHOLE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Tables written by ``materialise`` and not yet deleted, by session folder.
_written: dict[str, DataFrame] = {}


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and go on from there, with its shuffle files removed.

    A lost executor then costs the step at hand, not those before it.  A table that was written has no known partitioning, so a join with it
    puts a plain exchange on both sides, which is the shape that adaptive execution can split when a key is hot.
    The table is deleted by ``drop``, at the end of ``tables_freed``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_freed(spark), small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _written[path] = out
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.pop(df.written_to, None)


@contextmanager
def tables_freed() -> Iterator[None]:
    """Delete at the end what ``materialise`` has written within: for callers that have stored their result by then."""
    before = set(_written)
    try:
        yield
    finally:
        drop(*[df for path, df in _written.items() if path not in before])
