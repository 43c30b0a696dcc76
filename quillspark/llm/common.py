"""What the operators of this subpackage share: tables, the shared folder, held-out folds."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TASK_BYTES = 64 << 20  # of compressed tables


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python need not have it on its path; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    context._quillspark_shipped = True
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default; rows here are whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("67108864b", "64m"):  # likewise
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quillspark-code-")  # Spark serves the file from here until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors all see, below spark.checkpoint.dir.

    Only where that setting is absent and Spark runs in one process (tests) a temporary folder takes its place.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, scan: bool = False, large: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors.

    A scan of whole texts keeps its tasks. What comes from joins and groups goes to one task for `TASK_BYTES` of what it
    reads, at least two for each core, where the shuffle left more. What is no longer needed goes with `release`.
    Large rows, of megabytes, are row groups of their own: else a file's writer holds a hundred of them before it looks at
    their size, and its reader all of them at once.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if not scan:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        df = df.coalesce(min(1 << 30, max(2 * spark.sparkContext.defaultParallelism, read // TASK_BYTES)))
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", "1") if large else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


@contextmanager
def runtime_filters(spark: SparkSession, least: str = "1m"):
    """Within this, joins of a table from that size on with a much smaller one get Spark's Bloom filter, whose size is
    fixed, so that rows without a partner are not shuffled. Spark itself does so from 10 GB on."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, least)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that `materialise` returned and that nothing reads any more."""
    for df in frames:
        discard(df.sparkSession, df._materialised)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lean(function):
    """The function of a mapInArrow, which at its end gives freed memory back to the system: Python workers live on
    between tasks, and what one stage needed would else count against the next. Also sends this package out first."""
    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))
