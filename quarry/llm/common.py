"""What the corpus operators share: column selection, shared storage, Arrow limits."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: How rows of megabytes are written. By default sizes are looked at after a hundred rows, and a row group is held whole by the task that writes
#: it and several times over by one that reads it; and every group's least and greatest value, here all of it, is kept until the file ends. So
#: each row is looked at, a group is a few rows, and there are no statistics.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling and position: columns beside them that differ in case or repeat a name do no harm."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable is never inlined into the body."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset, a local one is made if all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts lineage and keeps a lost executor from repeating the work."""
    spark = df.sparkSession
    df.write.options(**options).parquet(path := shared_dir(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the batches sent to Python workers, so that long texts don't add up.

    Also pins how files are split: the default follows the cores that are registered just then, so that a lost executor
    between two reads of a table would number its rows differently.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


@contextlib.contextmanager
def uncollected():
    """In a Python worker: no looking for reference cycles meanwhile, where millions of small objects are made but no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def lean_memory() -> None:
    """In a Python worker: freed arrays of a megabyte or more go back to the system at once, so a reused worker doesn't keep its largest task's memory."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries manage on their own
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
