"""The folder that all executors share, tables stored in it, and the size of what goes to Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How rows of megabytes are written. By default sizes are looked at after a hundred rows, and a row group is held whole by the task that writes
#: it and several times over by one that reads it; and every group's least and greatest value, here all of it, is kept until the file ends. So
#: each row is looked at, a group is a few rows, and there are no statistics.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``shared_root``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts lineage, and a lost executor repeats only the reading."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows of a batch sent to Python workers by the plans that follow, so that long ones don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
