"""Places in sorted groups, where one group may hold most of the rows.

Rows are dealt out by ranges of (group, order), so a large group lies in several neighbouring partitions. Each partition
numbers its own rows as they stream by. What an earlier partition holds of a partition's first group is known from one
row for each partition, as ``zipWithIndex`` does it; only these rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import spool


def _fresh(column: pa.Array, last: list):
    """Whether each value differs from the one before it; null equals null. last: the value before the batch, or nothing."""
    import numpy as np

    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate(([not last or column[0].as_py() != last[0]], codes[1:] != codes[:-1]))


def numbered(df: DataFrame, group: str, order: tuple[str, ...], measure: str | None = None) -> DataFrame:
    """The rows, stored, with ``group_at`` (the group's place among all groups), ``at`` (the row's place in its group, from 0) and ``before`` (the sum of ``measure`` over the rows before it in its group, or 0).

    Ascending, nulls first; rows that are equal in group and order are in any order.
    """
    spark = df.sparkSession
    sort = [F.col(c).asc_nulls_first() for c in (group, *order)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("part", "run", "at", "before"))])
    where, size = df.columns.index(group), df.columns.index(measure) if measure else None

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, run, last, at, total = TaskContext.get().partitionId(), -1, [], 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _fresh(batch.column(where), last)
            last = [batch.column(where)[n - 1].as_py()]
            runs = run + np.cumsum(fresh)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))  # -1: the group began in an earlier batch
            places = np.where(begin < 0, at + np.arange(n), np.arange(n) - begin)
            weight = pc.fill_null(batch.column(size), 0).to_numpy(zero_copy_only=False).astype(np.int64) if measure else np.zeros(n, np.int64)
            sums = np.concatenate(([0], np.cumsum(weight)))
            before = np.where(begin < 0, total + sums[:-1], sums[:-1] - sums[np.maximum(begin, 0)])
            run, at, total = int(runs[-1]), int(places[-1]) + 1, int(before[-1] + weight[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (np.full(n, part, np.int64), runs, places, before))], names=schema.names)

    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    stored = spool(ranged.mapInArrow(number, schema), "numbered")
    told = F.struct("run", F.col(group).alias("group"), F.col("at"), (F.col("before") + (F.coalesce(F.col(measure), F.lit(0)) if measure else F.lit(0))).alias("total"))
    # Two rows of each partition meet here: the last of its first group, and its last.
    edges = stored.groupBy("part").agg(F.max(F.when(F.col("run") == 0, F.struct("at", told.alias("e")))).alias("first"), F.max(F.struct("run", "at", told.alias("e"))).alias("last")).orderBy("part").collect()
    moved, base, open_group, at, total = [], 0, [], 0, 0
    for e in edges:
        first, last = e["first"]["e"], e["last"]["e"]
        goes_on = open_group == [first["group"]]
        if not goes_on:
            at = total = 0
        base -= goes_on
        moved.append((e["part"], base, at, total))
        base += last["run"] + 1
        carried = (at, total) if last["run"] == 0 else (0, 0)
        open_group, at, total = [last["group"]], carried[0] + last["at"] + 1, carried[1] + last["total"]
    shift = spark.createDataFrame(moved, "part long, base long, more_at long, more_before long")  # a row for each partition
    first = F.col("run") == 0
    return stored.join(F.broadcast(shift), "part").select(
        *(stored[c] for c in df.columns),
        (F.col("base") + F.col("run")).alias("group_at"),
        (F.col("at") + F.when(first, F.col("more_at")).otherwise(0)).alias("at"),
        (F.col("before") + F.when(first, F.col("more_before")).otherwise(0)).alias("before"),
    )
