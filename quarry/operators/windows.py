"""Window-shaped computations over rows with a key and an explicit order (key, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recency(rows: DataFrame) -> DataFrame:
    """``weight`` (position + 1) / n and ``score`` position / (n - 1), 0 for a single row."""
    whole = Window.partitionBy("key")
    n = F.count("*").over(whole)
    return rows.withColumn("weight", (F.col("seq") + 1) / n).withColumn("score", F.percent_rank().over(whole.orderBy("seq")))


def length_quartile(rows: DataFrame, by: str, block: int = 1 << 16) -> DataFrame:
    """``quartile`` min(3, floor(position * 4 / n)) in order of length and then of id (a whole number); groups of uneven size differ from ntile.

    A group may hold a third of all rows, so positions are sums of counts: before the length, before the block of ids
    within the length, and within the block.
    """
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    placed = rows.withColumn("_block", F.floor(F.col("id") / block))
    blocks = placed.groupBy(by, "length", "_block").agg(F.count("*").alias("_c"))
    inside = blocks.withColumn("_first", none(F.sum("_c").over(before(by, "length", "_block"))))
    lengths = rows.groupBy(by, "length").agg(F.count("*").alias("_c"))
    starts = lengths.select(by, "length", none(F.sum("_c").over(before(by, "length"))).alias("_start"), F.sum("_c").over(Window.partitionBy(by)).alias("_n"))
    offsets = inside.join(starts, [by, "length"]).select(by, "length", "_block", (F.col("_first") + F.col("_start")).alias("_first"), "_n")
    place = F.row_number().over(Window.partitionBy(by, "length", "_block").orderBy("id")) - 1 + F.col("_first")
    return placed.join(offsets, [by, "length", "_block"]).withColumn("quartile", F.least(F.lit(3), F.floor(place * 4 / F.col("_n"))).cast("int")).drop("_block", "_first", "_n")


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def spread(rows: DataFrame, k: int) -> DataFrame:
    """k rows of each key spread evenly from first to last, positions rounded half to even; all where there are no more."""
    n = F.count("*").over(Window.partitionBy("key"))
    counted = rows.withColumn("_n", n)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / max(1, k - 1)).cast("long"))
    return counted.where((F.col("_n") <= k) | F.array_contains(at, F.col("seq").cast("long"))).drop("_n")


def budget(rows: DataFrame, limit: int) -> DataFrame:
    """Rows from the start while their summed cost is within a limit, one at least, with what is ``spent``."""
    order = Window.partitionBy("key").orderBy("seq")
    told = rows.withColumn("spent", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(order))
    return told.where((F.col("spent") <= limit) | (F.col("_n") == 1)).drop("_n")


def label_bank(rows: DataFrame, each: int, overall: int) -> DataFrame:
    """In each group (grp) the best ``each`` rows of a label, and the best ``overall`` of all."""
    label = Window.partitionBy("grp", "label").orderBy(F.desc("score"), "id")
    group = Window.partitionBy("grp").orderBy(F.desc("score"), "id")
    told = rows.withColumn("_m", F.row_number().over(label)).withColumn("_k", F.row_number().over(group))
    return told.where((F.col("_m") <= each) | (F.col("_k") <= overall)).select("grp", "id", "label", "score")


def round_robin(rows: DataFrame, n: int) -> DataFrame:
    """n rows, one of each stratum in turn, shortest first."""
    at = F.row_number().over(Window.partitionBy("stratum").orderBy("length", "id")) - 1
    return rows.withColumn("round", at).orderBy("round", "stratum", "id").limit(n).select("id", "stratum", "round")


def quota(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def water_filled(rows: DataFrame, by: str, order: str, total: int) -> DataFrame:
    """``total`` rows, of each group as many as of the others where it has them: the groups give a row each in turn, in order of their names."""
    return quota(rows, by, order, total).withColumn("_turn", F.row_number().over(Window.partitionBy(by).orderBy(order))).orderBy("_turn", by).limit(total).drop("_turn")


def sessions_by_change(rows: DataFrame) -> DataFrame:
    """key, seq, ``session`` (from 1) and ``turn`` in it: a session ends where the stamp changes; a missing stamp goes on with the one before."""
    order = Window.partitionBy("key").orderBy("seq")
    filled = rows.withColumn("stamp", F.last("stamp", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = (~F.col("stamp").eqNullSafe(F.lag("stamp").over(order))).cast("int")
    numbered = filled.withColumn("_new", new).withColumn("session", F.greatest(F.lit(1).cast("long"), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return numbered.select("key", "seq", "session", F.row_number().over(Window.partitionBy("key", "session").orderBy("seq")).alias("turn"))


def tumbling(rows: DataFrame, n: int) -> DataFrame:
    """``window``: rows of a key by n."""
    return rows.withColumn("window", F.floor(F.col("seq") / n))


def trim_history(rows: DataFrame, last: int, limit: int) -> DataFrame:
    """The first row of a key and its last few, the oldest of them dropped until all costs are within a limit."""
    order = Window.partitionBy("key").orderBy("seq")
    told = rows.withColumn("_n", F.row_number().over(order)).withColumn("_back", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))).where((F.col("_n") == 1) | (F.col("_back") <= last))
    held = F.sum("cost").over(Window.partitionBy("key").orderBy(F.desc(F.col("_n") == 1), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("_held", held).where((F.col("_n") == 1) | (F.col("_held") <= limit)).select("key", "seq", "cost")
