"""Sharding by a two-pass external shuffle: seeded scatter into memory-sized buckets, then a Fisher-Yates shuffle of each.

Pass one is Spark's own disk-backed exchange: a seeded hash scatters records uniformly over enough buckets that one fits
a task's memory. Pass two sorts each bucket (so that the order of arrival doesn't matter), shuffles it with Spark's
Fisher-Yates ``shuffle`` and writes it to the shared folder. A record's place in the whole permutation is its bucket's
offset plus its place there; dealing places round-robin over the shards makes their counts at most one apart.

Defined results: nulls in any column are carried (a null text has size 16 and the checksum of no bytes); repeated rows
are scattered like any other, as the hash also takes a row number, so no key or group of copies fills a bucket; an
empty table gives no rows; columns beside those asked for are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import narrow, spool

ROW_BYTES = 16
#: Buckets whose counts are summed in one task: at 100 TB some 3,000 tasks with as many buckets each, and one with 3,000 sums.
RUN = 4096
#: Buckets that a partition takes one after another where there are very many: at 100 TB 800,000 partitions of 128 MB.
TOGETHER = 16


def two_pass_shuffle(df: DataFrame, columns: tuple[str, ...], seed: int = 17, bucket_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """The columns in shuffled order, stored: ``__bucket`` and ``__at``, the place in the bucket, tell a record's place."""
    rows = narrow(df, *columns)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    total = rows.agg(F.sum(size)).first()[0] or 0
    spark, buckets = df.sparkSession, max(1, ceil(total / bucket_bytes))
    partitions = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(buckets / TOGETHER)))
    scattered = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(columns[0]), F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    gathered = scattered.repartition(partitions, "__bucket").groupBy("__bucket").agg(F.collect_list(F.struct(*columns)).alias("__rows"))
    mixed = gathered.select("__bucket", F.posexplode(F.shuffle(F.sort_array("__rows"), seed)).alias("__at", "__row"))
    # A partition's buckets are sorted and taken one after another; the hash aggregate would hold them side by side.
    hashed = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(hashed)
    spark.conf.set(hashed, "false")
    try:
        return spool(mixed.select("__bucket", "__at", "__row.*"), "shuffled")
    finally:
        spark.conf.set(hashed, before)


def _offsets(counts: DataFrame, run: int = RUN) -> DataFrame:
    """``__first``: the rows of all buckets before each. Sums within runs of ``run`` buckets, after one sum for each run: no task sees all buckets."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__run", F.floor(F.col("__bucket") / run).cast("int"))
    runs = placed.groupBy("__run").agg(F.sum("__n").alias("__n"))
    starts = runs.select("__run", F.coalesce(F.sum("__n").over(before(Window.orderBy("__run"))), F.lit(0)).alias("__start"))
    inside = placed.select("__bucket", "__run", F.coalesce(F.sum("__n").over(before(Window.partitionBy("__run").orderBy("__bucket"))), F.lit(0)).alias("__inside"))
    return inside.join(starts, "__run").select("__bucket", (F.col("__start") + F.col("__inside")).alias("__first"))


def deal(shuffled: DataFrame, shuffled_ids: DataFrame, shards: int) -> DataFrame:
    """``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) in place of the bucket and the place in it.

    shuffled: what is wanted of the stored records, which may be less than they hold; shuffled_ids: all of them, to count the buckets.
    """
    offsets = _offsets(shuffled_ids.groupBy("__bucket").agg(F.count("*").alias("__n")))
    place = F.col("__first") + F.col("__at")
    kept = [c for c in shuffled.columns if c not in ("__bucket", "__at")]
    return shuffled.join(offsets, "__bucket").select(*kept, (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard; its files hold consecutive runs of slots, so that a shard of any size is written by many tasks."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
