"""The supplied tables in the engine's canonical shapes, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Below so many bytes a table may be a single row group, which one core reads.
SMALL = 1 << 28


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A small table dealt out by its key, so that all cores work on its texts; a larger one as it is read."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key) if size < SMALL else rows


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as units: id, content, lang, source."""
    return dealt(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source"), "id")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark passage as a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as dialogue turns: conv_id, turn, role, content."""
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the ordered steps of each user: key, seq (from 0), type, value, ts, success and reward."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("key"),
        (F.row_number().over(w) - 1).alias("seq"),
        "event_id",
        "event_type",
        "value",
        "ts",
        (F.col("event_type") == "purchase").alias("success"),
        F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0).alias("reward"),
    )


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of all embeddings, and as queries those with an id divisible by 50."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.select("id", "vector"), e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def _list(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


#: SQL of the same shapes.
U = "u AS (SELECT doc_id AS id, coalesce(text,'') AS content, lang, source FROM documents)"
Q = "q AS (SELECT item_id AS query_id, coalesce(text,'') AS query FROM benchmark)"
T = "t AS (SELECT conv_id, turn, role, coalesce(text,'') AS content FROM conversations)"
S = "s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, event_type, value, ts, event_type='purchase' AS success, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM events)"
WORDS = "regexp_extract_all(lower({0}),'[a-z0-9]+')"
UWORDS = "regexp_extract_all(lower({0}),'[a-z0-9_]+')"


def stopped(words: str, stop: list[str]) -> str:
    return f"list_filter({words}, lambda x: NOT list_contains({_list(stop)}, x))"


def top(source: str, k: int, columns: str = "query_id, id, score", by: str = "query_id") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id)::INT AS rank FROM {source}) WHERE rank <= {k}"
