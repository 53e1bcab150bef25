"""Stored memories over versioned tables: a vector table as a log of changes, cached embeddings, and a whole store as JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import models
from quarry.operators import vectors
from quarry.sources.shared import shared_folder  # noqa: F401  # named here for callers
from quarry.sources.versions import VersionedTable


class VectorStore:
    """Records (id, content, meta, vector) as a versioned log of changes; the latest of an id counts.

    Adding an id again replaces it, deleting an unknown one does nothing, and a cleared or fresh store is empty. Several writers may
    change it at a time. An index of the vectors is built at the first search of a version and used until the next.
    """

    SCHEMA = "id long, content string, meta string, vector array<float>, gone boolean"

    def __init__(self, spark: SparkSession, path: str, model: Callable[[list[str]], list[list[float]]] = models.hashed_embedding):
        self.spark, self.model = spark, model
        self.table = VersionedTable(spark, path, self.SCHEMA)
        self._index: tuple[int, vectors.VectorIndex] | None = None

    def _append(self, rows: DataFrame, gone: bool) -> None:
        self.table.append(rows.withColumn("gone", F.lit(gone)).select("id", "content", "meta", "vector", "gone"))

    def add(self, rows: DataFrame) -> None:
        """rows: id, content and perhaps meta (JSON) and vector; without a vector the content is embedded."""
        if "meta" not in rows.columns:
            rows = rows.withColumn("meta", F.lit("{}"))
        if "vector" not in rows.columns:
            rows = models.embed(rows, "content", self.model).withColumnRenamed("embedding", "vector")
        self._append(rows.select("id", "content", "meta", F.col("vector").cast("array<float>").alias("vector")), False)

    def delete(self, ids: DataFrame) -> None:
        none = lambda kind: F.lit(None).cast(kind)
        self._append(ids.select("id", none("string").alias("content"), none("string").alias("meta"), none("array<float>").alias("vector")), True)

    def clear(self) -> None:
        self.table.replace(None)

    @staticmethod
    def _current(log: DataFrame) -> DataFrame:
        last = F.max(F.struct("change", "gone", "content", "meta", "vector")).alias("last")
        return log.groupBy("id").agg(last).where("not last.gone").select("id", "last.content", "last.meta", "last.vector")

    def records(self, version: int | None = None) -> DataFrame:
        """The records as they are now, or as a version had them; of an id added twice in one change the greater content."""
        return self._current(self.table.rows(version))

    def get(self, ids: DataFrame) -> DataFrame:
        return self.records().join(ids.select("id").distinct(), "id")

    def count(self) -> int:
        return self.records().count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest records of each query (query_id, query: text or vector) by 1 / (1 + squared distance); a blank text finds nothing."""
        if dict(queries.dtypes)["query"] == "string":
            asked = models.embed(queries.where("trim(query) <> ''"), "query", self.model)
            queries = asked.select("query_id", F.col("embedding").alias("query"))
        version, _ = self.table.latest()
        if self._index is None or self._index[0] != version:
            self._index = version, vectors.build(self.records(version or None).select("id", "vector"), "l2")
        return vectors.search(self._index[1], queries, k)

    def compact(self) -> None:
        """Writes the records as one change, so that a long log of changes is read no more."""
        self.table.compact(lambda log: self._current(log).withColumn("gone", F.lit(False)))


def embedded(records: DataFrame, path: str, model: Callable[[list[str]], list[list[float]]] = models.hashed_embedding, limit: int = 1500) -> DataFrame:
    """Records (id, compact, title, content) with their embedding; only texts without a stored one are embedded, and then stored under path.

    The text is compact and title, or the content where both are blank, cut to a limit; records without any text are left out.
    Equal texts share an embedding.
    """
    spark = records.sparkSession
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = F.substring(F.trim(F.concat(part("compact"), F.lit(" "), part("title"))), 1, limit)
    text = F.when(named != "", named).otherwise(F.substring(part("content"), 1, limit))
    rows = records.select("id", text.alias("text")).where("text <> ''").withColumn("key", F.sha2("text", 256))
    known = VersionedTable(spark, path, "key string, embedding array<float>")
    fresh = rows.groupBy("key").agg(F.first("text").alias("text")).join(known.rows(), "key", "left_anti")
    known.append(models.embed(fresh, "text", model).select("key", "embedding"))
    # Two writers may have stored one text.
    return rows.join(known.rows().groupBy("key").agg(F.first("embedding").alias("embedding")), "key").select("id", "key", "embedding")


_STORE = "kind string, id long, title string, content string"


def persist_store(records: DataFrame, history: DataFrame, path: str, keep: int = 200) -> None:
    """A whole store as JSON lines: its records (id, title, content), and the last ``keep`` lines of its history (seq, content)."""
    last = history.orderBy(F.desc("seq")).limit(keep)
    rows = records.select(F.lit("record").alias("kind"), F.col("id").cast("long").alias("id"), "title", "content").unionByName(last.select(F.lit("history").alias("kind"), F.col("seq").cast("long").alias("id"), F.lit(None).cast("string").alias("title"), "content"))
    VersionedTable(records.sparkSession, path, _STORE, "json").replace(rows)


def restore_store(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTable(spark, path, _STORE, "json").rows().drop("change")
