"""Named sources: a reader with its category, memory axes and variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """``read(spark, path)`` gives the rows of a source."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    category: str = "uncategorized"
    axes: tuple[str, ...] = ()
    style: str = "dialogue_qa"
    variants: tuple[str, ...] = ()


class Sources:
    def __init__(self) -> None:
        self._known: dict[str, Source] = {}

    def register(self, source: Source, *aliases: str) -> None:
        for name in (source.name, *aliases):
            self._known[name.strip().lower()] = source

    def get(self, name: str) -> Source:
        key = name.strip().lower()
        if key not in self._known:
            raise KeyError(f"{name}: known are {', '.join(self.available())}")
        return self._known[key]

    def available(self) -> list[str]:
        return sorted(self._known)

    def by_category(self, canonical: bool = False) -> dict[str, list[str]]:
        """Names of each category, aliases with them or only each source's own."""
        found: dict[str, set[str]] = {}
        for name, s in self._known.items():
            found.setdefault(s.category, set()).add(s.name if canonical else name)
        return {c: sorted(found[c]) for c in sorted(found)}

    def describe(self, name: str) -> dict:
        s = self.get(name)
        return {"name": s.name, "category": s.category, "memory_axes": list(s.axes), "interface_style": s.style, "variants": sorted(s.variants)}

    def read(self, name: str, spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
        """The rows of a source, or only those of a domain."""
        rows = self.get(name).read(spark, path)
        return rows if domain is None else rows.where(F.col("domain") == domain)


def any_format(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of JSON lines under a folder, or of Parquet where it holds that instead."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*.parquet"))
        reader = spark.read.schema(schema)
        return reader.parquet(path) if found is not None and len(found) else reader.json(path)

    return read
