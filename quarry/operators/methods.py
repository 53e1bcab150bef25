"""What a memory method is made of: an index builder, retrievers, compositors and an answerer, as protocols over DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import models
from quarry.operators import ranking


class IndexBuilder(Protocol):
    """Documents (id, content, ...) to an index: units, or any table that a retriever of its kind takes."""

    def __call__(self, documents: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    """The k best rows of an index for each query (query_id, query): query_id, id, score, rank."""

    def __call__(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class Compositor(Protocol):
    """One ranked list out of several retrievers'."""

    def __call__(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Filtered:
    """Three times as many hits as asked for, of which those stay whose row has the given values and passes a predicate (a column expression)."""

    base: Retriever
    equal: dict[str, object] = field(default_factory=dict)
    predicate: Callable[[DataFrame], Column] | None = None

    def __call__(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        rows = index.drop("content") if "content" in index.columns else index
        hits = self.base(index, queries, 3 * k).select("query_id", "id", "score").join(rows, "id")
        for column, value in self.equal.items():
            hits = hits.where(F.col(column).eqNullSafe(F.lit(value)))
        if self.predicate is not None:
            hits = hits.where(self.predicate(hits))
        return ranking.top(hits.select("query_id", "id", "score"), k, ["query_id"])


@dataclass(frozen=True)
class Fused:
    """Reciprocal-rank fusion of several retrievers, each asked for twice as many."""

    parts: tuple[tuple[Retriever, float], ...]

    def __call__(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return ranking.reciprocal_rank_fusion([(r(index, queries, 2 * k), w) for r, w in self.parts], k, ["query_id"])


@dataclass
class Method:
    """Builds an index of documents and answers questions from what it retrieves, with counters of both phases."""

    builder: IndexBuilder
    retriever: Retriever
    answerer: Callable[[list[str]], list[str]] = models.first_sentence
    k: int = 5
    counters: dict[str, float] = field(default_factory=dict)

    def _timed(self, phase: str, work):
        began = time.perf_counter()
        made = work()
        self.counters[phase] = self.counters.get(phase, 0.0) + time.perf_counter() - began
        return made

    def build(self, documents: DataFrame) -> DataFrame:
        return self._timed("build", lambda: self.builder(documents))

    def context(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        """query_id and the contents found, best first."""
        hits = self.retriever(index, queries, self.k).join(index.select("id", "content"), "id")
        rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("rows"))  # k rows
        return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["content"]), "\n\n").alias("context"))

    def answer(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        return self._timed("answer", lambda: models.generate(self.context(index, queries), "context", self.answerer, "answer"))

    def run_episode(self, step: Callable[[str], tuple[str, bool]], act: Callable[[list[str]], str], most: int = 50) -> list[tuple[str, str]]:
        """An agent's episode: actions chosen from the observations so far, until the environment says that it is done."""
        seen, told = [], []
        for _ in range(most):
            action = act(seen)
            observation, done = step(action)
            seen.append(observation)
            told.append((action, observation))
            if done:
                break
        self.counters["steps"] = self.counters.get("steps", 0.0) + len(told)
        return told
