"""State that follows sessions, in batch and as Structured Streaming.

The batch twins fold each key's rows in order; the streaming ones keep a key's state between micro-batches. Both give the same rows for the same input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def buffered(rows: DataFrame, last: int, limit: int) -> DataFrame:
    """What a session (key, seq, content) may read: the last few before it, of which the last characters; a sentence where there are none."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(-last, -1)
    text = F.array_join(F.collect_list("content").over(before), "\n")
    return rows.select("key", "seq", F.when(F.count("*").over(before) == 0, "No previous memory.").otherwise(F.when(F.length(text) > limit, F.right(text, F.lit(limit))).otherwise(text)).alias("memory"))


def beliefs(rows: DataFrame, evidence: int = 3) -> DataFrame:
    """A candidate of a key by lower-case name: its first and last session, last verdict, and first pieces of evidence (key, seq, name, verdict, content)."""
    name = F.lower(F.trim("name"))
    grouped = rows.groupBy("key", name.alias("name")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("verdict", "seq").alias("verdict"), F.sort_array(F.collect_set(F.struct("seq", "content"))).alias("all"))
    return grouped.select("key", "name", "first", "last", "verdict", F.slice(F.transform("all", lambda e: e["content"]), 1, evidence).alias("evidence"))


def latest(changes: DataFrame) -> DataFrame:
    """A keyed store after a log of changes (id, seq, op, content): the last ``put`` of an id since its last ``delete``, at the place where it was first put."""
    last = F.max_by(F.struct("op", "content"), "seq")
    gone = F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))), F.lit(-1))
    puts = changes.groupBy("id").agg(last.alias("last"), gone.alias("gone"), F.sort_array(F.collect_list(F.when(F.col("op") == "put", F.col("seq")))).alias("puts"))
    return puts.where("last.op = 'put'").select("id", F.filter("puts", lambda s: s > F.col("gone"))[0].alias("place"), F.col("last.content").alias("content"))


def capped(store: DataFrame, most: int) -> DataFrame:
    """The ``most`` records of a key (key, id, place) with the latest places; the oldest are evicted."""
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("place"), F.desc("id")))
    return store.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def utilities(rows: DataFrame, alpha: float = 0.3, start: float = 0.0, floor: float | None = None) -> DataFrame:
    """The value of each key after its rewards in order (key, seq, reward): q becomes (1 - alpha) q + alpha reward, not below the floor; with visits and the mean reward's trace.

    A step is a map q -> max(c, a q + b), and two such maps in turn are one again. So rows are dealt out by ranges of key and seq; a task
    folds each run of a key that it holds into one map, and a key's maps, one for each task, are applied in order. A key with most of the
    rows is folded by many tasks.
    """
    least = float("-inf") if floor is None else floor

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, state = TaskContext.get().partitionId(), [], (0, 1.0, 0.0, least, 0.0)
        names = ["key", "part", "n", "a", "b", "c", "m"]

        def made(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.int32(), pa.int64(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        kind = None
        for batch in batches:
            done, kind = [], batch.column(0).type
            for key, reward in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if last != [key]:
                    if last:
                        done.append((last[0], part, *state))
                    last, state = [key], (0, 1.0, 0.0, least, 0.0)
                n, a, b, c, m = state
                step = (1 - alpha) * c + alpha * reward if n else least
                state = (n + 1, (1 - alpha) * a, (1 - alpha) * b + alpha * reward, max(least, step), (1 - alpha) * m + alpha * reward)
            if done:
                yield made(done, kind)
        if last:
            yield made([(last[0], part, *state)], kind)

    order = [F.col(c).asc_nulls_first() for c in ("key", "seq", "reward")]
    ranged = rows.select("key", "seq", F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward")).repartitionByRange(*order).sortWithinPartitions(*order)
    maps = ranged.mapInArrow(folded, f"key {rows.schema['key'].dataType.simpleString()}, part int, n long, a double, b double, c double, m double")
    runs = maps.groupBy("key").agg(F.sum("n").alias("visits"), F.sort_array(F.collect_list(F.struct("part", "a", "b", "c", "m"))).alias("maps"))  # one of each task at most
    apply = lambda s, f: F.struct(F.greatest(f["c"], f["a"] * s["q"] + f["b"]).alias("q"), (f["a"] * s["mean"] + f["m"]).alias("mean"))
    result = F.aggregate("maps", F.struct(F.lit(start).alias("q"), F.lit(0.0).alias("mean")), apply)
    return runs.select("key", "visits", result.alias("s")).select("key", "visits", F.round("s.q", 9).alias("q"), F.round("s.mean", 9).alias("reward_mean"))


class Utility(StatefulProcessor):
    """The streaming twin of ``utilities``: a value, a trace and a count for each key."""

    def __init__(self, alpha: float = 0.3, start: float = 0.0):
        self.alpha, self.start = alpha, start

    def init(self, handle) -> None:
        self.state = handle.getValueState("utility", "q double, mean double, visits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        q, mean, visits = self.state.get() if self.state.exists() else (self.start, 0.0, 0)
        for reward in pd.concat(rows).sort_values("seq")["reward"]:
            q = (1 - self.alpha) * q + self.alpha * reward
            mean = (1 - self.alpha) * mean + self.alpha * reward
            visits += 1
        self.state.update((q, mean, visits))
        yield pd.DataFrame({"key": [key[0]], "visits": [visits], "q": [round(q, 9)], "reward_mean": [round(mean, 9)]})

    def close(self) -> None:
        pass


def stream_utilities(rows: DataFrame, alpha: float = 0.3, start: float = 0.0) -> DataFrame:
    """Updated utilities of the keys in each micro-batch of a stream (key, seq, reward)."""
    return rows.groupBy("key").transformWithStateInPandas(Utility(alpha, start), "key long, visits long, q double, reward_mean double", "Update", "None")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An extension: counts and sums by event time (ts, event_type, value), closed by a watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
