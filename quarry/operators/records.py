"""Records out of free text, roll-ups of them, and small joins by position or alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def first_split(text: Column, patterns: list[str]) -> Column:
    """The parts by the first pattern that gives more than one, else the whole text; blank parts are left out."""
    chosen = F.array(text)
    for p in reversed(patterns):
        parts = F.filter(F.transform(F.split(text, p), lambda t: F.trim(t)), lambda t: t != "")
        chosen = F.when(F.size(parts) > 1, parts).otherwise(chosen)
    return chosen


def action_turns(docs: DataFrame) -> DataFrame:
    """Turns (id, turn, action, observation) of lines that begin ``Action:`` or ``Observation:``; other lines go on with the one before."""
    lines = docs.select("id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    order = Window.partitionBy("id").orderBy("line")
    kind = F.when(F.col("text").startswith("Action:"), "a").when(F.col("text").startswith("Observation:"), "o")
    told = lines.withColumn("kind", F.last(kind, ignorenulls=True).over(order)).withColumn("turn", F.sum(F.col("text").startswith("Action:").cast("int")).over(order))
    body = F.trim(F.regexp_replace("text", "^(Action|Observation):", ""))
    part = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("line", body.alias("b"))))), lambda x: x["b"]), "\n")
    return told.where("turn > 0").groupBy("id", "turn").agg(part("a").alias("action"), part("o").alias("observation"))


def labelled_lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, line, label, value) of lines ``label: value``, of texts with ``least`` of them or more."""
    lines = docs.select("id", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("label", F.regexp_extract("text", r"^([A-Za-z][A-Za-z0-9 _-]{0,30}):\s+(.+)$", 1)).where("label <> ''")
    n = F.count("*").over(Window.partitionBy("id"))
    return lines.withColumn("n", n).where(F.col("n") >= least).select("id", "line", "label", F.regexp_extract("text", r"^[^:]+:\s+(.+)$", 1).alias("value"))


def rolled_up(rows: DataFrame, width: int, summarise) -> DataFrame:
    """Levels of summaries: each ``width`` neighbours (grp, seq, content) become one, until a group has one left. Returns (grp, level, seq, content)."""
    level, done = rows.select("grp", "seq", "content"), None
    deepest = rows.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = 0
    while deepest > 1:
        depth, deepest = depth + 1, -(-deepest // width)
        place = F.row_number().over(Window.partitionBy("grp").orderBy("seq")) - 1
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda r: r["content"]), "\n")
        level = level.withColumn("at", F.floor(place / width).cast("long")).groupBy("grp", "at").agg(joined.alias("content")).select("grp", F.col("at").alias("seq"), summarise(F.col("content")).alias("content"))
        done = level.withColumn("level", F.lit(depth)) if done is None else done.unionByName(level.withColumn("level", F.lit(depth)))
    return done if done is not None else level.withColumn("level", F.lit(0))


def expanded(queries: DataFrame, aliases: DataFrame, most: int = 5) -> DataFrame:
    """Queries (query_id, query) with the aliases (name, alias) of the names among their words, five at most for a name."""
    kept = aliases.withColumn("_at", F.row_number().over(Window.partitionBy("name").orderBy("alias"))).where(F.col("_at") <= most)
    words = queries.select("query_id", F.explode(F.array_distinct(X.words(F.col("query")))).alias("name"))
    more = words.join(kept, "name").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), " | ").alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" | ", "query", "more").alias("query"))


def zipped(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables side by side by their position within a key."""
    at = lambda d, o: d.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(o)) - 1)
    return at(a, order_a).join(at(b, order_b), [key, "pos"])


def missing_keys(wanted: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Keys that the pool lacks; a validation raises if there is any."""
    return wanted.select(key).distinct().join(pool.select(key), key, "left_anti")


def slots(requests: DataFrame, days: DataFrame, kinds: DataFrame) -> DataFrame:
    """Distinct (id, day, slot) that the sentences of requests (id, content) name; a sentence with a slot but no day means all days. days: day, word; kinds: slot, word."""
    sentences = requests.select("id", F.posexplode(F.split(F.lower("content"), r"[.!?\n]+")).alias("at", "s")).select("id", "at", F.explode(F.array_distinct(X.words(F.col("s")))).alias("word"))
    named = sentences.join(kinds, "word").select("id", "at", "slot").distinct()
    dated = sentences.join(days, "word").select("id", "at", "day").distinct()
    with_day = named.join(dated, ["id", "at"]).select("id", "day", "slot")
    every = named.join(dated, ["id", "at"], "left_anti").join(F.broadcast(days.select("day").distinct())).select("id", "day", "slot")  # a row for each day of a plan
    return with_day.unionByName(every).distinct()


def tiers(first: DataFrame, second: DataFrame, third: DataFrame, threshold: float) -> DataFrame:
    """For each query the first of three ranked lists that has a hit (the first only at a score of the threshold or more)."""
    good = first.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") >= threshold).select("query_id")
    a = first.join(good, "query_id", "left_semi").withColumn("tier", F.lit(1))
    b = second.join(good, "query_id", "left_anti").withColumn("tier", F.lit(2))
    c = third.join(good, "query_id", "left_anti").join(second.select("query_id").distinct(), "query_id", "left_anti").withColumn("tier", F.lit(3))
    return a.unionByName(b).unionByName(c)
