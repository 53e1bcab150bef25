"""Index builders: documents to units. Sequential packing is a fold over the blocks of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def token_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, stop_early: bool = False) -> DataFrame:
    """Windows of ``size`` words, each ``size - overlap`` on: id, chunk, start, end, content. An empty text is one empty chunk.

    Without ``stop_early`` the last window may lie wholly in the one before it; with it, windows end with the first that reaches the end.
    """
    step = size - overlap
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    if stop_early:
        starts = F.filter(starts, lambda s: (s == 0) | (s - step + size < n))
    rows = docs.select("id", X.split_words(F.col("content")).alias("words")).select("id", "words", F.posexplode(starts).alias("chunk", "start"))
    end = F.least(F.col("start") + size, n)
    return rows.select("id", "chunk", "start", end.alias("end"), F.array_join(F.slice("words", F.col("start") + 1, F.lit(size)), " ").alias("content"))


def character_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters: id, chunk, content."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.where("content <> ''").select("id", "content", F.posexplode(starts).alias("chunk", "start"))
    return rows.select("id", "chunk", F.substring(F.col("content"), F.col("start") + 1, F.lit(size)).alias("content"))


def pack_blocks(blocks: Column, limit: int, joint: str = "\n\n") -> Column:
    """Greedy packing of an array of blocks into texts of at most ``limit`` characters. A longer block first ends the text before it, and is then cut hard."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, b: Column) -> Column:
        closed = F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / limit).cast("int")), lambda i: F.substring(b, i * limit + 1, F.lit(limit)))
        both = F.length(a["open"]) + len(joint) + F.length(b)
        return (
            F.when(F.length(b) > limit, F.struct(F.concat(closed, cut).alias("done"), F.lit("").alias("open")))
            .when(a["open"] == "", F.struct(a["done"].alias("done"), b.alias("open")))
            .when(both <= limit, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(joint), b).alias("open")))
            .otherwise(F.struct(closed.alias("done"), b.alias("open")))
        )

    return F.aggregate(blocks, start, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def paragraph_chunks(docs: DataFrame, limit: int, mark: str = "\n", joint: str = "\n\n") -> DataFrame:
    """Paragraphs packed up to a limit: id, chunk, content."""
    blocks = F.filter(F.transform(F.split("content", mark), lambda t: F.trim(t)), lambda b: b != "")
    return docs.select("id", F.posexplode(pack_blocks(blocks, limit, joint)).alias("chunk", "content"))


def line_groups(docs: DataFrame, marker: str) -> DataFrame:
    """Lines grouped from each line that matches a marker to the next: id, part (0 before the first marker), first, lines, content."""
    rows = docs.select("id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    order = Window.partitionBy("id").orderBy("line")
    part = F.sum(F.col("text").rlike(marker).cast("int")).over(order)
    grouped = rows.withColumn("part", part).groupBy("id", "part").agg(F.min("line").alias("first"), F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return grouped.select("id", "part", "first", "lines", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("content"))


def sentences(docs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Three granularities: documents, sentences, and pairs of neighbouring sentences: id, kind, at, content, and whether a supporting fact (id, at: a sentence's place) lies in it."""
    parts = docs.select("id", F.posexplode(F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda s: s != "")).alias("at", "content"))
    no = F.lit(False)
    if facts is not None:
        named = facts.select("id", "at").distinct().withColumn("fact", F.lit(True))
        parts = parts.join(named, ["id", "at"], "left").select("id", "at", "content", F.coalesce("fact", no).alias("fact"))
    else:
        parts = parts.withColumn("fact", no)
    order = Window.partitionBy("id").orderBy("at")
    both = parts.withColumn("following", F.lead("content").over(order)).withColumn("fact", F.col("fact") | F.lead("fact").over(order)).where("following is not null")
    pairs = both.select("id", F.lit("sentence_pair").alias("kind"), "at", F.concat_ws(" ", "content", "following").alias("content"), "fact")
    any_fact = parts.groupBy("id").agg(F.bool_or("fact").alias("fact"))
    whole = docs.join(any_fact, "id", "left").select("id", F.lit("document").alias("kind"), F.lit(0).alias("at"), "content", F.coalesce("fact", no).alias("fact"))
    found = whole.unionByName(parts.select("id", F.lit("sentence").alias("kind"), "at", "content", "fact")).unionByName(pairs)
    return found.withColumnRenamed("fact", "is_supporting_fact")


def triples(units: DataFrame) -> DataFrame:
    """A stand-in for an extractor: of the first fifteen sentences of three words or more the first, second and last word (id, i, subject, predicate, object)."""
    parts = F.filter(F.transform(F.split("content", r"\."), lambda s: X.split_words(s)), lambda w: F.size(w) >= 3)
    rows = units.select("id", F.posexplode(F.slice(parts, 1, 15)).alias("i", "w"))
    return rows.select("id", "i", F.lower(F.col("w")[0]).alias("subject"), F.lower(F.col("w")[1]).alias("predicate"), F.lower(F.element_at("w", -1)).alias("object"))


def triple_units(units: DataFrame, triples: DataFrame) -> DataFrame:
    """A unit for each triple, and the raw unit where there is none: id (a hundred times the unit's, and the triple's number or 99), content."""
    made = triples.select((F.col("id") * 100 + F.col("i")).alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("content"))
    raw = units.join(triples.select("id").distinct(), "id", "left_anti").select((F.col("id") * 100 + 99).alias("id"), "content")
    return made.unionByName(raw)


def propositions(units: DataFrame, most: int = 10) -> DataFrame:
    """A stand-in for an extractor: a unit's first sentences between full stops, or all of it where there is none: id (a hundred times the unit's, and the number), content."""
    parts = F.slice(F.filter(F.transform(F.split("content", r"\."), lambda t: F.trim(t)), lambda t: t != ""), 1, most)
    kept = F.when(F.size(parts) > 0, parts).otherwise(F.array("content"))
    return units.select("id", F.posexplode(kept).alias("i", "content")).select((F.col("id") * 100 + F.col("i")).alias("id"), "content")


def entities(units: DataFrame) -> DataFrame:
    """Distinct (id, entity): capitalised words of three letters or more that start no sentence, without marks, in lower case."""
    words = X.split_words(F.col("content"))
    picked = F.filter(
        F.transform(
            F.filter(F.zip_with(words, F.concat(F.array(F.lit(".")), words), lambda w, before: F.struct(w.alias("w"), before.alias("before"))), lambda p: p["w"].isNotNull()),
            lambda p: F.when((F.length(p["w"]) > 2) & p["w"].rlike(r"^\p{Lu}") & p["w"].rlike(r"\p{Ll}") & ~p["before"].rlike("[.!?]$"), F.lower(F.btrim(p["w"], F.lit(".,;:!?\"'()")))),
        ),
        lambda e: e.isNotNull(),
    )
    return units.select("id", F.explode(F.array_distinct(picked)).alias("entity"))


def concept_graph(tagged: DataFrame, least: int) -> DataFrame:
    """concept, number of units and their ids in order, for concepts (id, concept) of ``least`` units or more."""
    rows = tagged.select("id", F.lower(F.trim("concept")).alias("concept")).where("concept <> ''").distinct()
    return rows.groupBy("concept").agg(F.count("*").alias("units"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.col("units") >= least)


def running_state(rows: DataFrame, every: int, limit: int = 4000) -> DataFrame:
    """A rolling state (key, seq, content) of bounded size, told at every n-th row of a key and at its last: key, seq, n, state.

    The state is the last ``limit`` characters of the texts so far, carried from row to row, so the work is in proportion to
    a key's rows.
    """
    ordered = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))).alias("rows"))
    kind = f"array<struct<seq:{rows.schema['seq'].dataType.simpleString()},n:int,state:string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("state"), F.array().cast(kind).alias("told"))

    def step(a: Column, r: Column) -> Column:
        n = a["n"] + 1
        state = F.right(F.when(n == 1, r["content"]).otherwise(F.concat(a["state"], F.lit("\n"), r["content"])), F.lit(limit))
        told = F.struct(r["seq"].alias("seq"), n.alias("n"), state.alias("state"))
        return F.struct(n.alias("n"), state.alias("state"), F.when((n % every == 0) | (n == F.size("rows")), F.concat(a["told"], F.array(told))).otherwise(a["told"]).alias("told"))

    return ordered.select("key", F.explode(F.aggregate("rows", start, step, lambda a: a["told"])).alias("t")).select("key", "t.seq", "t.n", "t.state")


def state_graph(rows: DataFrame) -> DataFrame:
    """Edges from each row (key, seq, name, state) to the one before it with the same name: ``causal`` where the state changed, else ``temporal``."""
    order = Window.partitionBy("key", "name").orderBy("seq")
    before = rows.withColumn("source", F.lag("seq").over(order)).withColumn("was", F.lag("state").over(order)).where("source is not null")
    return before.select("key", "name", "source", F.col("seq").alias("target"), F.when(F.col("was").eqNullSafe(F.col("state")), "temporal").otherwise("causal").alias("kind"))


def compacted(rows: DataFrame, keep: int, limit: int) -> DataFrame:
    """The last ``keep`` rows of a key (key, seq, content) stay; older ones become one line cut to a limit."""
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    line = F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, limit)
    return rows.withColumn("is_compacted", at > keep).select("key", "seq", "is_compacted", F.when(F.col("is_compacted"), line).otherwise(F.col("content")).alias("content"))


def transitions(rows: DataFrame, action: str = "user", answer: str = "assistant") -> DataFrame:
    """Each action paired with the row after it where that is an answer: key, seq, action, observation."""
    order = Window.partitionBy("key").orderBy("seq")
    both = rows.withColumn("observation", F.lead("content").over(order)).withColumn("next", F.lead("role").over(order))
    return both.where((F.col("role") == action) & (F.col("next") == answer)).select("key", "seq", F.col("content").alias("action"), "observation")
