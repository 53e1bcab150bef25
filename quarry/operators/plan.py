"""Planned search: a validated plan lowered to DataFrames, regex search over records, set operations on matches, and graph templates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.ranking import top
from quarry.sources.shared import spool


def safe_pattern(pattern: str | None) -> str:
    """A case-insensitive pattern; one that doesn't compile is taken literally, an empty one never matches."""
    pattern = (pattern or "").strip()
    if not pattern:
        return r"(?!)"
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return f"(?i){pattern}"


@dataclass(frozen=True)
class SearchPlan:
    """What a planner asks for, cut to its limits: 8 queries, 6 filters, 4 set operations of 3 arguments, 4 graph queries."""

    queries: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    read_ids: list[int] = field(default_factory=list)
    set_operations: list[tuple[str, list[str]]] = field(default_factory=list)
    graph_queries: list[tuple[str, dict]] = field(default_factory=list)
    top_k: int = 8
    use_dump: bool = False

    @classmethod
    def of(cls, raw: dict) -> SearchPlan:
        words = lambda v: [str(x) for x in v if str(x).strip()] if isinstance(v, list) else []
        k = int(raw.get("top_k", 8))
        operations = [(o["op"], words(o.get("args"))[:3]) for o in raw.get("aggregate_ops") or [] if isinstance(o, dict) and o.get("op")]
        graph = [(g["template"], dict(g.get("args") or {})) for g in raw.get("graph_queries") or [] if isinstance(g, dict) and g.get("template") in TEMPLATES]
        return cls(list(dict.fromkeys(words(raw.get("queries"))))[:8], words(raw.get("filters"))[:6], list(raw.get("read_ids") or [])[:k], operations[:4], graph[:4], k, bool(raw.get("use_dump")))


def matching_lines(content: Column, pattern: str, limit: int = 5) -> Column:
    """The first lines that match, each with its number and cut to 500 characters."""
    numbered = F.transform(F.split(content, "\n"), lambda t, i: F.struct((i + 1).alias("n"), F.substring(t, 1, 500).alias("t"), t.rlike(pattern).alias("hit")))
    return F.slice(F.transform(F.filter(numbered, lambda x: x["hit"]), lambda x: F.concat(x["n"].cast("string"), F.lit(": "), x["t"])), 1, limit)


def grep_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(X.without(X.words(text, "[a-z0-9][a-z0-9_'/-]+"), X.GREP_STOPWORDS), lambda t: F.length(t) > 2))


#: A query that names a turn or step, as text or as a pattern.
ANCHOR = re.compile(r"(?i)(turn|step)(\\s\+|\s+)\d+(\\s\*|\s*):")


def execute(records: DataFrame, plan: SearchPlan, question: str, queries: list[str] | None = None) -> DataFrame:
    """id, score and matched lines of the best records (id, content, and perhaps title): shared terms, 0.15 for each matched line, 2 more for a turn's anchor.

    Filters hold on the matched lines, or on the whole text without any; a record keeps its best score over the queries
    (``queries``, or the plan's). Ids to read come in at 1. Without any hit the question itself ranks all records.
    """
    asked = [(q, bool(ANCHOR.search(q))) for q in (plan.queries if queries is None else queries)]
    named = F.concat_ws(" ", "title", "content") if "title" in records.columns else F.col("content")
    # A record's terms are taken once; each query is a few literals in the same pass.
    rows = records.select("id", "content", grep_terms(named).alias("terms"))
    none = F.array().cast("array<string>")
    overlap = lambda text: (lambda w: F.size(F.array_intersect(w, "terms")) / F.greatest(F.size(w), F.lit(1)))(grep_terms(F.lit(text)))
    hits = []
    for query, anchor in asked:
        found = matching_lines(F.col("content"), safe_pattern(query))
        score = overlap(f"{query} {question}") + 0.15 * F.size(found)
        if anchor:
            score = F.when(F.size(found) > 0, score + 2.0).otherwise(0.0)
        elif plan.filters:
            hay = F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(F.col("content"))
            for f in plan.filters:
                score = F.when(hay.rlike(safe_pattern(f)), score).otherwise(0.0)
        hits.append(F.struct(score.alias("score"), found.alias("matches")))
    best = F.sort_array(F.array(*hits), asc=False)[0] if hits else F.struct(F.lit(0.0).alias("score"), none.alias("matches"))
    scored = rows.select("id", best.alias("best")).select("id", "best.score", "best.matches")
    if plan.read_ids:
        read = (F.col("score") <= 0) & F.col("id").isin(plan.read_ids)
        scored = scored.withColumn("matches", F.when(read, none).otherwise(F.col("matches"))).withColumn("score", F.when(read, 1.0).otherwise(F.col("score")))
    best_of = lambda df: top(df.withColumn("score", F.round("score", 4)).withColumn("query_id", F.lit(0)), plan.top_k, ["query_id"]).drop("query_id")
    kept = best_of(scored.where("score > 0"))
    instead = best_of(rows.select("id", overlap(question).alias("score"), none.alias("matches")))
    count = kept.agg(F.count("*").alias("_n"))  # one row
    return kept.unionByName(instead.join(F.broadcast(count)).where("_n = 0").drop("_n"))


def match_sets(records: DataFrame, patterns: list[str]) -> DataFrame:
    """id and which of the patterns match (an array of their numbers)."""
    hit = F.filter(F.array(*(F.when(F.col("content").rlike(safe_pattern(p)), F.lit(i)) for i, p in enumerate(patterns))), lambda x: x.isNotNull())
    return records.select("id", hit.alias("hits")).where("size(hits) > 0")


def set_operation(records: DataFrame, op: str, patterns: list[str]) -> DataFrame:
    """Ids that match all patterns (``intersect``) or any (``union``), or as ``count`` how many match the first."""
    sets = match_sets(records, patterns)
    if op == "intersect":
        return sets.where(F.size("hits") == len(patterns)).select("id")
    if op == "union":
        return sets.select("id")
    return sets.agg(F.count_if(F.array_contains("hits", 0)).alias("n"))


DATE = r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})"


def temporal_order(records: DataFrame) -> DataFrame:
    """Records with a date in their first 400 characters, or else in their title, ordered by the date as it is written: id, date, rank."""
    from pyspark.sql import Window

    date = F.nullif(F.regexp_extract(F.substring("content", 1, 400), DATE, 1), F.lit(""))
    if "title" in records.columns:
        date = F.coalesce(date, F.nullif(F.regexp_extract("title", DATE, 1), F.lit("")))
    dated = records.select("id", date.alias("date")).where("date is not null")
    # Ranks of one ordered list: dates are few, so they are counted and numbered, not the rows.
    days = dated.groupBy("date").agg(F.count("*").alias("n"))
    first = days.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("date").orderBy("id"))
    return dated.withColumn("_in", inside).join(first.select("date", "first"), "date").select("id", "date", (F.col("first") + F.col("_in")).alias("rank"))


def grep_corpus(corpus: DataFrame, pattern: str, limit: int = 10, before: int = 80, after: int = 200) -> DataFrame:
    """The first records (seq, title, body) whose title or body match, with the text around the match."""
    p = safe_pattern(pattern)
    at = F.regexp_instr("body", F.lit(p))
    snippet = F.when(at > 0, F.substring("body", F.greatest(F.lit(1), at - before), F.least(at - 1, F.lit(before)) + after)).otherwise(F.substring("body", 1, after))
    return corpus.where(F.col("title").rlike(p) | F.col("body").rlike(p)).select("seq", "title", snippet.alias("snippet")).orderBy("seq").limit(limit)


def read_title(corpus: DataFrame, titles: DataFrame) -> DataFrame:
    """Records by title: as written, else without regard to case and outer spaces."""
    exact = titles.join(corpus.select("title", "seq"), "title", "inner").select("title", "seq")
    rest = titles.join(exact.select("title"), "title", "left_anti").select(F.col("title").alias("asked"), F.lower(F.trim("title")).alias("key"))
    loose = rest.join(corpus.select("seq", F.lower(F.trim("title")).alias("key")), "key").groupBy("asked").agg(F.min("seq").alias("seq")).withColumnRenamed("asked", "title")
    return exact.unionByName(loose)


def recent_grep(journal: DataFrame, query: str, k: int) -> DataFrame:
    """The latest k entries (seq, content) that hold the query; of all where it is empty."""
    hit = F.contains(F.lower("content"), F.lit(query.strip().lower())) if query.strip() else F.lit(True)
    return journal.where(hit).orderBy(F.desc("seq")).limit(max(1, k))


def find_steps(steps: DataFrame, mode: str, value: str) -> DataFrame:
    """Steps (key, seq, action, observation) that hold a ``keyword``, match a ``regex``, have an ``action`` with it, or name an ``entity`` as written."""
    whole = F.concat_ws("\n", "action", "observation")
    test = {"keyword": F.contains(F.lower(whole), F.lit(value.lower())), "regex": whole.rlike(safe_pattern(value)), "action": F.contains(F.lower("action"), F.lit(value.lower())), "entity": F.contains(whole, F.lit(value))}[mode]
    return steps.where(test)


def neighbours(hits: DataFrame, rows: DataFrame, radius: int) -> DataFrame:
    """Rows (key, pos) within a radius of a hit by position. Each hit names the places around it, so the join is on equal keys."""
    near = hits.select("key", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos")).distinct()
    return rows.join(near, ["key", "pos"])


def nearest(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn nearest to each edge (key, edge, at) among a key's turns (key, pos), the earlier of two: looked up on both sides by window, without pairs."""
    from pyspark.sql import Window

    both = edges.select("key", F.col("at"), F.col("edge"), F.lit(None).cast("long").alias("pos")).unionByName(turns.select("key", F.col("pos").alias("at"), F.lit(None).cast("long").alias("edge"), F.col("pos").cast("long").alias("pos")))
    order = Window.partitionBy("key").orderBy("at")
    told = both.withColumn("low", F.last("pos", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first("pos", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("high").isNull() | (F.col("at") - F.col("low") <= F.col("high") - F.col("at")), F.col("low")).otherwise(F.col("high"))
    return told.where("edge is not null").select("key", "edge", "at", near.alias("nearest"))


# Graph templates over turns (ns, vid, speaker, text, ftime).


def speaker_mentions(g: DataFrame, speaker: str, keyword: str) -> DataFrame:
    return g.where((F.col("speaker") == speaker) & F.contains(F.lower("text"), F.lit(keyword.lower()))).orderBy("ftime", "ns", "vid").limit(10)


def keyword_search(g: DataFrame, keyword: str) -> DataFrame:
    return g.where(F.contains(F.lower("text"), F.lit(keyword.lower()))).orderBy("ftime", "ns", "vid").limit(10)


def follow_chain(g: DataFrame, vid: int, n: int) -> DataFrame:
    """The one to ten turns after a turn of each namespace."""
    return g.where(F.col("vid").between(vid + 1, vid + min(max(n, 1), 10)))


def speakers(g: DataFrame) -> DataFrame:
    return g.groupBy("ns", "speaker").agg(F.count("*").alias("turns"))


def first_last(g: DataFrame, speaker: str) -> DataFrame:
    return g.where(F.col("speaker") == speaker).groupBy("ns").agg(F.min_by("vid", "ftime").alias("first"), F.max_by("vid", "ftime").alias("last"))


def between_dates(g: DataFrame, start: str, end: str) -> DataFrame:
    return g.where(F.col("ftime").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy("ftime", "ns", "vid").limit(15)


TEMPLATES = {f.__name__: f for f in (speaker_mentions, keyword_search, follow_chain, speakers, first_last, between_dates)}
# Fixed value: what a graph query must not say.
WRITES = r"(?i)\b(?:CREATE|DELETE|DETACH|MERGE|SET|REMOVE|DROP|CALL|LOAD\s+CSV)\b"


def read_only(query: Column) -> Column:
    """Whether a graph query's text only reads: it matches or returns, and changes nothing."""
    said = F.trim(F.coalesce(query, F.lit("")))
    return (said != "") & ~said.rlike(WRITES) & said.rlike("(?i)MATCH|RETURN")


# Iterative graph work: frontiers and ranks live in DataFrames; only a count or a sum comes to the driver.


def multi_hop(concepts: DataFrame, seeds: DataFrame, hops: int, k: int | None = None) -> DataFrame:
    """query_id, id and 1 / (hop + 1) at an id's first reach, from seed concepts (query_id, concept) over (concept, id).

    With ``k`` the k best of a query, ties by the lower id. A query that isn't done has less than k ids, so the first 2k ids of a
    concept hold all that can be among the k best, and only queries whose concepts have fewer go on from all of theirs.
    """
    if k is not None:
        return _best_hops(concepts, seeds, hops, k)
    frontier, visited, found = seeds.select("query_id", "concept").distinct(), None, None
    for hop in range(hops):
        reached = frontier.join(concepts, "concept").select("query_id", "id").distinct().withColumn("hop", F.lit(hop))
        found = reached if found is None else found.unionByName(reached)
        visited = frontier if visited is None else visited.unionByName(frontier)
        frontier = reached.join(concepts, "id").select("query_id", "concept").distinct().join(visited, ["query_id", "concept"], "left_anti")
    return found.groupBy("query_id", "id").agg(F.round(1 / (F.min("hop") + 1), 6).alias("score"))


def _best_hops(concepts: DataFrame, seeds: DataFrame, hops: int, k: int) -> DataFrame:
    from pyspark.sql import Window

    frontier, visited, found = spool(seeds.select("query_id", "concept").distinct(), "frontier"), None, None
    by_id = F.dense_rank().over(Window.partitionBy("concept").orderBy("id"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "id"))
    for hop in range(hops):
        lists = concepts.join(frontier.select("concept").distinct(), "concept", "left_semi").withColumn("at", by_id).where(F.col("at") <= 2 * k)
        reached = frontier.join(lists, "concept").select("query_id", "id").distinct()
        fresh = (reached if found is None else reached.join(found, ["query_id", "id"], "left_anti")).withColumn("hop", F.lit(hop))
        found = spool((fresh if found is None else found.unionByName(fresh)).withColumn("at", best).where(F.col("at") <= k).drop("at"), "hops")
        if hop + 1 < hops:
            visited = frontier if visited is None else visited.unionByName(frontier)
            going = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < k).select("query_id")
            ends = found.where(F.col("hop") == hop).join(going, "query_id").select("query_id", "id")  # less than k of a query
            frontier = spool(ends.join(concepts, "id").select("query_id", "concept").distinct().join(visited, ["query_id", "concept"], "left_anti"), "frontier")
    return found.select("query_id", "id", F.round(1 / (F.col("hop") + 1), 6).alias("score"))


def bounded_expand(adjacency: DataFrame, seeds: DataFrame, details: DataFrame, most: int) -> DataFrame:
    """Nodes by breadth first from each query's seeds: query_id, node, place (from 1).

    adjacency: node, pos, neighbour; seeds: query_id, pos, node (distinct in a query); details: query_id, detail, whose
    largest number, 1 to 3, is the depth. A node comes at its first reach, in the order of the nodes that reach it and of
    their neighbours. The seeds beyond ``most`` lead on but don't come themselves; a list ends at ``most`` nodes, or with
    one found beyond the seeds where these are as many.
    """
    from pyspark.sql import Window

    numbers = F.array_max(F.transform(F.regexp_extract_all("detail", F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("double")))
    depth = F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(numbers, F.lit(1.0)))).cast("int")
    order = Window.partitionBy("query_id").orderBy("pos")
    level = seeds.withColumn("place", F.row_number().over(order)).join(details.select("query_id", depth.alias("depth")), "query_id")
    level = level.select("query_id", "node", "place", "depth")
    found = level.where(F.col("place") <= most)
    for step in range(1, 4):
        reached = level.where(F.col("depth") >= step).join(adjacency, "node").groupBy("query_id", F.col("neighbour").alias("node"), "depth").agg(F.min(F.struct("place", "pos")).alias("first"))
        fresh = reached.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti")
        held = found.groupBy("query_id").agg(F.count("*").alias("held"))
        at = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
        level = fresh.withColumn("at", at).join(held, "query_id").where((F.col("held") + F.col("at") <= most) | (F.col("at") == 1) & (F.col("held") == most) & F.lit(step == 1)).select("query_id", "node", (F.col("held") + F.col("at")).cast("int").alias("place"), "depth")
        found = found.unionByName(level)
    return found.select("query_id", "node", "place")


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 20, store=None, tolerance: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(node, rank): personalised rank over weighted edges (src, dst, weight) from equally weighted seeds (node); what reaches a node without edges is lost.

    ``by``: columns of the seeds that tell several ranks apart, such as a query's id. ``store``: a function that cuts
    lineage, called every five rounds (a checkpoint, or a function that writes a table and reads it). With ``tolerance`` the
    rounds end when the ranks change by less in all; each round's ranks are then stored.
    """
    store, keys = store or (lambda df: spool(df, "rounds")), [*by, "node"]
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    step = store(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    seeds = seeds.select(*keys).distinct()
    count = seeds.groupBy(*by).agg(F.count("*").alias("n"))
    start = store((seeds.join(count, list(by)) if by else seeds.join(F.broadcast(count))).select(*keys, (1.0 / F.col("n")).alias("start")))  # without keys one row
    rank = start.select(*keys, F.col("start").alias("rank"))
    zero = F.lit(0.0)
    for i in range(rounds):
        before = rank
        moved = rank.join(step, F.col("node") == F.col("src")).groupBy(*by, F.col("dst").alias("node")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("moved"))
        rank = moved.join(start, keys, "full_outer").select(*keys, (F.coalesce("moved", zero) + (1 - damping) * F.coalesce("start", zero)).alias("rank"))
        if tolerance is not None:
            rank = store(rank)
            both = rank.join(before.withColumnRenamed("rank", "was"), keys, "full_outer")
            changed = both.groupBy(*by).agg(F.sum(F.abs(F.coalesce("rank", zero) - F.coalesce("was", zero))).alias("change"))
            if (changed.agg(F.max("change")).first()[0] or 0.0) < tolerance:
                break
        elif i % 5 == 4:
            rank = store(rank)
    return rank
