"""Retrievers over units (id, content) and queries (query_id, query).

BM25 searches a stored index (``inverted``). Sums over a query's terms are taken in one pass over the texts (``tally``); other lexical ones
join query terms with postings on the term, so work follows the matches. Ones that must look at every text
take the queries as a broadcast side only where Spark's own size check allows it; the queries are a stated, small set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import inverted, late, tally
from quarry.operators import vectors as cells
from quarry.operators.ranking import keep_best, standard_score, top
from quarry.sources.shared import spool


def query_terms(queries: DataFrame, tokens: Column, distinct: bool = False) -> DataFrame:
    """query_id, term and how often the query has it."""
    n = F.lit(1) if distinct else F.count("*")
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(n.alias("times"))


def okapi(index: inverted.Index, floor: float = 0.25) -> Column:
    """A term's weight from its df: a negative idf becomes ``floor`` times the mean idf of all terms."""
    idf = F.log(F.lit(float(index.units)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = index.dictionary.agg(F.avg(idf)).first()[0] or 0.0  # one number
    return F.when(idf < 0, floor * mean).otherwise(idf)


def bm25(units: DataFrame, queries: DataFrame, k: int, unit_tokens: Column, tokens: Column, fill: bool = True, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Okapi BM25 with a floor for common terms, over a new index. ``fill``: units without a match score 0."""
    return bm25_search(inverted.build(units, unit_tokens), units.select("id"), queries, k, tokens, fill, k1, b, floor)


def bm25_search(index: inverted.Index, ids: DataFrame, queries: DataFrame, k: int, tokens: Column, fill: bool = True, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Okapi BM25 over a stored index of units (ids: their id). A list is filled up with the first ids that don't match: of the first k ids those that match are scored too, so what is left of them is known."""
    asked = query_terms(queries, tokens)
    first = [r["id"] for r in ids.select("id").distinct().orderBy("id").limit(k).collect()] if fill else []  # k numbers
    scored = inverted.search(index, asked, k, okapi(index, floor), first, k1, b)
    if not fill:
        return top(scored.where("score > 0"), k, ["query_id"])
    scored = spool(scored, "scored")  # read twice
    zeros = queries.select("query_id", F.explode(F.array(*map(F.lit, first)) if first else F.expr("array()").cast("array<long>")).alias("id"))
    none = zeros.join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(scored.unionByName(none), k, ["query_id"])


def _filled(scored: DataFrame, matches, units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query; units without a match score 0. Only the first k ids can be needed to fill a list up, and only these are asked (``matches``) whether they match."""
    first = units.select("id").orderBy("id").limit(k)
    zeros = queries.select("query_id").join(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows
    known = matches(units.join(F.broadcast(first), "id", "left_semi")).select("query_id", "id").distinct()
    return top(scored.unionByName(zeros.join(known, ["query_id", "id"], "left_anti")), k, ["query_id"])


def _low(units: DataFrame) -> DataFrame:
    return units.select("id", F.lower("content").alias("low"))


def _grams(word: Column) -> Column:
    """Distinct substrings of one to three characters."""
    n = F.length(word)
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))
    return F.array_distinct(F.concat(cut(1), cut(2), cut(3)))


def _inside(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """(run, terms): for runs of a vocabulary (run) the words (term) that they hold.

    A word is looked up by one of its longest grams (three characters, or the whole word where it is shorter), of those the
    one that fewest words have; so runs and words meet on equal grams, never as all pairs.
    """
    wanted = words.select("term").where("term <> ''").distinct()
    width = F.least(F.length("term"), F.lit(3))
    keys = wanted.select("term", F.explode(F.filter(_grams(F.col("term")), lambda g: F.length(g) == width)).alias("gram"))
    rare = keys.join(keys.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    held = vocabulary.select("run", F.explode(_grams(F.col("run"))).alias("gram")).join(rare, "gram").where("contains(run, term)")
    return held.groupBy("run").agg(F.collect_list("term").alias("terms"))


def holding(units: DataFrame, words: DataFrame, runs: Column | None = None) -> DataFrame:
    """(term, id): units whose text holds a word (term) as a substring.

    A word lies within one run of the text (by default of letters and digits, of which the words then consist), so it is
    looked for in the vocabulary of runs, not in the texts. A unit's words are gathered in one row.
    """
    found = X.words(F.col("content")) if runs is None else runs
    posted = units.select("id", F.explode(F.array_distinct(found)).alias("run"))
    held = posted.join(_inside(posted.select("run").distinct(), words), "run").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return held.select(F.explode("terms").alias("term"), "id")


def containing(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): texts (id, low) that hold a whole query (query_id, q, not blank).

    Such a text holds the query's longest word between white space, so only texts that do are asked for the whole.
    """
    word = F.array_max(F.transform(X.split_words(F.col("q")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = queries.select("query_id", "q", word.alias("term"))
    held = holding(texts, asked, X.split_words(F.col("low"))).join(asked, "term")
    return held.join(texts.select("id", "low"), "id").where("contains(low, q)").select("query_id", "id")


def substring(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of the query's keywords that occur in the text, plus 0.3 if all of them occur as one phrase; other units at 0."""
    asked = queries.select("query_id", X.keywords(F.col("query")).alias("words")).where("size(words) > 0")
    terms = asked.select("query_id", F.size("words").alias("n"), F.array_join("words", " ").alias("phrase"), F.explode("words").alias("term")).groupBy("query_id", "n", "phrase", "term").agg(F.count("*").alias("times"))
    scored = tally.best(_low(units), terms, k, lambda n, times: times, inside=True, bonus=0.3).drop("rank")
    return _filled(scored, lambda some: holding(some, terms).join(terms, "term"), units, queries, k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """The k nearest vectors (id, vector) of each query (query_id, query), over a new index: by ``cosine`` with 0 for a null vector, or ``l2`` as 1 / (1 + squared distance)."""
    return cells.search(cells.build(vectors, measure), queries, k)


def near_seeds(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """Seeds of a graph walk: the k nearest vectors of a cosine at or above the threshold."""
    return dense(vectors, queries, k).where(F.col("score") >= threshold)


def max_similarity(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Late interaction: for each query vector the best of a document's vectors (id, vector), summed over the query's (query_id, part, query, and perhaps times)."""
    return late.search(late.build(vectors), vectors, queries, k)


def symbolic(entities: DataFrame, query_entities: DataFrame, k: int) -> DataFrame:
    """Share of a query's entities (query_id, entity) that a unit (id, entity) has."""
    sizes = query_entities.groupBy("query_id").agg(F.count("*").alias("asked"))
    hits = entities.join(query_entities, "entity").groupBy("query_id", "id").agg(F.count("*").alias("hits")).join(sizes, "query_id")
    return top(hits.select("query_id", "id", F.round(F.col("hits") / F.col("asked"), 6).alias("score")), k, ["query_id"])


def entity_graph(entities: DataFrame, query_entities: DataFrame, k: int) -> DataFrame:
    """One point for each query entity of a unit; units without one get half a point for each entity shared with those that have. Scaled by the best."""
    hop0 = entities.join(query_entities, "entity").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))
    reached = hop0.select("query_id", "id").join(entities, "id").select("query_id", "entity").distinct().join(query_entities, ["query_id", "entity"], "left_anti")
    hop1 = reached.join(entities, "entity").join(hop0.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg((0.5 * F.count("*")).alias("score"))
    both = hop0.unionByName(hop1)
    best = both.groupBy("query_id").agg(F.max("score").alias("best"))
    return top(both.join(best, "query_id").select("query_id", "id", F.round(F.col("score") / F.col("best"), 6).alias("score")), k, ["query_id"])


def episodic(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Summed idf of shared terms, 1.5 if the query occurs whole, 0.75 times coverage, 0.15 times recency; half a point for the speaker's name; feedback rows count 0.35.

    units: id, seq (0 for the oldest), total, content, speaker, source.
    """
    tokens = F.array_distinct(X.words(F.col("content"), "[a-z0-9_]+"))
    posted = units.select("id", F.explode(tokens).alias("term"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    low = F.trim(F.lower("query"))
    all_terms = F.array_distinct(X.words(F.col("query"), "[a-z0-9_]+"))
    kept = X.without(all_terms, X.EPISODIC_STOPWORDS)
    asked = queries.select("query_id", low.alias("q"), F.when(F.size(kept) > 0, kept).otherwise(all_terms).alias("terms")).where("size(terms) > 0 and q <> ''")
    total = units.agg(F.count("*").alias("n"))
    weights = asked.select("query_id", F.explode("terms").alias("term")).join(df, "term").join(F.broadcast(total)).withColumn("idf", F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)
    shared = posted.join(weights, "term").groupBy("query_id", "id").agg(F.sum("idf").alias("weight"), F.count("*").alias("overlap"))
    whole = containing(units.select("id", F.lower("content").alias("low")), asked).withColumn("bonus", F.lit(1.5))
    found = shared.join(whole, ["query_id", "id"], "full_outer").join(units.select("id", "seq", "total", "speaker", "source"), "id").join(asked.select("query_id", "terms"), "query_id")
    score = F.coalesce("weight", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)) + 0.75 * F.coalesce("overlap", F.lit(0)) / F.size("terms") + 0.15 * (F.col("seq") + 1) / F.col("total")
    score = score + F.when(F.array_contains("terms", F.lower(F.trim("speaker"))), 0.5).otherwise(0.0)
    score = score * F.when(F.col("source") == "qa_feedback", 0.35).otherwise(1.0)
    return top(found.select("query_id", "id", F.round(score, 6).alias("score")), k, ["query_id"])


def key_value(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """An equal key scores 3; else 1 and the shared words, and half a point where content or key hold the query. rows: id, key, content."""
    q = queries.select("query_id", F.trim(F.lower("query")).alias("q")).where("q <> ''")
    low = rows.select("id", F.lower("key").alias("key"), F.lower("content").alias("low"))
    return tally.keyed(low.withColumn("words", F.array_distinct(X.split_words(F.col("low")))), q.withColumn("words", X.split_words(F.col("q"))), k)


def recency_bonus(day: Column, as_of: Column) -> Column:
    """1 for a date as of today, falling to 0 over 3650 days; never for a date that can't be read."""
    days = F.greatest(F.datediff(as_of, day), F.lit(0))
    return F.coalesce(1.0 - F.least(days / 3650.0, F.lit(1.0)), F.lit(0.0))


def term_hits(rows: DataFrame, queries: DataFrame, k: int, as_of: str) -> DataFrame:
    """Shared terms, a point where the text holds the query (a blank one is held nowhere), and a recency bonus. rows: id, content, day."""
    posted = rows.select("id", F.explode(F.array_distinct(X.words(F.col("content"), "[a-z0-9_]+"))).alias("term"))
    asked = query_terms(queries, F.array_distinct(X.words(F.col("query"), "[a-z0-9_]+")), distinct=True)
    shared = posted.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("n"))
    q = queries.select("query_id", F.trim(F.lower("query")).alias("q")).where(F.size(X.split_words(F.col("q"))) > 0)
    whole = containing(rows.select("id", F.lower("content").alias("low")), q).withColumn("whole", F.lit(1))
    found = shared.join(whole, ["query_id", "id"], "full_outer").join(rows.select("id", "day"), "id")
    score = F.coalesce("n", F.lit(0)) + F.coalesce("whole", F.lit(0)) + recency_bonus(F.col("day"), F.to_date(F.lit(as_of)))
    return top(found.select("query_id", "id", F.round(score, 6).alias("score")), k, ["query_id"])


def count_ranker(units: DataFrame, queries: DataFrame, k: int, tokens: Column, part) -> DataFrame:
    """Sum over the query's terms of ``part(occurrences, times in the query)``, over numpy arrays, where a term occurs. Terms are of ASCII letters and digits."""
    return tally.best(_low(units), query_terms(queries, tokens), k, part, inside=True)


def term_sets(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k units that share most distinct terms with a query."""
    asked = query_terms(queries, F.array_distinct(X.words(F.col("query"))), distinct=True)
    return tally.best(_low(units), asked, k, lambda n, times: times)


def episodes(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Jaccard of terms, a quarter for the same type, 0.15 for success, less a thousandth of a point for each character over 2000.

    records: id, content, kind, success; queries also have a kind.
    """
    tokens = F.array_distinct(X.words(F.col("content")))
    sizes = records.select("id", F.size(tokens).alias("n"), "kind", "success", F.length("content").alias("length"))
    posted = records.select("id", F.explode(tokens).alias("term"))
    wanted = F.array_distinct(X.words(F.col("query")))
    asked = queries.select("query_id", F.explode(wanted).alias("term"))
    q = queries.select("query_id", F.size(wanted).alias("m"), F.col("kind").alias("asked"))
    shared = posted.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("both")).join(sizes, "id").join(q, "query_id")
    score = F.col("both") / (F.col("n") + F.col("m") - F.col("both")) + F.when(F.col("kind") == F.col("asked"), 0.25).otherwise(0.0) + F.when(F.col("success"), 0.15).otherwise(0.0) - 0.001 * F.greatest(F.lit(0), F.col("length") - 2000)
    return top(shared.select("query_id", "id", F.round(score, 6).alias("score")), k, ["query_id"])


def two_phase(candidates: DataFrame, k: int, threshold: float = 0.0, q_floor: float | None = None, q_least: float | None = None, unknown: float | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Value-aware choice among recalled candidates (query_id, id, similarity, q): gates, z-scores within the query, weighted sum."""
    from pyspark.sql import Window

    c = candidates.where(F.col("similarity") >= threshold)
    if q_floor is not None:
        c = c.withColumn("q", F.greatest("q", F.lit(q_floor)))
    if q_least is not None:
        c = c.where(F.col("q") >= q_least)
    group = Window.partitionBy("query_id")
    if unknown is not None:
        c = c.withColumn("best", F.max("similarity").over(group)).where(F.col("best") >= unknown).drop("best")
    fused = weights[0] * standard_score(F.col("similarity"), group) + weights[1] * standard_score(F.col("q"), group)
    ranked = c.withColumn("score", F.round(fused, 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("q").desc(), F.col("similarity").desc(), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def catalogue(dense_hits: DataFrame, lexical_hits: DataFrame, recent: DataFrame) -> DataFrame:
    """Union of three candidate lists; an id keeps its best score, the recent ones have 0.99."""
    rows = dense_hits.select("query_id", "id", "score").unionByName(lexical_hits.select("query_id", "id", "score")).unionByName(recent.select("query_id", "id", F.lit(0.99).alias("score")))
    return rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def prefixed(hits: DataFrame, units: DataFrame, k: int, length: int = 200) -> DataFrame:
    """Hits of several paths, one for each beginning of the content."""
    rows = hits.join(units.select("id", F.substring("content", 1, length).alias("head")), "id")
    return top(keep_best(rows, ["query_id", "head"], F.col("score").desc(), F.col("id")), k, ["query_id"])
