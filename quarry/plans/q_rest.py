"""The last of the queries: passages, extraction stand-ins, decomposition, formats and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import answers, text as X
from quarry.operators import chunking, ranking, retrieval, windows
from quarry.plans import adapt, q_eval
from quarry.plans.adapt import Q, T, U, WORDS

K = 10


def i09(spark, sf):
    """Passages of three turns."""
    t = adapt.turns(spark, sf)
    rows = t.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("passage")).agg(F.sort_array(F.collect_list(F.struct("turn", "content"))).alias("rows"))
    return rows.select("conv_id", "passage", F.md5(F.array_join(F.transform("rows", lambda r: r["content"]), "\n")).alias("digest"))


def i10(spark, sf):
    """Lines packed to experiences of at most 6000 characters."""
    return chunking.paragraph_chunks(adapt.units(spark, sf), 6000, joint="\n").select("id", "chunk", F.length("content").cast("long").alias("chars"))


def i19(spark, sf):
    return chunking.triples(adapt.units(spark, sf))


def i20(spark, sf):
    """Edges between entities of the triples, with how many texts they have."""
    return chunking.triples(adapt.units(spark, sf)).groupBy("subject", "object").agg(F.count_distinct("id").alias("texts"), F.count("*").alias("edges"))


def w14(spark, sf):
    """Quotas for each language, as equal as what there is allows."""
    return windows.water_filled(adapt.units(spark, sf).select("id", "lang"), "lang", "id", 62).select("id", "lang")


def a25(spark, sf):
    return adapt.units(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("records"))


def r22(spark, sf):
    """Label segments against a label: coverage, twice the whole label, a fifth for each neighbouring pair of words; admitted by coverage or the whole."""
    p = adapt.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("low"))
    q = adapt.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.lower("p_type").alias("label"))
    hits = p.join(q.select("label").distinct()).withColumn("w", X.words(F.col("label")))  # parts of equal labels get equal lists
    coverage = F.size(F.filter("w", lambda t: F.contains(F.col("low"), t))) / F.greatest(F.size("w"), F.lit(1))
    pairs = F.size(F.filter(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)), lambda b: b.isNotNull() & F.contains(F.col("low"), b)))
    whole = F.contains("low", "label")
    scored = hits.withColumn("coverage", coverage).where((F.col("coverage") >= 0.6) | whole).select("label", "id", F.round(F.col("coverage") + F.when(whole, 2.0).otherwise(0.0) + 0.2 * pairs, 6).alias("score"))
    return ranking.top(scored, K, ["label"]).join(q, "label").select("query_id", "id", "score", "rank")


def r27(spark, sf):
    """Groups of five turns scored 0 to 10 (stand-in: occurrences of a word), best first, without zeros."""
    t = adapt.turns(spark, sf)
    n = X.occurrences(F.lower("content"), F.lit("the"))
    g = t.groupBy(F.col("conv_id").alias("query_id"), F.floor(F.col("turn") / 5).alias("id")).agg(F.least(F.lit(10), F.sum(n)).cast("double").alias("score"))
    return ranking.top(g.where("score > 0"), 3, ["query_id"])


def f05(spark, sf):
    """A query in two halves, each retrieved, the best score of an id kept."""
    q = adapt.questions(spark, sf)
    words = F.split("query", " ")
    n = F.floor((F.size(words) + 1) / 2).cast("int")
    half = lambda a: q.select("query_id", F.array_join(F.slice(words, a, n), " ").alias("query"))
    u = adapt.units(spark, sf)
    return ranking.union_best([retrieval.term_sets(u, half(F.lit(1)), K), retrieval.term_sets(u, half(n + 1), K)], K, ["query_id"])


def f06(spark, sf):
    """Retrieval widened round by round until a query has three hits of eight terms or more; then the first ten."""
    u, left, done = adapt.units(spark, sf), adapt.questions(spark, sf), None
    for size in (K, 2 * K, 3 * K):
        hits = retrieval.term_sets(u, left, size)
        enough = hits.where("score >= 8").groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 3").select("query_id")
        found = (hits.join(enough, "query_id", "left_semi") if size < 3 * K else hits).where(F.col("rank") <= K)
        done = found if done is None else done.unionByName(found)
        left = left.join(enough, "query_id", "left_anti")
    return done.select("query_id", "id", "score", "rank")


def x25(spark, sf):
    t = adapt.turns(spark, sf)
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("content"))
    return t.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda r: r["l"]), "\n\n")).alias("context"))


def x31(spark, sf):
    return adapt.questions(spark, sf).select("query_id", F.md5(X.normalise_spaced(F.col("query"))).alias("key"))


QUERIES = {
    "I09_turn_passages": i09,
    "I10_I07_experiences": i10,
    "I19_I17_U06_triples": i19,
    "I20_entity_edges": i20,
    "W14_quota_fill": w14,
    "A25_store_counts": a25,
    "R22_label_segments": r22,
    "R27_group_scores": r27,
    "F05_decomposition": f05,
    "F06_sufficiency_rounds": f06,
    "X25_numbered_context": x25,
    "X31_plan_key": x31,
}

_TRI = "w AS (SELECT id, list_filter(list_transform(string_split(content,'.'), lambda s: list_filter(regexp_split_to_array(s,'[\\s\\p{Z}]+'), lambda x: x<>'')), lambda w: len(w)>=3)[1:15] AS p FROM u), x AS (SELECT id, (generate_subscripts(p,1)-1)::INT AS i, unnest(p) AS w FROM w), tr AS (SELECT id, i, lower(w[1]) AS subject, lower(w[2]) AS predicate, lower(w[len(w)]) AS object FROM x)"
_HALF = f"h AS (SELECT query_id, 1 AS part, array_to_string((string_split(query,' '))[1:(len(string_split(query,' '))+1)//2],' ') AS query FROM q UNION ALL SELECT query_id, 2, array_to_string((string_split(query,' '))[(len(string_split(query,' '))+1)//2+1:],' ') FROM q), ut AS (SELECT DISTINCT id, unnest({WORDS.format('content')}) AS term FROM u), ht AS (SELECT DISTINCT query_id, part, unnest({WORDS.format('query')}) AS term FROM h)"
ORACLE = {
    "W14_quota_fill": f"WITH {U}, r AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY id) AS round FROM u) SELECT id, lang FROM r ORDER BY round, lang LIMIT 62",
    "I09_turn_passages": f"WITH {T} SELECT conv_id, (turn//3)::BIGINT AS passage, md5(string_agg(content, chr(10) ORDER BY turn)) AS digest FROM t GROUP BY ALL",
    "I19_I17_U06_triples": f"WITH {U}, {_TRI} SELECT * FROM tr",
    "I20_entity_edges": f"WITH {U}, {_TRI} SELECT subject, object, count(DISTINCT id) AS texts, count(*) AS edges FROM tr GROUP BY ALL",
    "A25_store_counts": f"WITH {U} SELECT source, lang, count(*) AS records FROM u GROUP BY ALL",
    "R22_label_segments": f"WITH p AS (SELECT p_partkey AS id, lower(p_name||' '||p_brand||' '||p_type) AS low FROM part), l AS (SELECT p_partkey AS query_id, lower(p_type) AS label, {WORDS.format('p_type')} AS w FROM part WHERE p_partkey%50=0), c AS (SELECT *, len(list_filter(w, lambda t: contains(low,t)))::DOUBLE/greatest(len(w),1) AS c, contains(low,label) AS whole, len(list_filter(range(1,len(w)), lambda i: contains(low, w[i]||' '||w[i+1]))) AS b FROM p, l), sc AS (SELECT query_id, id, round(c+CASE WHEN whole THEN 2 ELSE 0 END+0.2::DOUBLE*b,6) AS score FROM c WHERE c>=0.6 OR whole) {adapt.top('sc', K)}",
    "R27_group_scores": f"WITH {T}, sc AS (SELECT conv_id AS query_id, (turn//5)::BIGINT AS id, least(10, sum((length(content)-length(replace(lower(content),'the','')))//3))::DOUBLE AS score FROM t GROUP BY ALL HAVING score>0) {adapt.top('sc', 3)}",
    "F05_decomposition": f"WITH {U}, {Q}, {_HALF}, s0 AS (SELECT query_id, part, id, count(*)::DOUBLE AS score FROM ut JOIN ht USING (term) GROUP BY ALL), s1 AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id) AS r FROM s0) WHERE r<={K}), sc AS (SELECT query_id, id, max(score) AS score FROM s1 GROUP BY ALL) {adapt.top('sc', K)}",
    "F06_sufficiency_rounds": f"WITH {U}, {Q}, ut AS (SELECT DISTINCT id, unnest({WORDS.format('content')}) AS term FROM u), qt AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS term FROM q), sc AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM ut JOIN qt USING (term) GROUP BY ALL) {adapt.top('sc', K)}",
    "X25_numbered_context": f"WITH {T} SELECT conv_id, md5(string_agg('['||(turn+1)||'] '||role||': '||content, chr(10)||chr(10) ORDER BY turn)) AS context FROM t GROUP BY 1",
    "X31_plan_key": f"WITH {Q} SELECT query_id, md5({q_eval._v2('query')}) AS key FROM q",
}
