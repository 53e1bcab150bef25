"""Queries of retrieval and fusion over the supplied tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import ranking, retrieval
from quarry.plans import adapt
from quarry.plans.adapt import Q, S, U, UWORDS, WORDS, stopped, top

K = 10


def _bm25_tokens(c: str):
    return X.terms(F.col(c), X.BM25_STOPWORDS)


def _white_tokens(c: str):
    found = X.split_words(F.lower(c))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def r01(spark, sf):
    return retrieval.bm25(adapt.units(spark, sf), adapt.questions(spark, sf), K, _bm25_tokens("content"), _bm25_tokens("query"))


def r02(spark, sf):
    return retrieval.bm25(adapt.units(spark, sf), adapt.questions(spark, sf), K, _white_tokens("content"), _white_tokens("query"))


def r03(spark, sf):
    return retrieval.bm25(adapt.units(spark, sf), adapt.questions(spark, sf), K, X.terms(F.col("content")), X.terms(F.col("query")), fill=False)


def r04(spark, sf):
    return retrieval.substring(adapt.units(spark, sf), adapt.questions(spark, sf), K)


def r05(spark, sf):
    return retrieval.dense(*adapt.vectors(spark, sf), K)


def r06(spark, sf):
    return retrieval.dense(*adapt.vectors(spark, sf), K, "l2")


def _multi(spark, sf):
    v, _ = adapt.vectors(spark, sf)
    docs = v.select(F.floor(F.col("id") / 10).alias("id"), F.col("id").alias("vec"), "vector")
    return docs.drop("vec"), docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("part"), F.col("vector").alias("query"))


def r07(spark, sf):
    return retrieval.max_similarity(*_multi(spark, sf), K)


def _entities(spark, sf):
    """Capitalised words within sentences, in lower case, as entities."""
    from quarry.operators.chunking import entities

    return entities(adapt.units(spark, sf)), _asked(spark, sf)


def _asked(spark, sf):
    words = F.transform(F.filter(X.split_words(F.col("query")), lambda w: F.length(w) > 2), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))))
    return adapt.questions(spark, sf).select("query_id", F.explode(F.array_distinct(words)).alias("entity"))


def r08(spark, sf):
    return retrieval.symbolic(*_entities(spark, sf), K)


def r09(spark, sf):
    return retrieval.entity_graph(*_entities(spark, sf), K)


def _memory(spark, sf):
    t = adapt.turns(spark, sf)
    n = t.count()
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("seq"), F.lit(n).alias("total"), "content", F.col("role").alias("speaker"), F.when(F.col("turn") % 7 == 6, "qa_feedback").otherwise("chat").alias("source"))


def r15(spark, sf):
    return retrieval.episodic(_memory(spark, sf), adapt.questions(spark, sf), K)


def r16(spark, sf):
    u = adapt.units(spark, sf).select("id", F.concat_ws("_", "source", "lang").alias("key"), "content")
    q = adapt.questions(spark, sf)
    extra = u.groupBy("key").agg(F.min("id").alias("query_id")).select((-1 - F.col("query_id")).alias("query_id"), F.col("key").alias("query"))
    return retrieval.key_value(u, q.unionByName(extra), K)


def r17(spark, sf):
    u = adapt.units(spark, sf).select("id", "content", F.date_sub(F.to_date(F.lit("2024-06-01")), (F.col("id") % 5000).cast("int")).alias("day"))
    return retrieval.term_hits(u, adapt.questions(spark, sf), K, "2024-06-01")


def r19(spark, sf):
    return retrieval.count_ranker(adapt.units(spark, sf), adapt.questions(spark, sf), K, F.array_distinct(X.keywords(F.col("query"))), lambda n, _: 1 + np.minimum(n, 5) / 5)


def r20(spark, sf):
    return retrieval.count_ranker(adapt.units(spark, sf), adapt.questions(spark, sf), K, X.keywords(F.col("query")), lambda n, times: n * times)


def r21(spark, sf):
    return retrieval.count_ranker(adapt.units(spark, sf), adapt.questions(spark, sf), K, F.array_distinct(X.keywords(F.col("query"))), lambda n, _: 1 + n)


def r23(spark, sf, k=K):
    return retrieval.term_sets(adapt.units(spark, sf), adapt.questions(spark, sf), k)


def r24(spark, sf):
    u = adapt.units(spark, sf).select("id", "content", F.col("lang").alias("kind"), (F.col("id") % 3 == 0).alias("success"))
    return retrieval.episodes(u, adapt.questions(spark, sf).withColumn("kind", F.lit("en")), K)


def r25(spark, sf):
    recalled = r04(spark, sf).select("query_id", "id", F.col("score").alias("similarity"), (((F.col("id") * 37) % 100) / 100.0 - 0.3).alias("q"))
    return retrieval.two_phase(recalled, 5, threshold=0.05, q_floor=-0.2, q_least=-0.2, unknown=0.2).select("query_id", "id", "similarity", "q", "score", "rank")


def r35(spark, sf):
    u = adapt.units(spark, sf)
    recent = u.orderBy(F.desc("id")).limit(3)
    hits = retrieval.catalogue(r04(spark, sf), r23(spark, sf).withColumn("score", F.round(F.col("score") / 20, 6)), adapt.questions(spark, sf).select("query_id").join(F.broadcast(recent.select("id"))))  # three rows
    return ranking.top(hits, K, ["query_id"])


def f01(spark, sf):
    return ranking.reciprocal_rank_fusion([(r01(spark, sf), 0.5), (r04(spark, sf), 0.5)], K, ["query_id"])


def f02(spark, sf):
    return ranking.linear_fusion([(r01(spark, sf), 0.5), (r04(spark, sf), 0.5)], K, ["query_id"])


def f03(spark, sf):
    return ranking.union_best([r04(spark, sf), r23(spark, sf)], K, ["query_id"])


def f04(spark, sf):
    return retrieval.prefixed(r04(spark, sf).select("query_id", "id", "score").unionByName(r23(spark, sf).select("query_id", "id", "score")), adapt.units(spark, sf), K).select("query_id", "id", "score", "rank")


def p01(spark, sf):
    """Over-fetch, then filter: the predicate must not move below the first limit."""
    wide = r23(spark, sf, 3 * K).join(adapt.units(spark, sf).select("id", "lang"), "id")
    return ranking.top(wide.where("lang = 'en'").drop("rank"), K, ["query_id"]).select("query_id", "id", "score", "rank")


_BM = stopped(WORDS, X.BM25_STOPWORDS)


def _bm25_sql(tokens: str, fill: bool) -> str:
    un, qn = tokens.format("content"), tokens.format("query")
    zero = f"UNION ALL SELECT query_id, id, 0.0::DOUBLE FROM q, (SELECT id FROM u ORDER BY id LIMIT {K}) f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id=q.query_id AND m.id=f.id)" if fill else ""
    return f"""{U}, {Q}, tok AS (SELECT id, CASE WHEN len(t)=0 THEN [''] ELSE t END AS t FROM (SELECT id, {un} AS t FROM u)),
    post AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
    idf AS (SELECT term, ln(any_value(n)-count(*)+0.5)-ln(count(*)+0.5) AS raw FROM post, st GROUP BY term),
    idf2 AS (SELECT term, CASE WHEN raw<0 THEN 0.25*(SELECT avg(raw) FROM idf) ELSE raw END AS idf FROM idf),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(CASE WHEN len({qn})=0 THEN [''] ELSE {qn} END) AS term FROM q) GROUP BY ALL),
    m AS (SELECT query_id, id, round(sum(times*idf*tf*2.5/(tf+1.5*(0.25+0.75*len/mean))),6) AS score FROM post JOIN idf2 USING (term) JOIN qt USING (term), st GROUP BY ALL{'' if fill else ' HAVING score > 0'}),
    sc AS (SELECT * FROM m {zero})"""


_KW = f"list_filter({stopped(WORDS.format('query'), X.SUBSTRING_STOPWORDS)}, lambda x: length(x) >= 2)"
_R04 = f"""{U}, {Q}, kw AS (SELECT query_id, {_KW} AS words FROM q), low AS (SELECT id, lower(content) AS low FROM u),
    sc4 AS (SELECT query_id, id, round(CASE WHEN len(words)=0 THEN 0.0::DOUBLE ELSE len(list_filter(words, lambda w: contains(low, w)))::DOUBLE/len(words) + CASE WHEN contains(low, array_to_string(words,' ')) THEN 0.3 ELSE 0.0 END END,6) AS score FROM low, kw),
    r4 AS ({top('sc4', K)})"""
_VEC = "v AS (SELECT vec_id AS id, embedding AS vector FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0)"
_DOT = "list_sum(list_transform(range(1,65), lambda i: {0}[i]::DOUBLE*{1}[i]::DOUBLE))"
_ENT = """uw AS (SELECT id, list_filter(regexp_split_to_array(content,'[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM u),
    ent AS (SELECT DISTINCT id, lower(trim(x, '.,;:!?"''()')) AS entity FROM (SELECT id, unnest(list_filter(list_transform(range(2, len(w)+1), lambda i: CASE WHEN length(w[i])>2 AND regexp_matches(w[i],'^\\p{Lu}') AND regexp_matches(w[i],'\\p{Ll}') AND NOT regexp_matches(w[i-1],'[.!?]$') THEN w[i] END), lambda x: x IS NOT NULL)) AS x FROM uw)),
    qe AS (SELECT DISTINCT query_id, lower(trim(x, '.,;:!?"''()')) AS entity FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(query,'[\\s\\p{Z}]+'), lambda x: length(x) > 2)) AS x FROM q))"""
_R23 = f"""ut AS (SELECT DISTINCT id, unnest({WORDS.format('content')}) AS term FROM u), qtt AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS term FROM q),
    sc23 AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM ut JOIN qtt USING (term) GROUP BY ALL), r23 AS ({top('sc23', K)})"""
_OCC = "((length(low)-length(replace(low,term,'')))//length(term))"


def _counted(terms: str, part: str) -> str:
    return f"WITH {U}, {Q}, kt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms}) AS term FROM q) GROUP BY ALL), low AS (SELECT id, lower(content) AS low FROM u), sc AS (SELECT query_id, id, round(sum(({part})::DOUBLE),6) AS score FROM low JOIN kt ON contains(low, term) GROUP BY ALL) {top('sc', K)}"


QUERIES = {
    "R01_bm25": r01,
    "R02_bm25_whitespace": r02,
    "R03_J01_bm25_positive": r03,
    "R04_substring": r04,
    "R05_R26_J02_dense_cosine": r05,
    "R06_dense_l2": r06,
    "R07_max_similarity": r07,
    "R08_symbolic": r08,
    "R09_J10_W07_entity_graph": r09,
    "R15_episodic": r15,
    "R16_key_value": r16,
    "R17_term_hits_recency": r17,
    "R19_capped_count_ranker": r19,
    "R20_weighted_count_ranker": r20,
    "R21_count_ranker": r21,
    "R23_term_sets": r23,
    "R24_cross_episode": r24,
    "R25_W05_P13_two_phase": r25,
    "R35_catalogue_union": r35,
    "F01_W01_reciprocal_rank_fusion": f01,
    "F02_W06_linear_fusion": f02,
    "F03_set_union": f03,
    "F04_W17_prefix_dedup": f04,
    "P01_overfetch_filter": p01,
}

_WHITE = "list_filter(regexp_split_to_array(lower({0}),'[\\s\\p{{Z}}]+'), lambda x: x <> '')"
ORACLE = {
    "R01_bm25": f"WITH {_bm25_sql(_BM, True)} {top('sc', K)}",
    "R02_bm25_whitespace": f"WITH {_bm25_sql(_WHITE, True)} {top('sc', K)}",
    "R03_J01_bm25_positive": f"WITH {_bm25_sql(WORDS, False)} {top('sc', K)}",
    "R04_substring": f"WITH {_R04} SELECT * FROM r4",
    "R05_R26_J02_dense_cosine": f"WITH {_VEC}, sc AS (SELECT query_id, id, round({_DOT.format('query', 'vector')}/(sqrt({_DOT.format('query', 'query')})*sqrt({_DOT.format('vector', 'vector')})),6) AS score FROM v, vq) {top('sc', K)}",
    "R06_dense_l2": f"WITH {_VEC}, sc AS (SELECT query_id, id, round(1/(1+list_sum(list_transform(range(1,65), lambda i: (query[i]::DOUBLE-vector[i]::DOUBLE)*(query[i]::DOUBLE-vector[i]::DOUBLE)))),6) AS score FROM v, vq) {top('sc', K)}",
    "R07_max_similarity": f"WITH v AS (SELECT vec_id//10 AS id, vec_id AS part, embedding AS vector FROM embeddings), b AS (SELECT x.id AS query_id, x.part, v.id, max({_DOT.format('x.vector', 'v.vector')}) AS best FROM v, v x WHERE x.id % 50 = 0 GROUP BY ALL), sc AS (SELECT query_id, id, round(sum(best),5) AS score FROM b GROUP BY ALL) {top('sc', K)}",
    "R08_symbolic": f"WITH {U}, {Q}, {_ENT}, sc AS (SELECT query_id, id, round(count(*)::DOUBLE/any_value(n),6) AS score FROM ent JOIN qe USING (entity) JOIN (SELECT query_id, count(*) AS n FROM qe GROUP BY 1) USING (query_id) GROUP BY ALL) {top('sc', K)}",
    "R09_J10_W07_entity_graph": f"""WITH {U}, {Q}, {_ENT}, h0 AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM ent JOIN qe USING (entity) GROUP BY ALL),
    re AS (SELECT DISTINCT query_id, entity FROM h0 JOIN ent USING (id) WHERE (query_id, entity) NOT IN (SELECT query_id, entity FROM qe)),
    h1 AS (SELECT query_id, id, 0.5::DOUBLE*count(*) AS score FROM re JOIN ent USING (entity) WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE h0.query_id=re.query_id AND h0.id=ent.id) GROUP BY ALL),
    al AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1), sc AS (SELECT query_id, id, round(score/max(score) OVER (PARTITION BY query_id),6) AS score FROM al) {top('sc', K)}""",
    "R15_episodic": f"""WITH {Q}, m AS (SELECT conv_id*1000+turn AS id, turn AS seq, count(*) OVER () AS total, coalesce(text,'') AS content, role AS speaker, CASE WHEN turn%7=6 THEN 'qa_feedback' ELSE 'chat' END AS source FROM conversations),
    p AS (SELECT DISTINCT id, unnest({UWORDS.format('content')}) AS term FROM m), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    a AS (SELECT query_id, trim(lower(query)) AS q, list_distinct({UWORDS.format('query')}) AS t FROM q),
    a2 AS (SELECT query_id, q, CASE WHEN len({stopped('t', X.EPISODIC_STOPWORDS)})>0 THEN {stopped('t', X.EPISODIC_STOPWORDS)} ELSE t END AS terms FROM a WHERE len(t)>0 AND q<>''),
    w AS (SELECT query_id, term, ln((1.0::DOUBLE+(SELECT count(*) FROM m))/(1.0+df))+1 AS idf FROM (SELECT query_id, unnest(terms) AS term FROM a2) JOIN df USING (term)),
    sh AS (SELECT query_id, id, sum(idf) AS weight, count(*) AS overlap FROM p JOIN w USING (term) GROUP BY ALL),
    wh AS (SELECT query_id, id, 1.5::DOUBLE AS bonus FROM m JOIN a2 ON contains(lower(content), q)),
    f AS (SELECT query_id, id, weight, overlap, bonus FROM sh FULL JOIN wh USING (query_id, id)),
    sc AS (SELECT f.query_id, f.id, round((coalesce(weight,0)+coalesce(bonus,0)+0.75::DOUBLE*coalesce(overlap,0)/len(terms)+0.15::DOUBLE*(seq+1)/total+CASE WHEN list_contains(terms, lower(trim(speaker))) THEN 0.5 ELSE 0 END)*CASE WHEN source='qa_feedback' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END,6) AS score FROM f JOIN m USING (id) JOIN a2 USING (query_id)) {top('sc', K)}""",
    "R16_key_value": f"""WITH {U}, {Q}, r AS (SELECT id, lower(source||'_'||lang) AS key, lower(content) AS low FROM u), qq AS (SELECT query_id, trim(lower(query)) AS q FROM q UNION ALL SELECT -1-min(id), lower(source||'_'||lang) FROM u GROUP BY source, lang),
    x AS (SELECT query_id, id, q, key, len(list_intersect(list_filter(regexp_split_to_array(q,'[\\s\\p{{Z}}]+'), lambda z: z<>''), list_filter(regexp_split_to_array(low,'[\\s\\p{{Z}}]+'), lambda z: z<>''))) AS shared, contains(low,q) AS it, contains(key,q) AS ik FROM r, qq WHERE q<>''),
    sc AS (SELECT query_id, id, CASE WHEN q=key THEN 3.0::DOUBLE ELSE 1.0::DOUBLE+shared+CASE WHEN it THEN 0.5 ELSE 0 END+CASE WHEN ik THEN 0.5 ELSE 0 END END AS score FROM x WHERE q=key OR shared>0 OR it OR ik) {top('sc', K)}""",
    "R17_term_hits_recency": f"""WITH {U}, {Q}, p AS (SELECT DISTINCT id, unnest({UWORDS.format('content')}) AS term FROM u), a AS (SELECT DISTINCT query_id, unnest({UWORDS.format('query')}) AS term FROM q),
    sh AS (SELECT query_id, id, count(*) AS n FROM p JOIN a USING (term) GROUP BY ALL), wh AS (SELECT query_id, id, 1 AS whole FROM u JOIN q ON contains(lower(content), trim(lower(query)))),
    sc AS (SELECT query_id, id, round(coalesce(n,0)+coalesce(whole,0)+(1.0::DOUBLE-least((id%5000)/3650.0::DOUBLE,1.0::DOUBLE)),6) AS score FROM sh FULL JOIN wh USING (query_id, id)) {top('sc', K)}""",
    "R19_capped_count_ranker": _counted(f"list_distinct({_KW})", f"1+least({_OCC},5)/5.0::DOUBLE"),
    "R20_weighted_count_ranker": _counted(_KW, f"{_OCC}*times"),
    "R21_count_ranker": _counted(f"list_distinct({_KW})", f"1+{_OCC}"),
    "R23_term_sets": f"WITH {U}, {Q}, {_R23} SELECT * FROM r23",
    "R24_cross_episode": f"""WITH {U}, {Q}, uw AS (SELECT id, list_distinct({WORDS.format('content')}) AS w, lang, length(content) AS length FROM u), qw AS (SELECT query_id, list_distinct({WORDS.format('query')}) AS x FROM q),
    b AS (SELECT query_id, id, count(*) AS n_both FROM (SELECT id, unnest(w) AS term FROM uw) JOIN (SELECT query_id, unnest(x) AS term FROM qw) USING (term) GROUP BY ALL),
    sc AS (SELECT query_id, id, round(n_both::DOUBLE/(len(w)+len(x)-n_both)+CASE WHEN lang='en' THEN 0.25 ELSE 0 END+CASE WHEN id%3=0 THEN 0.15 ELSE 0 END-0.001::DOUBLE*greatest(0,length-2000),6) AS score FROM b JOIN uw USING (id) JOIN qw USING (query_id)) {top('sc', K)}""",
    "R25_W05_P13_two_phase": f"""WITH {_R04}, c AS (SELECT query_id, id, score AS similarity, greatest(((id*37)%100)/100.0::DOUBLE-0.3::DOUBLE, -0.2::DOUBLE) AS q FROM r4 WHERE score >= 0.05),
    c2 AS (SELECT * FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM c) WHERE best >= 0.2),
    z AS (SELECT query_id, id, similarity, q, similarity-avg(similarity) OVER w AS ds, q-avg(q) OVER w AS dq, stddev_pop(similarity) OVER w AS ss, stddev_pop(q) OVER w AS sq FROM c2 WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, id, similarity, q, round(0.5::DOUBLE*greatest(least(ds/CASE WHEN ss>1e-9 THEN ss ELSE 1 END,3.0::DOUBLE),-3.0::DOUBLE)+0.5::DOUBLE*greatest(least(dq/CASE WHEN sq>1e-9 THEN sq ELSE 1 END,3.0::DOUBLE),-3.0::DOUBLE),6) AS score FROM z)
    SELECT * FROM (SELECT query_id, id, similarity, q, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, q DESC, similarity DESC, id)::INT AS rank FROM f) WHERE rank <= 5""",
    "R35_catalogue_union": f"WITH {_R04}, {_R23}, x AS (SELECT query_id, id, score FROM r4 UNION ALL SELECT query_id, id, round(score/20,6) FROM r23 UNION ALL SELECT query_id, id, 0.99::DOUBLE FROM q, (SELECT id FROM u ORDER BY id DESC LIMIT 3)), sc AS (SELECT query_id, id, max(score) AS score FROM x GROUP BY ALL) {top('sc', K)}",
    "F01_W01_reciprocal_rank_fusion": f"WITH r1 AS (WITH {_bm25_sql(_BM, True)} {top('sc', K)}), {_R04}, x AS (SELECT query_id, id, 0.5::DOUBLE/(60+rank) AS p FROM r1 UNION ALL SELECT query_id, id, 0.5::DOUBLE/(60+rank) FROM r4), sc AS (SELECT query_id, id, round(sum(p),9) AS score FROM x GROUP BY ALL) {top('sc', K)}",
    "F02_W06_linear_fusion": f"WITH r1 AS (WITH {_bm25_sql(_BM, True)} {top('sc', K)}), {_R04}, n AS (SELECT query_id, id, score, 1 AS l FROM r1 UNION ALL SELECT query_id, id, score, 2 FROM r4), m AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN 0.5::DOUBLE*((score-min(score) OVER w)/(max(score) OVER w-min(score) OVER w)) ELSE 0 END AS p FROM n WINDOW w AS (PARTITION BY l, query_id)), sc AS (SELECT query_id, id, round(sum(p),9) AS score FROM m GROUP BY ALL) {top('sc', K)}",
    "F03_set_union": f"WITH {_R04}, {_R23}, x AS (SELECT query_id, id, score FROM r4 UNION ALL SELECT query_id, id, score FROM r23), sc AS (SELECT query_id, id, max(score) AS score FROM x GROUP BY ALL) {top('sc', K)}",
    "F04_W17_prefix_dedup": f"WITH {_R04}, {_R23}, x AS (SELECT query_id, id, score FROM r4 UNION ALL SELECT query_id, id, score FROM r23), d AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id, left(content,200) ORDER BY score DESC, id) AS pos FROM x JOIN u USING (id)), sc AS (SELECT query_id, id, score FROM d WHERE pos=1) {top('sc', K)}",
    "P01_overfetch_filter": f"WITH {U}, {Q}, {_R23}, w AS ({top('sc23', 3 * K)}), sc AS (SELECT query_id, w.id, score FROM w JOIN u ON u.id=w.id WHERE lang='en') {top('sc', K)}",
}
