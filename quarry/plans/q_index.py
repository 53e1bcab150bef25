"""Queries of index builders and of window-shaped computations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunking, ranking, windows
from quarry.plans import adapt
from quarry.plans.adapt import S, T, U


def _digest(df, *keys):
    """Long contents as digests, so that results stay small."""
    return df.select(*keys, F.md5("content").alias("digest"), F.length("content").cast("long").alias("chars"))


def i01(spark, sf):
    return _digest(adapt.units(spark, sf), "id", "lang", "source")


def i02(spark, sf):
    return _digest(chunking.token_chunks(adapt.units(spark, sf), 512, 64), "id", "chunk", "start", "end")


def i03(spark, sf):
    return _digest(chunking.token_chunks(adapt.units(spark, sf), 128, 32, stop_early=True), "id", "chunk", "start", "end")


def i04(spark, sf):
    return _digest(chunking.character_chunks(adapt.units(spark, sf), 2000, 200), "id", "chunk")


def i05(spark, sf):
    return _digest(chunking.paragraph_chunks(adapt.units(spark, sf), 600), "id", "chunk")


def i08(spark, sf):
    return _digest(chunking.line_groups(adapt.units(spark, sf), "^[A-Z][a-z]+[ ,.]"), "id", "part", "first", "lines")


def i15(spark, sf):
    """One supporting fact for each text: a sentence by its place, which may lie beyond the text."""
    u = adapt.units(spark, sf)
    return _digest(chunking.sentences(u, u.select("id", (F.col("id") % 5).cast("int").alias("at"))), "id", "kind", "at", "is_supporting_fact")


def i18(spark, sf):
    words = adapt.units(spark, sf).select("id", F.explode(F.array_distinct(X.words(F.col("content")))).alias("concept"))
    return chunking.concept_graph(words, 3)


def i21(spark, sf):
    t = adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "content")
    return chunking.running_state(t, 3).select("key", "seq", "n", F.md5("state").alias("digest"))


def i23(spark, sf):
    return chunking.entities(adapt.units(spark, sf)).groupBy("entity").agg(F.count("*").alias("units"), F.min("id").alias("first"))


def i25(spark, sf):
    e = adapt.steps(spark, sf).select("key", "seq", F.col("event_type").alias("name"), F.round("value").alias("state"))
    return chunking.state_graph(e)


def i26(spark, sf):
    """Whether a turn's text differs from the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return adapt.turns(spark, sf).withColumn("was", F.lag("content").over(w)).select("conv_id", "turn", (~F.col("was").eqNullSafe(F.col("content"))).alias("changed"))


def i29(spark, sf):
    t = adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "content")
    return _digest(chunking.compacted(t, 3, 700), "key", "seq", "is_compacted")


def i33(spark, sf):
    t = adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "role", "content")
    return chunking.transitions(t).select("key", "seq", F.md5("action").alias("action"), F.md5("observation").alias("observation"))


def i34(spark, sf):
    """Pieces of long messages, labelled with their number and how many there are."""
    parts = chunking.character_chunks(adapt.units(spark, sf), 1000, 0)
    n = F.count("*").over(Window.partitionBy("id"))
    return parts.withColumn("n", n).select("id", "chunk", F.md5(F.concat(F.format_string("[chunk %d/%d] ", F.col("chunk") + 1, F.col("n")), "content")).alias("digest"))


def i35(spark, sf):
    return adapt.units(spark, sf).groupBy(F.pmod("id", F.lit(16)).alias("shard")).agg(F.count("*").alias("units"), F.sum(F.length("content")).alias("chars"))


def w02(spark, sf):
    return windows.recency(adapt.steps(spark, sf).select("key", "seq", "event_id")).select("key", "seq", F.round("weight", 9).alias("weight"), F.round("score", 9).alias("score"))


def w04(spark, sf):
    return windows.length_quartile(adapt.units(spark, sf).select("id", "lang", F.length("content").alias("length")), "lang").select("id", "lang", "quartile")


def w08(spark, sf):
    w = Window.partitionBy("key").orderBy("seq")
    return adapt.steps(spark, sf).select("key", "seq", F.lag("event_type").over(w).alias("previous"), F.lead("event_type").over(w).alias("following"))


def w10(spark, sf):
    return windows.last_rows(adapt.steps(spark, sf), 5).select("key", "seq", "event_type")


def w11(spark, sf):
    return windows.spread(adapt.steps(spark, sf), 4).select("key", "seq", "event_type")


def w12(spark, sf):
    t = adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.length("content").alias("cost"))
    return windows.budget(t, 1500)


def w13(spark, sf):
    rows = adapt.units(spark, sf).select("id", F.col("lang").alias("label"), F.col("source").alias("grp"), F.length("content").cast("double").alias("score"))
    return windows.label_bank(rows, 2, 20)


def w15(spark, sf):
    rows = adapt.units(spark, sf).select("id", F.col("source").alias("stratum"), F.length("content").alias("length"))
    return windows.round_robin(rows, 60)


def w16(spark, sf):
    return windows.quota(adapt.units(spark, sf).select("id", "lang"), "lang", "id", 25)


def w17(spark, sf):
    return ranking.keep_best(adapt.steps(spark, sf), ["key", "event_type"], F.col("value").desc(), F.col("event_id")).select("key", "event_type", "event_id", F.round("value", 6).alias("value"))


def w18(spark, sf):
    rows = adapt.steps(spark, sf).select("key", "seq", F.when(F.col("seq") % 4 != 3, F.date_format("ts", "yyyy-MM-dd HH")).alias("stamp"))
    return windows.sessions_by_change(rows)


def w19(spark, sf):
    return windows.tumbling(adapt.steps(spark, sf), 12).groupBy("key", "window").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def w20(spark, sf):
    t = adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.length("content").alias("cost"))
    return windows.trim_history(t, 4, 1200)


QUERIES = {
    "I01_I24_plain_units": i01,
    "I02_token_chunks": i02,
    "I03_token_chunks_early_stop": i03,
    "I04_character_chunks": i04,
    "I05_I06_paragraph_packer": i05,
    "I08_I07_I13_line_groups": i08,
    "I15_W09_sentence_granularities": i15,
    "I18_concept_graph": i18,
    "I21_T10_state_snapshots": i21,
    "I22_I23_entity_bridge": i23,
    "I25_J13_state_graph": i25,
    "I26_change_report": i26,
    "I29_compaction": i29,
    "I33_transition_pairs": i33,
    "I34_labelled_pieces": i34,
    "I35_round_robin_shards": i35,
    "W02_W03_recency": w02,
    "W04_length_quartiles": w04,
    "W08_previous_and_next": w08,
    "W10_T02_last_rows": w10,
    "W11_even_spread": w11,
    "W12_budget_pack": w12,
    "W13_label_bank": w13,
    "W15_round_robin_strata": w15,
    "W16_quota": w16,
    "W17_keep_best": w17,
    "W18_sessions_by_change": w18,
    "W19_tumbling_rows": w19,
    "W20_history_trim": w20,
}

_D = "md5(content) AS digest, length(content) AS chars"
_UW = "w AS (SELECT id, list_filter(regexp_split_to_array(content,'[\\s\\p{Z}]+'), lambda x: x <> '') AS words FROM u)"


def _chunks(size: int, step: int, keep: str = "true") -> str:
    return f"""WITH {U}, {_UW}, c AS (SELECT id, words, unnest(range(0, greatest(len(words),1), {step})) AS start FROM w), k AS (SELECT * FROM c WHERE {keep}),
    r AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start)-1)::INT AS chunk, start::INT AS start, least(start+{size}, len(words))::INT AS "end", array_to_string(words[start+1:start+{size}],' ') AS content FROM k)
    SELECT id, chunk, start, "end", {_D} FROM r"""


_LEAST = "CASE WHEN count(*) OVER w > 1 THEN seq::DOUBLE/greatest(count(*) OVER w - 1,1) ELSE 0 END"
ORACLE = {
    "I01_I24_plain_units": f"WITH {U} SELECT id, lang, source, {_D} FROM u",
    "I02_token_chunks": _chunks(512, 448),
    "I03_token_chunks_early_stop": _chunks(128, 96, "start = 0 OR start - 96 + 128 < len(words)"),
    "I04_character_chunks": f"WITH {U}, c AS (SELECT id, content, unnest(range(0, length(content), 1800)) AS start FROM u WHERE content <> ''), r AS (SELECT id, (start//1800)::INT AS chunk, substr(content, start+1, 2000) AS content FROM c) SELECT id, chunk, {_D} FROM r",
    "I08_I07_I13_line_groups": f"""WITH {U}, l AS (SELECT id, unnest(string_split(content,chr(10))) AS text, generate_subscripts(string_split(content,chr(10)),1)-1 AS line FROM u),
    p AS (SELECT *, sum(CASE WHEN regexp_matches(text,'^[A-Z][a-z]+[ ,.]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS part FROM l),
    r AS (SELECT id, part::BIGINT AS part, min(line)::INT AS first, count(*) AS lines, string_agg(text, chr(10) ORDER BY line) AS content FROM p GROUP BY id, part) SELECT id, part, first, lines, {_D} FROM r""",
    "I15_W09_sentence_granularities": f"""WITH {U}, s AS (SELECT id, content, list_filter(string_split(regexp_replace(content,'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)), lambda x: x<>'') AS p FROM u), x AS (SELECT id, p, unnest(range(0,len(p))) AS nth FROM s),
    r AS (SELECT id, 'document' AS kind, 0 AS nth, content, len(p)>id%5 AS f FROM s UNION ALL SELECT id, 'sentence', nth, p[nth+1], nth=id%5 FROM x UNION ALL SELECT id, 'sentence_pair', nth, p[nth+1]||' '||p[nth+2], nth=id%5 OR nth+1=id%5 FROM x WHERE nth+1<len(p)) SELECT id, kind, nth::INT AS "at", f AS is_supporting_fact, {_D} FROM r""",
    "I18_concept_graph": f"WITH {U}, c AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content),'[a-z0-9]+')) AS concept FROM u) SELECT concept, count(*) AS units, list(id ORDER BY id) AS ids FROM c GROUP BY 1 HAVING count(*)>=3",
    "I21_T10_state_snapshots": f"WITH {T}, r AS (SELECT conv_id AS key, turn AS seq, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS last, right(string_agg(content, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 4000) AS state FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT key, seq, n::INT AS n, md5(state) AS digest FROM r WHERE n%3=0 OR n=last",
    "I22_I23_entity_bridge": f"""WITH {U}, {_UW}, e AS (SELECT DISTINCT id, lower(trim(x, '.,;:!?"''()')) AS entity FROM (SELECT id, unnest(list_filter(list_transform(range(2, len(words)+1), lambda i: CASE WHEN length(words[i])>2 AND regexp_matches(words[i],'^\\p{{Lu}}') AND regexp_matches(words[i],'\\p{{Ll}}') AND NOT regexp_matches(words[i-1],'[.!?]$') THEN words[i] END), lambda x: x IS NOT NULL)) AS x FROM w))
    SELECT entity, count(*) AS units, min(id) AS first FROM e GROUP BY 1""",
    "I25_J13_state_graph": f"WITH {S}, r AS (SELECT key, seq, event_type AS name, round(value) AS state, lag(seq) OVER w AS source, lag(round(value)) OVER w AS was FROM s WINDOW w AS (PARTITION BY user_key, event_type ORDER BY seq)) SELECT key, name, source::INT AS source, seq::INT AS target, CASE WHEN was IS NOT DISTINCT FROM state THEN 'temporal' ELSE 'causal' END AS kind FROM r WHERE source IS NOT NULL".replace("user_key", "key"),
    "I26_change_report": f"WITH {T} SELECT conv_id, turn, lag(content) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM content AS changed FROM t",
    "I29_compaction": f"WITH {T}, r AS (SELECT conv_id AS key, turn AS seq, content AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 AS is_compacted FROM t), x AS (SELECT key, seq, is_compacted, CASE WHEN is_compacted THEN substr(trim(regexp_replace(c,'\\s+',' ','g')),1,700) ELSE c END AS content FROM r) SELECT key, seq, is_compacted, {_D} FROM x",
    "I33_transition_pairs": f"WITH {T}, r AS (SELECT conv_id AS key, turn AS seq, role, content, lead(content) OVER w AS o, lead(role) OVER w AS nr FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT key, seq, md5(content) AS action, md5(o) AS observation FROM r WHERE role='user' AND nr='assistant'",
    "I34_labelled_pieces": f"WITH {U}, c AS (SELECT id, content, unnest(range(0, length(content), 1000)) AS start FROM u WHERE content <> ''), r AS (SELECT id, (start//1000)::INT AS chunk, substr(content, start+1, 1000) AS content, count(*) OVER (PARTITION BY id) AS n FROM c) SELECT id, chunk, md5(format('[chunk {{}}/{{}}] ', chunk+1, n) || content) AS digest FROM r",
    "I35_round_robin_shards": f"WITH {U} SELECT id%16 AS shard, count(*) AS units, sum(length(content))::BIGINT AS chars FROM u GROUP BY 1",
    "W02_W03_recency": f"WITH {S} SELECT key, seq::INT AS seq, round((seq+1)::DOUBLE/count(*) OVER w,9) AS weight, round({_LEAST},9) AS score FROM s WINDOW w AS (PARTITION BY key)",
    "W04_length_quartiles": f"WITH {U} SELECT id, lang, least(3, floor((row_number() OVER (PARTITION BY lang ORDER BY length(content), id)-1)*4/count(*) OVER (PARTITION BY lang)))::INT AS quartile FROM u",
    "W08_previous_and_next": f"WITH {S} SELECT key, seq::INT AS seq, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS following FROM s WINDOW w AS (PARTITION BY key ORDER BY seq)",
    "W10_T02_last_rows": f"WITH {S} SELECT key, seq::INT AS seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM s) WHERE r<=5",
    "W11_even_spread": f"WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM s), k AS (SELECT DISTINCT key, unnest(CASE WHEN n<=4 THEN range(0,n) ELSE list_transform(range(0,4), lambda i: round_even(i*(n-1)/3.0, 0)::BIGINT) END) AS seq FROM n) SELECT key, seq::INT AS seq, event_type FROM n JOIN k USING (key, seq)",
    "W12_budget_pack": f"WITH {T}, r AS (SELECT conv_id AS key, turn AS seq, length(content) AS cost, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t) SELECT key, seq, cost::INT AS cost, spent::BIGINT AS spent FROM r WHERE spent<=1500 OR n=1",
    "W13_label_bank": f"WITH {U}, r AS (SELECT id, lang AS label, source AS grp, length(content)::DOUBLE AS score FROM u), a AS (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY score DESC, id) AS m, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS k FROM r) SELECT grp, id, label, score FROM a WHERE m<=2 OR k<=20",
    "W15_round_robin_strata": f"WITH {U}, r AS (SELECT id, source AS stratum, row_number() OVER (PARTITION BY source ORDER BY length(content), id)-1 AS round FROM u) SELECT id, stratum, round::INT AS round FROM r ORDER BY round, stratum, id LIMIT 60",
    "W16_quota": f"WITH {U} SELECT id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS r FROM u) WHERE r<=25",
    "W17_keep_best": f"WITH {S} SELECT key, event_type, event_id, round(value,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key, event_type ORDER BY value DESC, event_id) AS r FROM s) WHERE r=1",
    "W18_sessions_by_change": f"""WITH {S}, r AS (SELECT key, seq, CASE WHEN seq%4<>3 THEN strftime(ts,'%Y-%m-%d %H') END AS stamp FROM s), f AS (SELECT key, seq, last_value(stamp IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stamp FROM r),
    c AS (SELECT *, CASE WHEN stamp IS DISTINCT FROM lag(stamp) OVER (PARTITION BY key ORDER BY seq) THEN 1 ELSE 0 END AS new FROM f), g AS (SELECT key, seq, greatest(1, sum(new) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS session FROM c)
    SELECT key, seq::INT AS seq, session::BIGINT AS session, row_number() OVER (PARTITION BY key, session ORDER BY seq)::INT AS turn FROM g""",
    "W19_tumbling_rows": f'WITH {S} SELECT key, (seq//12)::BIGINT AS "window", count(*) AS n, round(sum(value),4) AS value FROM s GROUP BY ALL',
    "W20_history_trim": f"""WITH {T}, r AS (SELECT conv_id AS key, turn AS seq, length(content) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t),
    k AS (SELECT *, sum(cost) OVER (PARTITION BY key ORDER BY (n=1) DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS held FROM r WHERE n=1 OR back<=4) SELECT key, seq, cost::INT AS cost FROM k WHERE n=1 OR held<=1200""",
}
