"""Further queries: records, answers, small joins, tiers and named pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import answers, scores, text as X
from quarry.operators import ranking, records, retrieval
from quarry.plans import adapt, configs, q_eval, q_retrieval
from quarry.plans.adapt import Q, S, T, U, WORDS

K = 10


def i11(spark, sf):
    return adapt.units(spark, sf).select("id", F.posexplode(records.first_split(F.col("content"), [r"\n\n+", r" \| ", r"\n"])).alias("pos", "part")).select("id", "pos", F.md5("part").alias("digest"))


def i12(spark, sf):
    from quarry.operators.windows import last_rows

    return last_rows(adapt.units(spark, sf).select(F.col("source").alias("key"), F.col("id").alias("seq")), 5).select("key", "seq")


def i13(spark, sf):
    """Dialogues written as action and observation lines and parsed back."""
    t = adapt.turns(spark, sf)
    line = F.concat(F.when(F.col("turn") % 2 == 0, "Action: ").otherwise("Observation: "), F.regexp_replace("content", "\\s+", " "))
    docs = t.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return records.action_turns(docs).select("id", "turn", F.md5("action").alias("action"), F.md5("observation").alias("observation"))


def i14(spark, sf):
    docs = adapt.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.concat_ws(": ", "c_mktsegment", "c_name").alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return records.labelled_lines(docs, 10).groupBy("id", "label").agg(F.count("*").alias("n"), F.min("value").alias("first"))


def i30(spark, sf):
    t = adapt.turns(spark, sf).select(F.col("conv_id").alias("grp"), F.col("turn").cast("long").alias("seq"), "content")
    return records.rolled_up(t, 6, lambda c: F.substring(c, 1, 300)).select("grp", "level", "seq", F.md5("content").alias("digest"))


def i31(spark, sf):
    q = adapt.questions(spark, sf)
    n = q.select(F.explode(F.array_distinct(X.words(F.col("query")))).alias("name")).distinct().where("length(name) = 4")
    return records.expanded(q, n.select("name", F.reverse("name").alias("alias"))).select("query_id", F.md5("query").alias("digest"))


def j06(spark, sf):
    return records.missing_keys(adapt.table(spark, sf, "labels"), adapt.table(spark, sf, "documents").where("lang <> 'de'"), "doc_id")


def j11(spark, sf):
    e = adapt.steps(spark, sf)
    a = e.where("event_type = 'click'").select("key", F.col("event_id").alias("click"))
    b = e.where("event_type = 'view'").select("key", F.col("event_id").alias("view"))
    return records.zipped(a, b, "key", "click", "view")


def r12(spark, sf):
    v, q = adapt.vectors(spark, sf)
    return retrieval.near_seeds(v, q)


def r13(spark, sf):
    """A prefilter of fifty by BM25, then a list of ids (here: the even ones) scored by its order."""
    wide = retrieval.bm25(adapt.units(spark, sf), adapt.questions(spark, sf), 50, q_retrieval._bm25_tokens("content"), q_retrieval._bm25_tokens("query"))
    from pyspark.sql import Window

    listed = wide.where("id % 2 = 0").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return ranking.top(listed.select("query_id", "id", F.round(1 / (F.col("at") + 1), 6).alias("score")), K, ["query_id"])


def r31(spark, sf):
    p = adapt.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    q = adapt.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("query"))
    return retrieval.term_sets(p, q, K)


def r32(spark, sf):
    return adapt.table(spark, sf, "part").select("p_partkey", answers.synthetic_id(F.col("p_name")).alias("asin"))


def r33(spark, sf):
    docs = adapt.units(spark, sf).select("id", "content")
    days = spark.createDataFrame([(1, "the"), (2, "la"), (3, "und")], "day int, word string")
    kinds = spark.createDataFrame([("a", "of"), ("a", "in"), ("b", "de"), ("c", "be")], "slot string, word string")
    return records.slots(docs, days, kinds)


def r34(spark, sf):
    lists = (q_retrieval.r04(spark, sf), q_retrieval.r08(spark, sf), q_retrieval.r23(spark, sf))
    return records.tiers(*(x.select("query_id", "id", "score") for x in lists), 1.0)


def r36(spark, sf):
    return adapt.questions(spark, sf).select("query_id", answers.condensed(F.col("query"), 6).alias("query"))


def f07(spark, sf):
    """Candidates of several query variants: an id keeps its best fused score with that one's utility and similarity; ranked by all three."""
    utility = (F.col("id") * 37 % 100 / 100.0).alias("utility")
    a = q_retrieval.r04(spark, sf).select("query_id", "id", F.col("score").alias("fused"), utility, F.lit(0.5).alias("similarity"))
    b = q_retrieval.r23(spark, sf).select("query_id", "id", F.round(F.col("score") / 12, 6).alias("fused"), utility, F.round(F.col("score") / 20, 6).alias("similarity"))
    return ranking.merged_variants([a, b], K, ["query_id"])


def x03(spark, sf):
    p = q_eval._pairs(spark, sf).withColumn("a", X.answer_words(F.col("prediction"))).withColumn("b", X.answer_words(F.col("gold")))
    f1 = answers.closed_answer_f1(F.col("prediction"), F.col("gold"), scores.token_f1(F.col("a"), F.col("b")))
    return p.select("conv_id", "turn", F.round(f1, 6).alias("f1"), answers.contains_either(F.col("prediction"), F.col("gold")).alias("contains"), F.round(answers.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), answers.first_choice(F.col("prediction")).alias("choice"))


def x16(spark, sf):
    return adapt.units(spark, sf).select("id", F.md5(answers.last_line(F.col("content"))).alias("last_line"), F.md5(answers.bounded_read(F.col("content"), "(?i)moron|idiot")).alias("read"))


def x17(spark, sf):
    c = F.concat(F.lit("thoughts ###Answer: "), F.col("role"), F.lit(" said so\n### more"))
    return adapt.turns(spark, sf).select("conv_id", "turn", answers.marked_answer(c).alias("answer"))


def x26(spark, sf):
    e = adapt.table(spark, sf, "events")
    found = answers.json_object(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done")))
    return e.select("event_id", F.get_json_object(found, "$.k").try_cast("long").alias("k"))


def x30(spark, sf):
    from pyspark.sql import Window

    hits = q_retrieval.r23(spark, sf)
    w = Window.partitionBy("query_id").orderBy("rank")
    two = hits.withColumn("second", F.lead("score").over(w)).where("rank = 1").select("query_id", F.col("score").alias("best"), "second", "id")
    texts = adapt.units(spark, sf).select("id", F.array_distinct(X.words(F.col("content"))).alias("found"))
    q = adapt.questions(spark, sf).select("query_id", F.array_distinct(X.words(F.col("query"))).alias("wanted"))
    n = hits.groupBy("query_id").agg(F.count("*").alias("sources"))
    s = answers.sufficiency(F.col("wanted"), F.col("found"), F.col("best"), F.col("second"), F.col("sources"), 1.0)
    return two.join(texts, "id").join(q, "query_id").join(n, "query_id").select("query_id", s.alias("s")).select("query_id", "s.*")


def x33(spark, sf):
    commands = F.array(F.lit("click"), F.lit("View"), F.lit("purchase now"), F.lit("purchase"))
    said = F.concat(F.lit("I will "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, " now").otherwise(""))
    return adapt.table(spark, sf, "events").select("event_id", answers.picked_action(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(said), commands).alias("action"))


def p05(spark, sf):
    """All of several patterns, with a literal fallback."""
    from quarry.operators.plan import safe_pattern

    test = F.lit(True)
    for p in ("th", "a|e", "n"):
        test = test & F.col("content").rlike(safe_pattern(p))
    return adapt.units(spark, sf).where(test).select("id")


def s10(spark, sf):
    from quarry.sources.tables import evidence

    facts = F.transform(F.slice(X.split_words(F.col("content")), 1, 3), lambda w, i: F.struct(w.alias("title"), i.alias("sent_idx")))
    return adapt.units(spark, sf).select("id", evidence(facts).alias("evidence"))


def s18(spark, sf):
    """A seeded sample: the rows first by a hash of their id."""
    d = adapt.units(spark, sf).select("id", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))).alias("h"))
    return d.orderBy("h").limit(25).select("id")


def t08(spark, sf):
    """Values learned in a first phase, stored, and frozen for the second, which reads the store."""
    from quarry.sources.stores import shared_folder
    from quarry.streaming.sessions import utilities

    e, path = adapt.steps(spark, sf), shared_folder(spark, "utilities")
    utilities(e.where("seq < 40").select("key", "seq", "reward")).write.parquet(path)
    tested = e.where("seq >= 40").groupBy("key").agg(F.count("*").alias("tested"))
    return tested.join(spark.read.parquet(path).select("key", "q"), "key")


def u09(spark, sf):
    made = configs.build("C3")(adapt.units(spark, sf), adapt.questions(spark, sf), 5)
    return made.unionByName(configs.build("C5")(adapt.units(spark, sf), adapt.questions(spark, sf), 5))


QUERIES = {
    "I11_split_cascade": i11,
    "I12_last_records": i12,
    "I13_action_turns": i13,
    "I14_labelled_lines": i14,
    "I30_rolled_up": i30,
    "I31_alias_expansion": i31,
    "J06_missing_keys": j06,
    "J11_positional_zip": j11,
    "R12_seed_selection": r12,
    "R13_prefilter_then_list": r13,
    "R31_product_search": r31,
    "R32_synthetic_ids": r32,
    "R33_slots": r33,
    "R34_tiers": r34,
    "R36_condensed_query": r36,
    "F07_variant_merge": f07,
    "X03_X12_closed_answers": x03,
    "X16_X20_bounded_read": x16,
    "X17_answer_marker": x17,
    "X26_flat_json": x26,
    "X30_sufficiency": x30,
    "X33_picked_action": x33,
    "P05_all_patterns": p05,
    "S10_evidence": s10,
    "S18_seeded_sample": s18,
    "T08_two_phases": t08,
    "U09_C3_C5_pipelines": u09,
}

_R04 = q_retrieval._R04
_R23 = q_retrieval._R23
_SPL = "list_filter(list_transform(regexp_split_to_array(content,'{0}'), lambda x: trim(x)), lambda x: x<>'')"
ORACLE = {
    "I11_split_cascade": f"WITH {U}, s AS (SELECT id, CASE WHEN len({_SPL.format('\\n\\n+')})>1 THEN {_SPL.format('\\n\\n+')} WHEN len({_SPL.format(' \\| ')})>1 THEN {_SPL.format(' \\| ')} WHEN len({_SPL.format('\\n')})>1 THEN {_SPL.format('\\n')} ELSE [content] END AS p FROM u) SELECT id, (generate_subscripts(p,1)-1)::INT AS pos, md5(unnest(p)) AS digest FROM s",
    "I12_last_records": f"WITH {U} SELECT source AS key, id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS r FROM u) WHERE r<=5",
    "I13_action_turns": f"WITH {T}, x AS (SELECT conv_id AS id, turn, turn//2+1 AS n, trim(regexp_replace(content,'\\s+',' ','g')) AS c FROM t), g AS (SELECT id, sum(CASE WHEN turn%2=0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k, turn, c FROM x) SELECT id, k::BIGINT AS turn, md5(coalesce(string_agg(c, chr(10) ORDER BY turn) FILTER (turn%2=0),'')) AS action, md5(coalesce(string_agg(c, chr(10) ORDER BY turn) FILTER (turn%2=1),'')) AS observation FROM g WHERE k>0 GROUP BY id, k",
    "I14_labelled_lines": "WITH n AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*)>=10) SELECT c_nationkey AS id, c_mktsegment AS label, count(*) AS n, min(c_name) AS first FROM customer JOIN n USING (c_nationkey) GROUP BY ALL",
    "J06_missing_keys": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang<>'de')",
    "J11_positional_zip": f"WITH {S}, a AS (SELECT key, event_id AS click, row_number() OVER (PARTITION BY key ORDER BY event_id)-1 AS pos FROM s WHERE event_type='click'), b AS (SELECT key, event_id AS view, row_number() OVER (PARTITION BY key ORDER BY event_id)-1 AS pos FROM s WHERE event_type='view') SELECT key, pos::INT AS pos, click, view FROM a JOIN b USING (key, pos)",
    "R12_seed_selection": f"WITH {q_retrieval._VEC}, x AS (SELECT query_id, id, round({q_retrieval._DOT.format('query', 'vector')}/(sqrt({q_retrieval._DOT.format('query', 'query')})*sqrt({q_retrieval._DOT.format('vector', 'vector')})),6) AS score FROM v, vq), sc AS (SELECT * FROM x WHERE score>=0.5) {adapt.top('sc', K)}",
    "R13_prefilter_then_list": f"WITH r1 AS (WITH {q_retrieval._bm25_sql(q_retrieval._BM, True).replace(f'LIMIT {q_retrieval.K}', 'LIMIT 50')} {adapt.top('sc', 50)}), sc AS (SELECT query_id, id, round(1.0::DOUBLE/(row_number() OVER (PARTITION BY query_id ORDER BY rank)+1),6) AS score FROM r1 WHERE id%2=0) {adapt.top('sc', K)}",
    "R31_product_search": f"WITH p AS (SELECT DISTINCT p_partkey AS id, unnest({WORDS.format(chr(112) + '_name||' + chr(39) + ' ' + chr(39) + '||p_type')}) AS term FROM part), q AS (SELECT DISTINCT p_partkey AS query_id, unnest({WORDS.format('p_type')}) AS term FROM part WHERE p_partkey%50=0), sc AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM p JOIN q USING (term) GROUP BY ALL) {adapt.top('sc', K)}",
    "R32_synthetic_ids": "SELECT p_partkey, 'B'||upper(substr(sha1(p_name),1,9)) AS asin FROM part",
    "R33_slots": f"WITH {U}, s AS (SELECT id, generate_subscripts(regexp_split_to_array(lower(content),'[.!?\\n]+'),1) AS k, unnest(regexp_split_to_array(lower(content),'[.!?\\n]+')) AS s FROM u), w AS (SELECT DISTINCT id, k, unnest({WORDS.format('s')}) AS word FROM s), kd AS (SELECT DISTINCT id, k, CASE WHEN word IN ('of','in') THEN 'a' WHEN word='de' THEN 'b' ELSE 'c' END AS slot FROM w WHERE word IN ('of','in','de','be')), dy AS (SELECT DISTINCT id, k, CASE word WHEN 'the' THEN 1 WHEN 'la' THEN 2 ELSE 3 END AS day FROM w WHERE word IN ('the','la','und')) SELECT DISTINCT kd.id, coalesce(dy.day, a.day)::INT AS day, slot FROM kd LEFT JOIN dy USING (id, k) LEFT JOIN (SELECT unnest([1,2,3]) AS day) a ON dy.day IS NULL",
    "R36_condensed_query": f"WITH {Q}, k AS (SELECT query_id, {q_retrieval._KW} AS w FROM q) SELECT query_id, array_to_string((list_filter(w, lambda x, i: list_position(w, x)=i))[1:6],' ') AS query FROM k",
    "F07_variant_merge": f"WITH {_R04}, {_R23}, x AS (SELECT query_id, id, score AS fused, id*37%100/100.0::DOUBLE AS utility, 0.5::DOUBLE AS similarity, 0 AS nth FROM r4 UNION ALL SELECT query_id, id, round(score/12,6), id*37%100/100.0::DOUBLE, round(score/20,6), 1 FROM r23), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY fused DESC, nth) AS pos FROM x) SELECT query_id, id, fused, utility, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, utility DESC, similarity DESC, id)::INT AS rank FROM y WHERE pos=1) WHERE rank<={K}",
    "I30_rolled_up": f"WITH {T}, l0 AS (SELECT conv_id AS grp, turn AS seq, content FROM t), {', '.join(f'l{k} AS (SELECT grp, s AS seq, substr(string_agg(content, chr(10) ORDER BY seq),1,300) AS content FROM (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY seq)-1)//6 AS s FROM l{k - 1} WHERE (SELECT max(n) FROM (SELECT count(*) AS n FROM l{k - 1} GROUP BY grp))>1) GROUP BY grp, s)' for k in range(1, 6))} SELECT grp, level, seq::BIGINT AS seq, md5(content) AS digest FROM ({' UNION ALL '.join(f'SELECT {k} AS level, * FROM l{k}' for k in range(1, 6))})",
    "I31_alias_expansion": f"WITH {Q}, w AS (SELECT query_id, query, list_sort(list_distinct(list_transform(list_filter({WORDS.format('query')}, lambda x: length(x)=4), lambda x: reverse(x)))) AS a FROM q) SELECT query_id, md5(CASE WHEN len(a)>0 THEN query||' | '||array_to_string(a,' | ') ELSE query END) AS digest FROM w",
    "R34_tiers": f"WITH {_R04}, {_R23}, {q_retrieval._ENT}, sc8 AS (SELECT query_id, id, round(count(*)::DOUBLE/any_value(n),6) AS score FROM ent JOIN qe USING (entity) JOIN (SELECT query_id, count(*) AS n FROM qe GROUP BY 1) USING (query_id) GROUP BY ALL), r8 AS ({adapt.top('sc8', K)}), g AS (SELECT query_id FROM r4 GROUP BY 1 HAVING max(score)>=1.0) SELECT query_id, id, score, 1 AS tier FROM r4 WHERE query_id IN (SELECT query_id FROM g) UNION ALL SELECT query_id, id, score, 2 FROM r8 WHERE query_id NOT IN (SELECT query_id FROM g) UNION ALL SELECT query_id, id, score, 3 FROM r23 WHERE query_id NOT IN (SELECT query_id FROM g) AND query_id NOT IN (SELECT query_id FROM r8)",
    "X03_X12_closed_answers": f"WITH {q_eval._PAIRED}, s AS (SELECT *, ({q_eval._HITS})::DOUBLE AS h, {q_eval._v2('prediction')} AS p2, {q_eval._v2('gold')} AS g2 FROM ab) SELECT conv_id, turn, round(CASE WHEN (np IN ('yes','no','noanswer') OR ng IN ('yes','no','noanswer')) AND np<>ng THEN 0.0 ELSE {q_eval._F1} END,6) AS f1, (contains(p2,g2) OR contains(g2,p2))::INT::DOUBLE AS contains, round(CASE WHEN len(a)+len(b)=0 THEN 0.0 ELSE len(list_intersect(a,b))::DOUBLE/len(list_distinct(list_concat(a,b))) END,6) AS jaccard, try_cast(nullif(regexp_extract(prediction,'[0-9]+'),'') AS INT) AS choice FROM s",
    "X16_X20_bounded_read": f"WITH {U}, l AS (SELECT id, content, string_split(content,chr(10)) AS l FROM u), h AS (SELECT *, list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x,'(?i)moron|idiot') THEN i END), lambda x: x IS NOT NULL)[1:3] AS h, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x<>'') AS f FROM l) SELECT id, md5(coalesce(f[len(f)],'')) AS last_line, md5(CASE WHEN len(h)>0 THEN array_to_string(list_filter(l, lambda x, i: len(list_filter(h, lambda k: abs(k-i)<=2))>0), chr(10)) ELSE substr(content,1,200) END) AS read FROM h",
    "T08_two_phases": f"WITH RECURSIVE {S}, n AS (SELECT key, count(*) AS visits FROM s WHERE seq<40 GROUP BY 1), f AS (SELECT key, 0 AS i, 0.0::DOUBLE AS q FROM n UNION ALL SELECT f.key, i+1, 0.7::DOUBLE*q+0.3::DOUBLE*reward FROM f JOIN s ON s.key=f.key AND s.seq=f.i AND s.seq<40) SELECT n.key, (SELECT count(*) FROM s WHERE s.key=n.key AND s.seq>=40) AS tested, round(q,9) AS q FROM n JOIN f ON f.key=n.key AND f.i=visits WHERE tested>0",
    "X17_answer_marker": f"WITH {T} SELECT conv_id, turn, role||' said so' AS answer FROM t",
    "X26_flat_json": "SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k FROM events",
    "X30_sufficiency": f"WITH {U}, {Q}, {_R23}, b AS (SELECT query_id, max(score) FILTER (rank=1) AS best, coalesce(max(score) FILTER (rank=2),0) AS second, count(*) AS n, max(id) FILTER (rank=1) AS id FROM r23 GROUP BY 1), c AS (SELECT b.*, {WORDS.format('content')} AS f, {WORDS.format('query')} AS w FROM b JOIN u USING (id) JOIN q USING (query_id)) SELECT query_id, len(list_filter(w, lambda x: NOT list_contains(f,x)))=0 AS covered, best-second>=1 AS clear, n>1 AS diverse, len(f)>0 AS renderable FROM c",
    "X33_picked_action": "WITH e AS (SELECT event_id, event_type, CASE WHEN event_id%3=0 THEN event_type ELSE 'I will '||event_type||CASE WHEN event_id%2=0 THEN ' now' ELSE '' END END AS s FROM events) SELECT event_id, CASE WHEN contains(s,'purchase now') THEN 'purchase now' WHEN contains(s,'purchase') THEN 'purchase' WHEN contains(s,'click') THEN 'click' WHEN contains(s,'view') THEN 'View' END AS action FROM e",
    "P05_all_patterns": f"WITH {U} SELECT id FROM u WHERE regexp_matches(content,'(?i)th') AND regexp_matches(content,'(?i)a|e') AND regexp_matches(content,'(?i)n')",
    "S10_evidence": f"WITH {U}, w AS (SELECT id, (list_filter(regexp_split_to_array(content,'[\\s\\p{{Z}}]+'), lambda x: x<>''))[1:3] AS w FROM u) SELECT id, array_to_string(list_transform(w, lambda x, i: x||':'||(i-1)),';') AS evidence FROM w",
    "S18_seeded_sample": f"WITH {U} SELECT id FROM u ORDER BY md5('42:'||id) LIMIT 25",
}
