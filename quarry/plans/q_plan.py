"""Queries of filters, implicit joins, planned search and graph templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import plan as P
from quarry.plans import adapt
from quarry.plans.adapt import T, U

PLAN = {"queries": ["moron", "the\\s+that", "a("], "filters": ["th"], "aggregate_ops": [{"op": "intersect", "args": ["idiot", "the"]}], "top_k": 20}


def _graph(spark, sf):
    t = adapt.turns(spark, sf)
    return t.select(F.col("conv_id").alias("ns"), F.col("turn").alias("vid"), F.col("role").alias("speaker"), F.col("content").alias("text"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(conv_id, turn)").alias("ftime"))


def p02(spark, sf):
    return adapt.units(spark, sf).where((F.col("lang") == "de") & F.col("source").isin("src0", "src1", "src2")).select("id", "lang", "source")


def p03(spark, sf):
    return adapt.units(spark, sf).select("id", *(F.col("content").rlike(P.safe_pattern(p)).alias(n) for n, p in (("valid", "mor+on"), ("literal", "a("), ("never", ""))))


def p04(spark, sf):
    return adapt.units(spark, sf).select("id", P.matching_lines(F.col("content"), P.safe_pattern("^the")).alias("lines")).where("size(lines) > 0").select("id", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")).alias("digest"))


def p06(spark, sf):
    c = adapt.units(spark, sf).select(F.col("id").alias("seq"), F.concat_ws("-", "source", "lang").alias("title"), F.col("content").alias("body"))
    return P.grep_corpus(c, "worthless").select("seq", "title", F.md5("snippet").alias("snippet"))


def p07(spark, sf):
    c = adapt.table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("title"))
    asked = adapt.table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.when(F.col("c_custkey") % 20 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("title"))
    return P.read_title(c, asked)


def p08(spark, sf):
    j = adapt.units(spark, sf).select(F.col("id").alias("seq"), "content")
    return P.recent_grep(j, "Clown", 15).select("seq")


def p09(spark, sf):
    s = adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("role").alias("action"), F.col("content").alias("observation"))
    parts = [P.find_steps(s, m, v).select(F.lit(m).alias("mode"), "key", "seq") for m, v in (("keyword", "THE"), ("regex", "tion\\."), ("action", "assist"), ("entity", "The"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def p10(spark, sf):
    return adapt.turns(spark, sf).where(F.col("turn").isin(0, 3) | F.col("turn").between(5, 6)).select("conv_id", "turn", F.md5(F.substring("content", 1, 300)).alias("head"))


def p15(spark, sf):
    m = F.map_from_arrays(F.array(F.lit("gold"), F.lit("text"), F.lit("answer")), F.array("url", "html", "url"))
    safe = F.map_filter(m, lambda k, _: ~k.isin("gold", "answer", "gold_answer"))
    return adapt.table(spark, sf, "pages").select("page_id", F.array_join(F.map_keys(safe), ",").alias("keys"))


def j01(spark, sf):
    """Anti and semi joins: documents without a label, and labelled ones."""
    d, labels = adapt.table(spark, sf, "documents").select("doc_id"), adapt.table(spark, sf, "labels").select("doc_id")
    return d.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("todo")).unionByName(d.join(labels, "doc_id", "left_semi").withColumn("side", F.lit("done")))


def j07(spark, sf):
    e = adapt.steps(spark, sf).select("key", F.col("seq").cast("int").alias("pos"), "event_type")
    return P.neighbours(e.where("event_type = 'purchase'"), e, 2).select("key", "pos", "event_type")


def j08(spark, sf):
    e = adapt.steps(spark, sf).select("key", F.col("seq").cast("long").alias("at"), "event_type")
    edges = e.where("event_type = 'error'").select("key", F.col("at").alias("edge"), "at")
    return P.nearest(edges, e.where("event_type = 'purchase'").select("key", F.col("at").alias("pos")))


def j12(spark, sf):
    o = adapt.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = adapt.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = adapt.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("orders"))


def q01(spark, sf):
    plan = P.SearchPlan.of(PLAN)
    return P.execute(adapt.units(spark, sf), plan, "which text calls a person an idiot or a clown").select("id", "score", F.size("matches").alias("matches"), "rank")


def f08(spark, sf):
    u = adapt.units(spark, sf)
    args = ["idiot", "clown", "moron"]
    return P.set_operation(u, "intersect", args[:1]).withColumn("op", F.lit("intersect")).unionByName(P.set_operation(u, "union", args).withColumn("op", F.lit("union")))


def a24(spark, sf):
    return P.set_operation(adapt.units(spark, sf), "count", ["idiot", "the"])


def f10(spark, sf):
    p = adapt.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ordered on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" as "), F.col("o_orderpriority")).alias("content"))
    return P.temporal_order(p)


def g01(spark, sf):
    return P.speaker_mentions(_graph(spark, sf), "user", "The").select("ns", "vid")


def g02(spark, sf):
    return P.keyword_search(_graph(spark, sf), "tion").select("ns", "vid")


def g03(spark, sf):
    return P.follow_chain(_graph(spark, sf), 1, 3).select("ns", "vid", "speaker")


def g05(spark, sf):
    return P.first_last(_graph(spark, sf), "assistant")


def g06(spark, sf):
    return P.between_dates(_graph(spark, sf), "2024-01-03", "2024-02-01").select("ns", "vid")


def r10(spark, sf):
    """Nations as concepts that link suppliers: two hops from the nations of one region's suppliers with large balances."""
    s = adapt.table(spark, sf, "supplier")
    links = s.select(F.col("s_nationkey").alias("concept"), F.col("s_suppkey").alias("id")).unionByName(s.select((F.col("s_suppkey") % 7 + 100).cast("int").alias("concept"), F.col("s_suppkey").alias("id")))
    seeds = adapt.table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("concept"))
    return P.multi_hop(links, seeds, 2)


def _r11_edges(spark, sf):
    """Nation-region and customer-nation edges, both ways."""
    from functools import reduce

    c = adapt.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"), F.lit(0.05).alias("weight"))
    n = adapt.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"), F.lit(1.0).alias("weight"))
    both = c.unionByName(n)
    return reduce(lambda x, y: x.unionByName(y), [both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), both.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")])


def r11(spark, sf):
    """Rank over nation-region and customer-nation edges, from one region, after the six rounds that its SQL has."""
    rank = P.page_rank(_r11_edges(spark, sf), spark.range(1).select(F.lit("r1").alias("node")), rounds=6)
    return rank.where("rank > 0").select("node", F.round("rank", 8).alias("score"))


def r11_converged(spark, sf):
    """As above, until the ranks change by less than 1e-6 in all or for fifty rounds."""
    rank = P.page_rank(_r11_edges(spark, sf), spark.range(1).select(F.lit("r1").alias("node")), rounds=50, tolerance=1e-6)
    return rank.where("rank > 0").select("node", F.round("rank", 8).alias("score"))


QUERIES = {
    "P02_P11_P12_row_filter": p02,
    "P03_safe_regex": p03,
    "P04_line_grep": p04,
    "P06_corpus_grep": p06,
    "P07_title_lookup": p07,
    "P08_T07_journal_grep": p08,
    "P09_R28_trajectory_find": p09,
    "P10_R30_trajectory_get": p10,
    "P15_leakage_filter": p15,
    "J03_J04_J05_S24_semi_anti": j01,
    "J07_range_neighbours": j07,
    "J08_nearest": j08,
    "J12_lookup": j12,
    "Q01_Q02_F11_planned_search": q01,
    "F08_F09_Q05_match_sets": f08,
    "A24_match_count": a24,
    "F10_temporal_sort": f10,
    "G01_speaker_mentions": g01,
    "G02_keyword_search": g02,
    "G03_J14_follow_chain": g03,
    "G05_speaker_first_last": g05,
    "G06_between_dates": g06,
    "R10_J09_multi_hop": r10,
    "R11_page_rank": r11,
    "R11_page_rank_converged": r11_converged,
}

_G = f"{T}, g AS (SELECT conv_id AS ns, turn AS vid, role AS speaker, content AS text, TIMESTAMP '2024-01-01' + to_days(conv_id::INT) + to_hours(turn) AS ftime FROM t)"
_E = "s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS pos, event_type FROM events)"


def _step(prev: str) -> str:
    return f"SELECT node, sum(v) AS rank FROM (SELECT dst AS node, 0.5::DOUBLE*rank*weight/total AS v FROM {prev} JOIN e ON src=node JOIN o USING (src) UNION ALL SELECT 'r1', 0.5::DOUBLE) GROUP BY 1"


def _terms(c: str) -> str:
    inner = adapt.stopped(f"regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9_''/-]+')", X.GREP_STOPWORDS)
    return f"list_distinct(list_filter({inner}, lambda x: length(x)>2))"


def _lines(p: str) -> str:
    return f"list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '{p}'))[1:5]"


def _search(i: int, query: str, p: str) -> str:
    w = _terms(f"'{query} which text calls a person an idiot or a clown'")
    return f"SELECT id, CASE WHEN regexp_matches(CASE WHEN len({_lines(p)})>0 THEN array_to_string({_lines(p)}, chr(10)) ELSE content END, '(?i)th') THEN len(list_intersect({w}, w))::DOUBLE/greatest(1,len({w})) + 0.15::DOUBLE*len({_lines(p)}) ELSE 0 END AS score, len({_lines(p)}) AS matches FROM r"


ORACLE = {
    "P02_P11_P12_row_filter": f"WITH {U} SELECT id, lang, source FROM u WHERE lang='de' AND source IN ('src0','src1','src2')",
    "P03_safe_regex": f"WITH {U} SELECT id, regexp_matches(content,'(?i)mor+on') AS valid, contains(lower(content),'a(') AS literal, false AS never FROM u",
    "P04_line_grep": f"WITH {U}, l AS (SELECT id, list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN regexp_matches(x,'(?i)^the') THEN i||': '||substr(x,1,500) END), lambda x: x IS NOT NULL)[1:5] AS l FROM u) SELECT id, len(l)::INT AS n, md5(array_to_string(l, chr(10))) AS digest FROM l WHERE len(l)>0",
    "P06_corpus_grep": f"WITH {U}, c AS (SELECT id AS seq, source||'-'||lang AS title, content, position('worthless' IN lower(content)) AS p FROM u WHERE contains(lower(content),'worthless')) SELECT seq, title, md5(substr(content, greatest(1,p-80), least(p-1,80)+200)) AS snippet FROM c ORDER BY seq LIMIT 10",
    "P07_title_lookup": "SELECT CASE WHEN c_custkey%20=0 THEN upper(c_name) ELSE c_name END AS title, c_custkey AS seq FROM customer WHERE c_custkey%10=0",
    "P08_T07_journal_grep": f"WITH {U} SELECT id AS seq FROM u WHERE contains(lower(content),'clown') ORDER BY id DESC LIMIT 15",
    "P09_R28_trajectory_find": f"WITH {T}, s AS (SELECT conv_id AS key, turn AS seq, role, role||chr(10)||content AS w FROM t) SELECT 'keyword' AS mode, key, seq FROM s WHERE contains(lower(w),'the') UNION ALL SELECT 'regex', key, seq FROM s WHERE regexp_matches(w,'(?i)tion\\.') UNION ALL SELECT 'action', key, seq FROM s WHERE contains(role,'assist') UNION ALL SELECT 'entity', key, seq FROM s WHERE contains(w,'The')",
    "P10_R30_trajectory_get": f"WITH {T} SELECT conv_id, turn, md5(substr(content,1,300)) AS head FROM t WHERE turn IN (0,3) OR turn BETWEEN 5 AND 6",
    "P15_leakage_filter": "SELECT page_id, 'text' AS keys FROM pages",
    "J03_J04_J05_S24_semi_anti": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' ELSE 'todo' END AS side FROM documents",
    "J07_range_neighbours": f"WITH {_E} SELECT DISTINCT a.key, a.pos::INT AS pos, a.event_type FROM s a JOIN s b ON a.key=b.key AND a.pos BETWEEN b.pos-2 AND b.pos+2 WHERE b.event_type='purchase'",
    "J08_nearest": f"WITH {_E}, x AS (SELECT a.key, a.pos AS edge, b.pos AS p, row_number() OVER (PARTITION BY a.key, a.pos ORDER BY abs(a.pos-b.pos), b.pos) AS r FROM s a JOIN s b ON a.key=b.key AND b.event_type='purchase' WHERE a.event_type='error') SELECT a.key, a.pos AS edge, a.pos AS at, p AS nearest FROM s a LEFT JOIN x ON x.key=a.key AND x.edge=a.pos AND r=1 WHERE a.event_type='error'",
    "J12_lookup": "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey GROUP BY 1",
    "Q01_Q02_F11_planned_search": f"WITH {U}, r AS (SELECT id, content, {_terms('content')} AS w FROM u), a AS ({_search(0, 'moron', '(?i)moron')} UNION ALL {_search(1, 'the\\s+that', '(?i)the\\s+that')} UNION ALL {_search(2, 'a(', '(?i)a\\(')}), b AS (SELECT id, score, matches, row_number() OVER (PARTITION BY id ORDER BY score DESC, matches DESC) AS k FROM a WHERE score>0), sc AS (SELECT id, round(score,4) AS score, matches::INT AS matches FROM b WHERE k=1) SELECT id, score, matches, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank<=20",
    "F08_F09_Q05_match_sets": f"WITH {U} SELECT id, 'intersect' AS op FROM u WHERE regexp_matches(content,'(?i)idiot') UNION ALL SELECT id, 'union' FROM u WHERE regexp_matches(content,'(?i)idiot|clown|moron')",
    "A24_match_count": f"WITH {U} SELECT count(*) AS n FROM u WHERE regexp_matches(content,'(?i)idiot')",
    "F10_temporal_sort": "SELECT o_orderkey AS id, strftime(o_orderdate,'%Y-%m-%d') AS date, row_number() OVER (ORDER BY strftime(o_orderdate,'%Y-%m-%d'), o_orderkey) AS rank FROM orders",
    "G01_speaker_mentions": f"WITH {_G} SELECT ns, vid FROM g WHERE speaker='user' AND contains(lower(text),'the') ORDER BY ftime, ns, vid LIMIT 10",
    "G02_keyword_search": f"WITH {_G} SELECT ns, vid FROM g WHERE contains(lower(text),'tion') ORDER BY ftime, ns, vid LIMIT 10",
    "G03_J14_follow_chain": f"WITH {_G} SELECT ns, vid, speaker FROM g WHERE vid BETWEEN 2 AND 4",
    "G05_speaker_first_last": f"WITH {_G} SELECT ns, arg_min(vid, ftime) AS first, arg_max(vid, ftime) AS last FROM g WHERE speaker='assistant' GROUP BY 1",
    "G06_between_dates": f"WITH {_G} SELECT ns, vid FROM g WHERE ftime BETWEEN '2024-01-03' AND '2024-02-01' ORDER BY ftime, ns, vid LIMIT 15",
    "R10_J09_multi_hop": "WITH l AS (SELECT s_nationkey AS c, s_suppkey AS id FROM supplier UNION ALL SELECT (s_suppkey%7+100)::INT, s_suppkey FROM supplier), h0 AS (SELECT DISTINCT id FROM l JOIN nation ON n_nationkey=c WHERE n_regionkey=1), c1 AS (SELECT DISTINCT c FROM l JOIN h0 USING (id) WHERE c NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey=1)), h1 AS (SELECT DISTINCT id FROM l JOIN c1 USING (c)) SELECT 1 AS query_id, id, max(score) AS score FROM (SELECT id, 1.0::DOUBLE AS score FROM h0 UNION ALL SELECT id, 0.5::DOUBLE FROM h1) GROUP BY id",
    "R11_page_rank": "WITH b AS (SELECT 'c'||c_custkey AS a, 'n'||c_nationkey AS b, 0.05::DOUBLE AS weight FROM customer UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, 1.0::DOUBLE FROM nation), e AS (SELECT a AS src, b AS dst, weight FROM b UNION ALL SELECT b, a, weight FROM b), o AS (SELECT src, sum(weight) AS total FROM e GROUP BY 1), k0 AS (SELECT 'r1' AS node, 1.0::DOUBLE AS rank), "
    + ", ".join(f"k{i} AS ({_step(f'k{i - 1}')})" for i in range(1, 7))
    + " SELECT node, round(rank,8) AS score FROM k6 WHERE rank>0",
}
