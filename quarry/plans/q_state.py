"""Queries of session state, sources and the model boundary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import models, text as X
from quarry.plans import adapt
from quarry.plans.adapt import S, T, U
from quarry.sources import tables
from quarry.streaming import sessions, stateful


def _rows(spark, sf):
    return adapt.turns(spark, sf).select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "role", "content")


def t02(spark, sf):
    return sessions.buffered(_rows(spark, sf), 3, 800).select("key", "seq", F.md5("memory").alias("digest"))


def t03(spark, sf):
    e = adapt.steps(spark, sf)
    rows = e.select("key", "seq", F.col("event_type").alias("name"), F.when(F.col("value") > 50, "accept").otherwise("reject").alias("verdict"), F.col("event_id").cast("string").alias("content"))
    return sessions.beliefs(rows).select("key", "name", "first", "last", "verdict", F.array_join("evidence", ",").alias("evidence"))


def _changes(spark, sf):
    e = adapt.table(spark, sf, "events")
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").when(F.col("event_id") % 11 == 0, "delete").otherwise("put").alias("op"), F.col("event_id").cast("string").alias("content"))


def t05(spark, sf):
    return sessions.latest(_changes(spark, sf))


def t04(spark, sf):
    store = sessions.latest(_changes(spark, sf)).select(F.split("id", ":")[0].cast("long").alias("key"), "id", "place")
    return sessions.capped(store, 2)


def t06(spark, sf):
    return sessions.utilities(adapt.steps(spark, sf).select("key", "seq", "reward"), floor=-0.5)


def t02_stream(spark, sf):
    rows = _rows(spark, sf).select("key", "seq", "content")
    return stateful.replayed(rows, lambda r: stateful.buffered(r, 3, 800), "content", ["key", "seq"]).select("key", "seq", F.md5("memory").alias("digest"))


def t03_stream(spark, sf):
    e = adapt.steps(spark, sf)
    rows = e.select("key", "seq", F.col("event_type").alias("name"), F.when(F.col("value") > 50, "accept").otherwise("reject").alias("verdict"), F.col("event_id").cast("string").alias("content"))
    return stateful.replayed(rows, stateful.beliefs, "content", ["key", "name"]).select("key", "name", "first", "last", "verdict", F.array_join("evidence", ",").alias("evidence"))


def t05_stream(spark, sf):
    return stateful.replayed(_changes(spark, sf), stateful.change_log, "seq", ["id"]).where("place is not null")


def t06_stream(spark, sf):
    rows = adapt.steps(spark, sf).select("key", "seq", "reward", "event_id")
    return stateful.replayed(rows, lambda r: stateful.utilities(r, floor=-0.5), "event_id", ["key"])


def ext(spark, sf):
    return sessions.windowed(adapt.table(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "value")


def s06(spark, sf):
    """Conversations written in the dialogue layout and read back: sessions of four turns."""
    t = adapt.turns(spark, sf)
    part = F.floor(F.col("turn") / 4)
    turn = F.struct(F.col("role").alias("speaker"), F.col("content").alias("text"), F.col("turn").cast("string").alias("dia_id"), F.when(F.col("turn") % 5 == 4, "a picture").alias("blip_caption"))
    parts = t.groupBy("conv_id", part.alias("p")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"])).alias("turns"))
    name = F.concat(F.lit("session_"), (F.col("p") + 1).cast("string"))
    whole = parts.groupBy(F.col("conv_id").alias("sample_id")).agg(F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.col("turns").alias("v")))), F.map_from_entries(F.collect_list(F.struct(F.concat(name, F.lit("_date_time")).alias("k"), F.concat(F.lit("day "), F.col("p").cast("string")).alias("v")))))).alias("conversation"))
    return tables.dialogue_turns(whole).select("sample_id", "session", "turn", "speaker", F.md5("content").alias("digest"), "ts_raw")


def s09(spark, sf):
    joined = F.concat(F.lit("Document 1:\n"), F.col("content"), F.lit("\nDocument 2: "), F.col("source"))
    return adapt.units(spark, sf).select("id", F.posexplode(tables.numbered_documents(joined)).alias("at", "body")).select("id", "at", F.md5(F.trim(F.regexp_replace("body", r"\s+", " "))).alias("digest"))


def s12(spark, sf):
    e = adapt.steps(spark, sf)
    return e.select("key", "seq", tables.step_text(F.when(F.col("event_type") != "view", F.col("event_type")), F.round("value", 2).cast("decimal(20,2)").cast("string"), F.col("seq")).alias("line"))


def s15(spark, sf):
    d = adapt.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "lang")
    manifest = adapt.table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), ((F.col("item_id") * 7) % 200).alias("idx"))
    return tables.manifest_scan(d, manifest, 25).select("pos", "idx", "lang")


def s16(spark, sf):
    t = adapt.turns(spark, sf).groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "content"))), lambda r: r["content"]).alias("questions"))
    return tables.sessions(t.withColumn("answers", F.col("questions")).withColumn("backgrounds", F.array(F.lit("same")))).select("id", "session", F.md5("question").alias("question"), F.md5("gold").alias("gold"), "background")


def s17(spark, sf):
    n = adapt.table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("body"))
    return tables.titled_corpus(n).select("title", "seq", F.md5("body").alias("digest"))


def s21(spark, sf):
    return tables.unordered_digest(adapt.table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_name")


def s24(spark, sf):
    r = adapt.steps(spark, sf).select("key", "event_type", "event_id", "ts")
    return tables.latest_results(r, ["key", "event_type"], "event_id").select("key", "event_type", "event_id")


def s27(spark, sf):
    return adapt.table(spark, sf, "pages").select("page_id", F.md5(X.html_text(F.col("html"))).alias("digest"), F.length(X.html_text(F.col("html"))).cast("long").alias("chars"))


def s28(spark, sf):
    p = adapt.table(spark, sf, "pages")
    r = p.select(F.col("page_id").alias("call"), F.lit(0).alias("pos"), "url").unionByName(p.select((F.col("page_id") + 1).alias("call"), F.lit(1).alias("pos"), F.concat(F.lit("https://s.example/l/?uddg="), F.url_encode("url"), F.lit("&x=1")).alias("url")))
    return tables.first_urls(r)


def u07(spark, sf):
    rows = adapt.questions(spark, sf)
    return models.generate(rows, "query", models.first_sentence).select("query_id", F.md5("answer").alias("answer"))


def i16(spark, sf):
    u = adapt.units(spark, sf).select("id", "content")
    made = models.generate(u, "content", models.first_sentence, "short")
    return made.select("id", models.density_gate(F.col("content"), F.col("short")).alias("kept")).where("kept is not null").select("id", F.md5("kept").alias("digest"))


QUERIES = {
    "T02_session_buffer": t02,
    "T03_belief_state": t03,
    "T04_T09_capped_store": t04,
    "T05_change_log": t05,
    "T06_T01_utilities": t06,
    "T02_stream_buffer": t02_stream,
    "T03_stream_beliefs": t03_stream,
    "T05_stream_change_log": t05_stream,
    "T06_T01_stream_utilities": t06_stream,
    "EXT_event_time_windows": ext,
    "S06_S07_S08_dialogue_turns": s06,
    "S09_numbered_documents": s09,
    "S12_S13_step_text": s12,
    "S15_manifest_scan": s15,
    "S16_S14_sessions": s16,
    "S17_titled_corpus": s17,
    "S21_S22_S30_digest_keys": s21,
    "S24_latest_results": s24,
    "S27_visible_text": s27,
    "S28_first_urls": s28,
    "U07_S23_generate": u07,
    "I16_compress_gate": i16,
}

_BUFFER = "string_agg(content, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_LOG = "c AS (SELECT user_id||':'||event_type AS id, user_id, event_id AS seq, CASE WHEN event_type='error' OR event_id%11=0 THEN 'delete' ELSE 'put' END AS op, event_id::VARCHAR AS content FROM events), l AS (SELECT id, any_value(user_id) AS user_id, arg_max(op, seq) AS op, arg_max(content, seq) AS content, coalesce(max(seq) FILTER (op='delete'),-1) AS gone FROM c GROUP BY 1), st AS (SELECT l.id, user_id, (SELECT min(seq) FROM c WHERE c.id=l.id AND c.op='put' AND c.seq>gone) AS place, content FROM l WHERE op='put')"
ORACLE = {
    "I16_compress_gate": f"WITH {U}, s AS (SELECT id, content, trim(string_split(content,'.')[1], chr(10)||chr(9)||chr(13)||' ') AS s FROM u), k AS (SELECT * FROM s WHERE NOT (upper(s)='SKIP' OR (len(regexp_split_to_array(s,'\\s+'))<3 AND length(s)<0.3*length(content)))) SELECT id, md5(s) AS digest FROM k",
    "T02_session_buffer": f"WITH {T}, b AS (SELECT conv_id AS key, turn AS seq, {_BUFFER} AS m FROM t) SELECT key, seq, md5(CASE WHEN m IS NULL THEN 'No previous memory.' WHEN length(m)>800 THEN right(m,800) ELSE m END) AS digest FROM b",
    "T03_belief_state": f"WITH {S} SELECT key, event_type AS name, min(seq)::INT AS first, max(seq)::INT AS last, arg_max(CASE WHEN value>50 THEN 'accept' ELSE 'reject' END, seq) AS verdict, array_to_string((list(event_id::VARCHAR ORDER BY seq))[1:3], ',') AS evidence FROM s GROUP BY 1,2",
    "T04_T09_capped_store": f"WITH {_LOG} SELECT user_id AS key, id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place DESC, id DESC) AS r FROM st) WHERE r<=2",
    "T05_change_log": f"WITH {_LOG} SELECT id, place, content FROM st",
    "T06_T01_utilities": f"WITH RECURSIVE {S}, n AS (SELECT key, count(*) AS visits FROM s GROUP BY 1), f AS (SELECT key, 0 AS i, 0.0::DOUBLE AS q, 0.0::DOUBLE AS m FROM n UNION ALL SELECT f.key, i+1, greatest(-0.5::DOUBLE, 0.7::DOUBLE*q+0.3::DOUBLE*reward), 0.7::DOUBLE*m+0.3::DOUBLE*reward FROM f JOIN s ON s.key=f.key AND s.seq=f.i) SELECT n.key, visits, round(q,9) AS q, round(m,9) AS reward_mean FROM n JOIN f ON f.key=n.key AND f.i=visits",
    "EXT_event_time_windows": "SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value),4) AS value FROM events GROUP BY ALL",
    "S06_S07_S08_dialogue_turns": f"WITH {T} SELECT conv_id AS sample_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn//4)::INT AS session, (row_number() OVER (PARTITION BY conv_id, turn//4 ORDER BY turn)-1)::INT AS turn, role AS speaker, md5(CASE WHEN turn%5=4 THEN '[Image: a picture] '||content ELSE content END) AS digest, 'day '||(turn//4) AS ts_raw FROM t",
    "S09_numbered_documents": f"WITH {U}, x AS (SELECT id, 1 AS k, trim(regexp_replace(content,'\\s+',' ','g')) AS b FROM u UNION ALL SELECT id, 2, trim(regexp_replace(source,'\\s+',' ','g')) FROM u) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k)-1)::INT AS at, md5(b) AS digest FROM x WHERE b<>''".replace(" AS at,", ' AS "at",'),
    "S12_S13_step_text": f"WITH {S} SELECT key, seq::INT AS seq, concat_ws(' | ', '[Turn '||seq||']', 'Action: '||CASE WHEN event_type<>'view' THEN event_type END, 'Observation: '||round(value,2)::DECIMAL(20,2)::VARCHAR) AS line FROM s",
    "S15_manifest_scan": "SELECT item_id AS pos, doc_id AS idx, lang FROM (SELECT item_id, (item_id*7)%200 AS i FROM benchmark ORDER BY item_id LIMIT 25) JOIN documents ON doc_id=i",
    "S16_S14_sessions": f"WITH {T} SELECT conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)::INT AS session, md5(content) AS question, md5(content) AS gold, 'same' AS background FROM t",
    "S17_titled_corpus": "SELECT c_mktsegment AS title, min(c_custkey) AS seq, md5(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1",
    "S21_S22_S30_digest_keys": "WITH e AS (SELECT s_nationkey, sha256(s_suppkey||chr(31)||coalesce(s_name,'')) AS h FROM supplier) SELECT s_nationkey, count(*) AS n, sha256(count(*)||chr(30)||sum(('0x'||substr(h,1,15))::HUGEINT)||chr(30)||sum(('0x'||substr(h,16,15))::HUGEINT)) AS digest FROM e GROUP BY 1",
    "S24_latest_results": f"WITH {S} SELECT key, event_type, max(event_id) AS event_id FROM s GROUP BY ALL",
    "S27_visible_text": "WITH p AS (SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html,''),'(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>',' ','g'),'(?s)<[^>]+>',' ','g'),'\\s+',' ','g')),1,200000) AS t FROM pages) SELECT page_id, md5(t) AS digest, length(t) AS chars FROM p",
    "S28_first_urls": "WITH r AS (SELECT page_id AS call, 0 AS pos, url FROM pages UNION ALL SELECT page_id+1, 1, url FROM pages) SELECT call, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY call, pos) AS k FROM r) WHERE k=1",
    "U07_S23_generate": f"WITH {adapt.Q} SELECT query_id, md5(trim(string_split(query,'.')[1], chr(10)||chr(9)||chr(13)||' ')) AS answer FROM q",
}
ORACLE |= {f"{name}_stream_{rest}": ORACLE[of] for name, rest, of in (("T02", "buffer", "T02_session_buffer"), ("T03", "beliefs", "T03_belief_state"), ("T05", "change_log", "T05_change_log"), ("T06_T01", "utilities", "T06_T01_utilities"))}
