"""Queries of scalar functions, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scores, text as X
from quarry.operators import evaluation, retrieval
from quarry.plans import adapt, q_retrieval
from quarry.plans.adapt import S, T, U


def x01(spark, sf):
    return adapt.units(spark, sf).select("id", F.md5(X.normalise(F.col("content"))).alias("v1"), F.md5(X.normalise_spaced(F.col("content"))).alias("v2"), F.size(X.table_words(F.col("content"))).cast("long").alias("words"))


def _pairs(spark, sf):
    """Each turn as a prediction of the next one's text."""
    from pyspark.sql import Window

    t = adapt.turns(spark, sf)
    gold = F.lead("content").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("gold", gold).where("gold is not null").select("conv_id", "turn", "role", F.col("content").alias("prediction"), "gold")


def x06(spark, sf):
    p = _pairs(spark, sf).withColumn("a", X.answer_words(F.col("prediction"))).withColumn("b", X.answer_words(F.col("gold")))
    exact = (X.normalise(F.col("prediction")) == X.normalise(F.col("gold"))).cast("double")
    return p.select("conv_id", "turn", exact.alias("exact"), F.round(scores.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), F.round(scores.set_f1(X.table_words(F.col("prediction")), X.table_words(F.col("gold"))), 6).alias("set_f1"))


def x08(spark, sf):
    p = _pairs(spark, sf).withColumn("a", X.answer_words(F.col("prediction"))).withColumn("b", X.answer_words(F.col("gold")))
    return p.select("conv_id", "turn", F.round(scores.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge_l"), *(F.round(scores.bleu(F.col("a"), F.col("b"), n), 6).alias(f"bleu_{n}") for n in (1, 4)))


def x11(spark, sf):
    number = F.regexp_extract("content", r"-?[0-9]+\.?[0-9]*", 0).try_cast("double")
    return adapt.units(spark, sf).select("id", F.round(number, 6).alias("number"), F.regexp_extract("content", r"[0-9]+", 0).alias("digits"))


def x13(spark, sf):
    asked = adapt.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")).where(F.size(X.split_words(F.col("q"))) > 0)
    gold = retrieval.containing(adapt.units(spark, sf).select("id", F.col("content").alias("low")), asked)
    return evaluation.ranking_metrics(q_retrieval.r23(spark, sf), gold)


def x15(spark, sf):
    """Verdicts read off free text: a word that says correct or wrong, and a score."""
    c = F.lower("content")
    verdict = F.when(c.rlike(r"(^|[^a-z])(wrong|incorrect|no)([^a-z]|$)"), "wrong").when(c.rlike(r"(^|[^a-z])(correct|yes)([^a-z]|$)"), "correct").otherwise("none")
    return adapt.turns(spark, sf).select("conv_id", "turn", verdict.alias("verdict"), F.regexp_extract(c, r"score[: ]+([0-9]+)", 1).alias("score"))


def x18(spark, sf):
    return adapt.units(spark, sf).select("id", *(X.token_estimate(F.col("content"), r).alias(r) for r in ("ceil", "floor", "least")), X.token_estimate(F.col("content"), "words").alias("words"))


def x19(spark, sf):
    return adapt.units(spark, sf).select("id", F.md5(X.cut_middle(F.col("content"), 500)).alias("middle"), F.md5(X.cut_end(F.col("content"), 300)).alias("tail"))


def x22(spark, sf):
    c = adapt.table(spark, sf, "customer")
    parts = F.map_from_arrays(F.array(F.lit("name"), F.lit("segment"), F.lit("nation")), F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", F.array_join(F.transform(F.map_entries(parts), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ").alias("line"))


def x23(spark, sf):
    """A step's update: its own value and trace from the row, the best value to come from the next step."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("seq")
    q, following, trace = F.col("value") / 100, F.lead("value").over(order) / 100, F.lag("reward").over(order)
    e = adapt.steps(spark, sf).withColumn("q", q).withColumn("following", following).withColumn("trace", trace)
    updated, mean = scores.utility_update(F.col("q"), F.col("trace"), F.col("reward"), F.col("following"))
    return e.select("event_id", F.round(updated, 6).alias("q"), F.round(mean, 6).alias("reward_mean"))


def x27(spark, sf):
    line = F.concat(F.lit("["), F.col("role"), F.lit("] [time="), F.col("turn").cast("string"), F.lit("] "), F.col("content"))
    pattern = r"(?s)^\[([^\]]+)\] \[time=([^\]]*)\] (.*)$"
    return adapt.turns(spark, sf).select("conv_id", "turn", F.regexp_extract(line, pattern, 1).alias("speaker"), F.regexp_extract(line, pattern, 2).alias("time"), F.md5(F.regexp_extract(line, pattern, 3)).alias("digest"))


def x32(spark, sf):
    """Values of keys that name a secret are masked."""
    m = F.map_from_arrays(F.array(F.lit("api_key"), F.lit("user"), F.lit("password")), F.array(F.md5("url"), F.col("page_id").cast("string"), F.col("url")))
    safe = F.transform_values(m, lambda k, v: F.when(k.rlike("(?i)key|token|secret|password"), F.lit("***")).otherwise(v))
    return adapt.table(spark, sf, "pages").select("page_id", F.array_join(F.transform(F.map_entries(safe), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("safe"))


def x34(spark, sf):
    c = F.lower("content")
    kind = F.when(F.contains(c, F.lit("the")), "the").when(F.contains(c, F.lit("de")), "de").when(F.contains(c, F.lit("und")), "und").otherwise("other")
    return adapt.units(spark, sf).select("id", kind.alias("kind"))


def x35(spark, sf):
    tags = F.array_distinct(F.filter(F.transform(F.split("content", "[,;]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != ""))
    return adapt.turns(spark, sf).select("conv_id", "turn", F.size(tags).cast("long").alias("tags"), F.md5(F.array_join(tags, "|")).alias("digest"))


def a01(spark, sf):
    return adapt.units(spark, sf).select("id", F.explode(F.array_distinct(X.words(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _judged(spark, sf):
    """Labelled documents as judged rows: a category, whether they are correct, and an error for some."""
    rows = adapt.table(spark, sf, "labels").join(adapt.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source"), "doc_id")
    return rows.select("doc_id", F.col("lang").alias("category"), (F.col("quality") == 1).alias("correct"), (F.col("quality") == 1).cast("double").alias("f1"), (F.col("n_chars") / 20000).alias("bleu"), F.when(F.col("toxic") == 1, "judge failed").alias("error"), (F.col("quality") == 1).alias("generous"), ((F.col("quality") == 1) & (F.col("n_chars") > 1000)).alias("strict"))


def a02(spark, sf):
    dimension = spark.createDataFrame([(c,) for c in ("de", "en", "es", "fr", "it")], "category string")
    return evaluation.macro_report(_judged(spark, sf), dimension, ["f1", "bleu"])


def a04(spark, sf):
    return evaluation.category_report(_judged(spark, sf), ["f1", "bleu"])


def a05(spark, sf):
    rows = _judged(spark, sf).withColumn("f1", F.when(F.col("error").isNull(), F.col("f1")))
    return evaluation.missing_as_zero(rows, "category", ["f1", "bleu"])


def a06(spark, sf):
    """Best score of a question over all of a conversation's answers."""
    p = _pairs(spark, sf)
    a, b = X.answer_words(F.col("prediction")), X.answer_words(F.col("gold"))
    return evaluation.best_over_references(p.select("conv_id", F.round(scores.token_f1(a, b), 6).alias("f1"), F.round(scores.set_f1(a, b), 6).alias("set_f1")), ["conv_id"], ["f1", "set_f1"])


def a07(spark, sf):
    return evaluation.judge_report(_judged(spark, sf), "category")


def a08(spark, sf):
    return evaluation.disagreement(_judged(spark, sf), "category")


def a10(spark, sf):
    t = adapt.turns(spark, sf)
    tokens, signal = evaluation.token_signal(F.when(F.col("turn") % 3 == 0, F.col("turn") * 10).otherwise(0), F.when(F.col("turn") % 3 == 1, F.col("content")), F.lit(None).cast("string"))
    rows = t.select("conv_id", "role", tokens.alias("tokens"), signal.alias("signal"))
    return rows.groupBy("role", "signal").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


def a12(spark, sf):
    e = adapt.steps(spark, sf)
    total = F.when(F.sum("value") > 0, F.sum("value")).otherwise(F.count("*").cast("double"))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(total, 3).alias("total"), F.round(F.sum(F.greatest("reward", F.lit(0.0))), 3).alias("gained"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def a16(spark, sf):
    e = adapt.steps(spark, sf).groupBy("key").pivot("event_type", ["click", "view", "purchase"]).count()
    after = F.map_filter(F.map_from_arrays(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")), F.array("click", "view", "purchase")), lambda _, v: v.isNotNull())
    before = F.create_map(F.lit("click"), F.lit(1).cast("long"))
    delta = evaluation.map_difference(after, before)
    return e.select("key", *(F.element_at(delta, F.lit(k)).alias(f"d_{k}") for k in ("click", "view", "purchase")))


def a17(spark, sf):
    return evaluation.session_scores(adapt.steps(spark, sf).select("key", "seq", F.col("success").alias("correct")))


def a18(spark, sf):
    e = adapt.steps(spark, sf)
    return evaluation.phase_report(e.select(F.when(F.col("seq") < 40, "train").otherwise("test").alias("phase"), F.col("event_type").alias("kind"), "success", F.col("seq").alias("steps")))


def _prompts(spark, sf):
    return adapt.turns(spark, sf).select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), X.split_words(F.col("content")).alias("tokens"))


def a20(spark, sf):
    return evaluation.shared_tokens(_prompts(spark, sf))


def a21(spark, sf):
    return evaluation.common_prefix(_prompts(spark, sf))


def a22(spark, sf):
    return adapt.turns(spark, sf).groupBy("conv_id", "role").agg(F.count("*").alias("turns"))


def a23(spark, sf):
    return adapt.turns(spark, sf).groupBy("role").agg(F.md5(F.min_by("content", F.struct("conv_id", "turn"))).alias("first"), F.md5(F.max_by("content", F.struct("conv_id", "turn"))).alias("last"))


def a26(spark, sf):
    """A bonus in proportion to the matched pairs of a query, at most b."""
    m = x13(spark, sf)
    return m.select("query_id", F.round(F.least(F.lit(0.2), 0.2 * F.col("recall_5")), 6).alias("bonus"))


QUERIES = {
    "X01_X02_X04_normalisers": x01,
    "X05_X06_X07_answer_scores": x06,
    "X08_X09_rouge_bleu": x08,
    "X11_X12_numbers": x11,
    "X13_ranking_metrics": x13,
    "X15_verdicts": x15,
    "X18_token_estimates": x18,
    "X19_truncations": x19,
    "X22_row_content": x22,
    "X23_utility_update": x23,
    "X27_dialogue_prefix": x27,
    "X32_redaction": x32,
    "X34_kind_rules": x34,
    "X35_tags": x35,
    "A01_document_frequency": a01,
    "A02_A03_macro_report": a02,
    "A04_category_report": a04,
    "A05_missing_as_zero": a05,
    "A06_best_over_references": a06,
    "A07_A09_judge_report": a07,
    "A08_disagreement": a08,
    "A10_A11_A27_token_signal": a10,
    "A12_A13_A14_usage": a12,
    "A16_counter_difference": a16,
    "A17_session_scores": a17,
    "A18_A19_phase_report": a18,
    "A20_F12_U10_shared_tokens": a20,
    "A21_common_prefix": a21,
    "A22_G04_speakers": a22,
    "A23_first_last": a23,
    "A26_matched_bonus": a26,
}

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _articles(c: str) -> str:
    # Neighbouring articles share a separator, which RE2 cannot look at without taking: two passes find both.
    once = "regexp_replace({0}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    return once.format(once.format(c))


def _v1(c: str) -> str:
    return f"trim(regexp_replace(translate({_articles(f'trim(lower({c}))')}, '{_PUNCT}', ''), '\\s+', ' ', 'g'))"


def _v2(c: str) -> str:
    inner = f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"trim(regexp_replace({_articles(inner)}, '\\s+', ' ', 'g'))"


_TW = "list_filter(regexp_split_to_array(lower(translate({0}, '.,!?', '    ')), '\\s+'), lambda x: x <> '')"
_P = f"{T}, p0 AS (SELECT conv_id, turn, role, content AS prediction, lead(content) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM t), p AS (SELECT * FROM p0 WHERE gold IS NOT NULL)"
_AW = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_HITS = "list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t)))))"
_F1 = "CASE WHEN len(a)=0 AND len(b)=0 THEN 1.0 WHEN len(a)=0 OR len(b)=0 OR h=0 THEN 0.0 ELSE 2*(h/len(a))*(h/len(b))/(h/len(a)+h/len(b)) END"
_SF = "CASE WHEN len(x)=0 OR len(y)=0 OR s=0 THEN 0.0 ELSE 2*(s/len(x))*(s/len(y))/(s/len(x)+s/len(y)) END"
_PAIRED = f"{_P}, w AS (SELECT conv_id, turn, {_v1('prediction')} AS np, {_v1('gold')} AS ng, prediction, gold FROM p), ab AS (SELECT *, {_AW.format('np')} AS a, {_AW.format('ng')} AS b FROM w)"
_J = "j AS (SELECT l.doc_id, lang AS category, quality=1 AS correct, (quality=1)::INT::DOUBLE AS f1, n_chars/20000.0::DOUBLE AS bleu, CASE WHEN toxic=1 THEN 'judge failed' END AS error, quality=1 AS generous, quality=1 AND n_chars>1000 AS strict FROM labels l JOIN documents d USING (doc_id))"
_X13 = f"""{adapt.Q}, {U}, {q_retrieval._R23}, g AS (SELECT DISTINCT item_id AS query_id, id FROM u JOIN benchmark ON length(text)>0 AND contains(content, text)), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
    h AS (SELECT n.query_id, n, rank FROM n LEFT JOIN (SELECT r23.* FROM r23 JOIN g USING (query_id, id)) USING (query_id)),
    m AS (SELECT query_id, {', '.join(f"round(count(*) FILTER (rank<={k})::DOUBLE/any_value(n),6) AS recall_{k}, round(count(*) FILTER (rank<={k})/{k}.0::DOUBLE,6) AS precision_{k}, round(coalesce(sum(1/log2(rank+1)) FILTER (rank<={k}),0)/list_sum(list_transform(range(1,least({k},any_value(n))+1), lambda i: 1/log2(i+1))),6) AS ndcg_{k}" for k in (1, 3, 5, 10))} FROM h GROUP BY query_id)"""

ORACLE = {
    "X01_X02_X04_normalisers": f"WITH {U} SELECT id, md5({_v1('content')}) AS v1, md5({_v2('content')}) AS v2, len({_TW.format('content')}) AS words FROM u",
    "X05_X06_X07_answer_scores": f"WITH {_PAIRED}, s1 AS (SELECT conv_id, turn, np, ng, a, b, ({_HITS})::DOUBLE AS h, list_distinct({_TW.format('prediction')}) AS x, list_distinct({_TW.format('gold')}) AS y FROM ab), s2 AS (SELECT *, len(list_intersect(x,y))::DOUBLE AS s FROM s1) SELECT conv_id, turn, (np=ng)::INT::DOUBLE AS exact, round({_F1},6) AS f1, round({_SF},6) AS set_f1 FROM s2",
    "X11_X12_numbers": f"WITH {U} SELECT id, round(try_cast(nullif(regexp_extract(content,'-?[0-9]+\\.?[0-9]*'),'') AS DOUBLE),6) AS number, regexp_extract(content,'[0-9]+') AS digits FROM u",
    "X13_ranking_metrics": f"WITH {_X13} SELECT * FROM m",
    "X15_verdicts": f"WITH {T} SELECT conv_id, turn, CASE WHEN regexp_matches(lower(content),'(^|[^a-z])(wrong|incorrect|no)([^a-z]|$)') THEN 'wrong' WHEN regexp_matches(lower(content),'(^|[^a-z])(correct|yes)([^a-z]|$)') THEN 'correct' ELSE 'none' END AS verdict, regexp_extract(lower(content),'score[: ]+([0-9]+)',1) AS score FROM t",
    "X18_token_estimates": f"WITH {U} SELECT id, ceil(length(content)/4.0)::BIGINT AS ceil, (length(content)//4)::BIGINT AS floor, greatest(1, ceil(length(content)/4.0))::BIGINT AS least, len(list_filter(regexp_split_to_array(content,'[\\s\\p{{Z}}]+'), lambda x: x<>'')) AS words FROM u",
    "X19_truncations": f"WITH {U} SELECT id, md5(CASE WHEN length(content)>500 THEN substr(content,1,250)||chr(10)||'...[truncated]...'||chr(10)||right(content,250) ELSE content END) AS middle, md5(CASE WHEN length(content)>300 THEN rtrim(substr(content,1,300))||'... [truncated]' ELSE content END) AS tail FROM u",
    "X22_row_content": "SELECT c_custkey, 'name: '||c_name||' | segment: '||c_mktsegment||' | nation: '||c_nationkey AS line FROM customer",
    "X23_utility_update": f"WITH {S} SELECT event_id, round(greatest(-1.0::DOUBLE, 0.7::DOUBLE*(value/100)+0.3::DOUBLE*(reward+0.9::DOUBLE*coalesce(lead(value) OVER w/100,0))),6) AS q, round(0.7::DOUBLE*coalesce(lag(reward) OVER w,0)+0.3::DOUBLE*reward,6) AS reward_mean FROM s WINDOW w AS (PARTITION BY key ORDER BY seq)",
    "A21_common_prefix": f"WITH {T}, p AS (SELECT conv_id AS grp, turn AS id, list_filter(regexp_split_to_array(content,'[\\s\\p{{Z}}]+'), lambda x: x<>'') AS w FROM t), n AS (SELECT grp, count(DISTINCT id) AS prompts FROM p GROUP BY 1), x AS (SELECT grp, id, unnest(w) AS token, generate_subscripts(w,1)-1 AS nth FROM p), g AS (SELECT x.grp, nth, count(*) AS held, count(DISTINCT token) AS kinds, any_value(prompts) AS prompts FROM x JOIN n ON n.grp=x.grp GROUP BY x.grp, nth), c AS (SELECT grp, coalesce(min(nth) FILTER (held<prompts OR kinds>1), max(nth)+1) AS tokens FROM g GROUP BY 1) SELECT n.grp, prompts, coalesce(tokens,0)::BIGINT AS tokens FROM n LEFT JOIN c ON c.grp=n.grp",
    "X27_dialogue_prefix": f"WITH {T} SELECT conv_id, turn, role AS speaker, turn::VARCHAR AS time, md5(content) AS digest FROM t",
    "X32_redaction": "SELECT page_id, 'api_key=***;user='||page_id||';password=***' AS safe FROM pages",
    "X34_kind_rules": f"WITH {U} SELECT id, CASE WHEN contains(lower(content),'the') THEN 'the' WHEN contains(lower(content),'de') THEN 'de' WHEN contains(lower(content),'und') THEN 'und' ELSE 'other' END AS kind FROM u",
    "X35_tags": f"WITH {T}, g AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(content,'[,;]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x<>'') AS l FROM t), d AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM g) SELECT conv_id, turn, len(l) AS tags, md5(array_to_string(l,'|')) AS digest FROM d",
    "A01_document_frequency": f"WITH {U} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content),'[a-z0-9]+')) AS term FROM u) GROUP BY 1",
    "A02_A03_macro_report": f"WITH {_J}, c AS (SELECT unnest(['de','en','es','fr','it']) AS category), m AS (SELECT c.category, avg(f1) AS f1, avg(bleu) AS bleu FROM c LEFT JOIN (SELECT * FROM j WHERE error IS NULL) j USING (category) GROUP BY 1), a AS (SELECT * FROM m UNION ALL SELECT 'all', avg(f1), avg(bleu) FROM m) SELECT category, round(100*f1,4) AS f1, round(100*bleu,4) AS bleu FROM a",
    "A04_category_report": f"WITH {_J} SELECT category, count(*) AS n, count(*) FILTER (error IS NULL) AS answered, count(error) AS failed, round(avg(f1) FILTER (error IS NULL),6) AS f1, round(avg(bleu) FILTER (error IS NULL),6) AS bleu FROM j GROUP BY 1",
    "A05_missing_as_zero": f"WITH {_J}, z AS (SELECT category, CASE WHEN error IS NULL THEN f1 ELSE 0 END AS f1, bleu FROM j) SELECT category, count(*) AS n, round(sum(f1),4) AS sum_f1, round(sum(bleu),4) AS sum_bleu, round(avg(f1),6) AS mean_f1, round(avg(bleu),6) AS mean_bleu FROM z GROUP BY 1",
    "A06_best_over_references": f"WITH {_PAIRED}, s1 AS (SELECT conv_id, a, b, ({_HITS})::DOUBLE AS h, list_distinct(a) AS x, list_distinct(b) AS y FROM ab), s2 AS (SELECT *, len(list_intersect(x,y))::DOUBLE AS s FROM s1) SELECT conv_id, max(round({_F1},6)) AS f1, max(round({_SF},6)) AS set_f1 FROM s2 GROUP BY 1",
    "A07_A09_judge_report": f"WITH {_J} SELECT category, count(*) AS n, count(*) FILTER (error IS NULL) AS judged, count(error) AS errors, count(*) FILTER (error IS NULL AND correct) AS correct, count(*) FILTER (correct) AS correct_all, round(coalesce(count(*) FILTER (error IS NULL AND correct)::DOUBLE/nullif(count(*) FILTER (error IS NULL),0),0),6) AS accuracy FROM j GROUP BY 1",
    "A08_disagreement": f"WITH {_J} SELECT category, count(*) FILTER (generous AND strict) AS both_correct, count(*) FILTER (generous AND NOT strict) AS only_generous, count(*) FILTER (NOT generous AND strict) AS only_strict, count(*) FILTER (NOT generous AND NOT strict) AS both_wrong FROM j GROUP BY 1",
    "A10_A11_A27_token_signal": f"WITH {T}, r AS (SELECT role, CASE WHEN turn%3=0 AND turn>0 THEN turn*10 WHEN turn%3=1 THEN ceil(length(content)/4.0)::BIGINT ELSE 1 END AS tokens, CASE WHEN turn%3=0 AND turn>0 THEN 'explicit' WHEN turn%3=1 THEN 'estimate' ELSE 'lower_bound' END AS signal FROM t) SELECT role, signal, count(*) AS n, sum(tokens)::BIGINT AS tokens, round(avg(tokens),6) AS mean_tokens FROM r GROUP BY ALL",
    "A12_A13_A14_usage": f"WITH {S} SELECT event_type, count(*) AS calls, round(CASE WHEN sum(value)>0 THEN sum(value) ELSE count(*) END,3) AS total, round(sum(greatest(reward,0)),3) AS gained, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1",
    "A16_counter_difference": f"WITH {S}, c AS (SELECT key, nullif(count(*) FILTER (event_type='click'),0) AS c, nullif(count(*) FILTER (event_type='view'),0) AS v, nullif(count(*) FILTER (event_type='purchase'),0) AS p FROM s GROUP BY 1) SELECT key, c-1 AS d_click, v AS d_view, p AS d_purchase FROM c",
    "A17_session_scores": f"WITH {S} SELECT key, count(*) AS sessions, round(avg(success::INT),6) AS progress, bool_and(success) AS all_correct, arg_max(success, seq) AS last_correct FROM s GROUP BY 1",
    "A18_A19_phase_report": f"WITH {S}, r AS (SELECT CASE WHEN seq<40 THEN 'train' ELSE 'test' END AS phase, unnest([event_type,'all']) AS kind, success, seq FROM s) SELECT phase, kind, count(*) AS n, count(*) FILTER (success) AS successes, round(avg(success::INT),6) AS rate, round(avg(seq),6) AS mean_steps FROM r GROUP BY ALL",
    "A20_F12_U10_shared_tokens": f"WITH {T}, n AS (SELECT conv_id AS grp, count(DISTINCT turn) AS prompts FROM t GROUP BY 1), e AS (SELECT grp, id, token, count(*) AS k FROM (SELECT conv_id AS grp, turn AS id, unnest(list_filter(regexp_split_to_array(content,'[\\s\\p{{Z}}]+'), lambda x: x<>'')) AS token FROM t) GROUP BY ALL), h AS (SELECT grp, token, count(*) AS held, min(k) AS least FROM e GROUP BY ALL) SELECT n.grp, any_value(prompts) AS prompts, coalesce(sum(least),0)::BIGINT AS tokens FROM n LEFT JOIN h ON h.grp=n.grp AND held=prompts GROUP BY n.grp",
    "A22_G04_speakers": f"WITH {T} SELECT conv_id, role, count(*) AS turns FROM t GROUP BY ALL",
    "A23_first_last": f"WITH {T} SELECT role, md5(arg_min(content, conv_id*100000+turn)) AS first, md5(arg_max(content, conv_id*100000+turn)) AS last FROM t GROUP BY 1",
    "A26_matched_bonus": f"WITH {_X13} SELECT query_id, round(least(0.2::DOUBLE, 0.2::DOUBLE*recall_5),6) AS bonus FROM m",
}
