"""Queries of the search loop and its variants, question patterns, bounded expansion, stored memories, reports, judges and prompts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.functions import answers, models, prompts, reports, text as X
from quarry.operators import chunking, evaluation, loop, methods, plan as P, retrieval, search as L
from quarry.plans import adapt, configs, q_plan, q_retrieval
from quarry.plans.adapt import Q, S, T, U, WORDS, stopped, top
from quarry.sources import registry, stores, tables

K = 10

# The loop.

QUESTION = "which text calls a person an idiot"
FIRST = {
    "queries": ["moron"],
    "use_dump": True,
    "aggregate_ops": [{"op": "count", "args": ["idiot"]}, {"op": "union", "args": ["clown", "moron"]}, {"op": "intersect", "args": ["clown", "moron"]}, {"op": "temporal_sort"}],
    "graph_queries": [{"template": "keyword_search", "args": {"keyword": "tion"}}],
    "top_k": 5,
}
MORE = {"queries": ["clown"], "filters": ["th"], "top_k": 5}


def _planner(question: str, hint: str) -> dict:
    return MORE if hint else FIRST


def _judge():
    """A stand-in: content when asked for the second time."""
    asked = []

    def told(question: str, seen: str) -> dict:
        asked.append(seen)
        return {"sufficient": len(asked) > 1, "why_more": "a clown"}

    return told


def _dated(spark, sf):
    """Documents, some of which begin with a date."""
    u = adapt.units(spark, sf)
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("id") * 7 % 300).cast("int")), "yyyy-MM-dd")
    return u.select("id", F.when(F.col("id") % 2 == 0, F.concat(day, F.lit("\n"), F.col("content"))).otherwise(F.col("content")).alias("content"))


def _loop(spark, sf, variant: str, scans: dict | None = None):
    found = L.search(_dated(spark, sf), QUESTION, _planner, _judge(), L.VARIANTS[variant], graph=q_plan._graph(spark, sf), dump=lambda records, q: f"{records.count()} records", scans=scans)
    told = F.when(F.col("kind") == "graph", "").when(F.col("kind") == "record", F.size("matches").cast("string")).otherwise(F.array_join("matches", "|"))
    return found.select("round", "stage", "kind", "id", F.round("score", 4).alias("score"), told.alias("told"))


def q04(spark, sf):
    return _loop(spark, sf, "full")


def q06(spark, sf):
    scans: dict = {}  # the variants' plans are the same
    parts = [_loop(spark, sf, v, scans).select(F.lit(v).alias("variant"), "round", "stage", "kind", "id") for v in ("u1", "single", "nograph")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _long_words(question: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]{6,}", question.lower())))


def _planners(questions: list[str], hints: list[str]) -> list[dict]:
    """A stand-in: a question's first long word, or the hint, with sets over the first two."""
    plans = []
    for question, hint in zip(questions, hints, strict=True):
        w = _long_words(question)
        operations = [{"op": op, "args": w[:2]} for op in ("count", "union", "intersect")] + [{"op": "temporal_sort"}]
        plans.append({"queries": [hint] if hint else w[:1], "aggregate_ops": operations, "top_k": 5})
    return plans


def _judges(questions: list[str], contexts: list[str]) -> list[dict]:
    """A stand-in: content with an even number of long words, else asking for the last of them."""
    return [{"sufficient": len(_long_words(q)) % 2 == 0, "why_more": _long_words(q)[-1:] and _long_words(q)[-1]} for q in questions]


def q03(spark, sf):
    """All passages as questions of one loop."""
    found = loop.search_all(_dated(spark, sf), adapt.questions(spark, sf).withColumnRenamed("query", "question"), _planners, _judges, L.VARIANTS["oneretry"])
    told = F.when(F.col("kind") == "record", F.array_join("matches", "\n")).otherwise(F.array_join("matches", "|"))
    return found.select("query_id", "round", "stage", "at", "kind", "id", "score", F.md5(told).alias("told"))


def r18(spark, sf):
    """A plan whose filter nothing passes: the question itself ranks."""
    plan = P.SearchPlan.of({"queries": ["moron", "worthless"], "filters": ["qqqzzz"], "top_k": K})
    return P.execute(adapt.units(spark, sf), plan, QUESTION).select("id", "score", F.size("matches").alias("matches"), "rank")


_STATEMENTS = ("MATCH (n) RETURN n.id", "MATCH (n) SET n.x = 1 RETURN n", "load csv from 'f' as r return r", "MATCH (n) WHERE n.text CONTAINS 'load' RETURN n", "SHOW INDEXES", "  ", "match (a)-[r]->(b) return r limit 5", "MATCH (n) DETACH DELETE n", "RETURN created_at", "CALL db.labels() YIELD label RETURN label")


def p14(spark, sf):
    e = adapt.table(spark, sf, "events")
    said = F.get(F.array(*map(F.lit, _STATEMENTS)), (F.col("event_id") % len(_STATEMENTS)).cast("int"))
    return e.select("event_id", P.read_only(said).alias("allowed"))


def _asked(spark, sf):
    """Whole passages with steps, a range and a phrase after them."""
    b = adapt.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("plain"))
    end = F.concat(F.lit(' from step 3 to step '), (3 + F.col("query_id") % 35).cast("string"), F.lit(" and turn "), (F.col("query_id") % 40).cast("string"), F.lit(' in "the plot"'))
    return b.withColumn("query", F.concat("plain", end))


def x21(spark, sf):
    q = _asked(spark, sf)
    asked = L.grep_queries(F.col("plain"), F.array(F.lit("moron")))
    numbers = F.transform(F.array_sort(L.anchors(F.col("query"))), lambda n: n.cast("string"))
    return q.select("query_id", F.md5(F.array_join(L.fallback_queries(F.col("query")), " # ")).alias("fallback"), F.array_join(numbers, ",").alias("anchors"), F.size(asked).cast("long").alias("patterns"), F.md5(F.array_join(F.array_sort(asked), " # ")).alias("digest"))


def p16(spark, sf):
    """Questions of a long-range task and of another, and the even read of conversations that a broad one gets."""
    t = adapt.turns(spark, sf)
    task = F.when(F.col("turn") % 2 == 0, "Category: LRU").otherwise("category: other")
    asked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Please WRITE A SUMMARY of "), "role")).otherwise(F.col("role"))
    broad = t.select("conv_id", "turn", L.is_broad(task, asked).alias("broad"))
    read = L.stratified(t.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq")), 4).select(F.col("key").alias("conv_id"), F.col("seq").alias("turn"), "rank", "score")
    return broad.join(read, ["conv_id", "turn"], "left")


def r29(spark, sf):
    """Neighbours of every fiftieth customer by number: one to three hops, twelve nodes at most."""
    c = adapt.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    n = F.col("node")
    adjacency = c.select("node", F.posexplode(F.array((n * 2) % 1000, (n * 3 + 1) % 1000, (n + 7) % 1000)).alias("pos", "neighbour"))
    asked = c.where("node % 50 = 0")
    seeds = asked.select(F.col("node").alias("query_id"), F.posexplode(F.array(n, n + 1, n + 2)).alias("pos", "node"))
    details = asked.select(F.col("node").alias("query_id"), F.concat(F.lit("neighbours within "), ((n / 50).cast("int") % 6).cast("string"), F.lit(" hops")).alias("detail"))
    return P.bounded_expand(adjacency, seeds, details, 12)


# Stored memories and sources.


def s25(spark, sf):
    """Embeddings added, some added again, some deleted; then searched."""
    e = adapt.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("content"), F.col("embedding").alias("vector"))
    store = stores.VectorStore(spark, stores.shared_folder(spark, "vectors"))
    store.add(e)
    store.add(e.where("id % 7 = 0").select("id", F.lit("again").alias("content"), F.transform("vector", lambda x: -x).alias("vector")))
    store.delete(e.where("id % 11 = 0").select("id"))
    return store.search(e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 5)


def u02(spark, sf):
    """The records of a store after adds, deletes and a compaction, and one by its id."""
    c = adapt.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("content"))
    store = stores.VectorStore(spark, stores.shared_folder(spark, "records"))
    store.add(c.where("id % 3 <> 0"))
    store.delete(c.where("id % 4 = 0").select("id"))
    store.compact()
    store.add(c.where("id % 12 = 0").withColumn("meta", F.lit('{"k": 1}')))
    return store.get(c.select("id")).select("id", "content", F.get_json_object("meta", "$.k").cast("int").alias("k"))


def i32(spark, sf):
    """Embeddings of half the records, then of all: the stored ones are used again."""
    u = adapt.units(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("source")).alias("compact"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("lang")).alias("title"), "content")
    path = stores.shared_folder(spark, "embedded")
    stores.embedded(u.where("id % 2 = 0"), path)
    found = stores.embedded(u, path)
    return found.select("id", "key", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def u05(spark, sf):
    b = adapt.questions(spark, sf)
    return models.embed(b, "query", models.hashed_embedding).select("query_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def s01(spark, sf):
    """Customers as JSON lines, more appended, bad lines beside them: read leniently, and the whole ones strictly."""
    path, bad = stores.shared_folder(spark, "lines"), stores.shared_folder(spark, "bad")
    c = adapt.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    kind = "c_custkey long, c_name string, c_mktsegment string"
    tables.write_json_lines(c.where("c_custkey % 2 = 0"), path)
    tables.write_json_lines(c.where("c_custkey % 2 = 1"), path, append=True)
    c.where("c_custkey % 5 = 0").select(F.concat(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise("} broken {")).alias("value")).write.text(bad)
    strict = tables.json_lines(spark, path, kind).withColumn("how", F.lit("strict"))
    lenient = tables.json_lines(spark, bad, kind, strict=False).where("c_custkey is not null").withColumn("how", F.lit("lenient"))
    return strict.unionByName(lenient)


def s05(spark, sf):
    """A named source read from JSON lines and from Parquet, each a domain of it."""
    c = adapt.table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("domain"))
    lines, parquet = stores.shared_folder(spark, "source"), stores.shared_folder(spark, "source")
    c.write.json(lines)
    c.write.parquet(parquet)
    known = registry.Sources()
    known.register(registry.Source("Customers", registry.any_format("c_custkey long, c_name string, domain string"), category="trade"), "buyers")
    return known.read("customers", spark, lines, "BUILDING").unionByName(known.read(" BUYERS ", spark, parquet, "MACHINERY"))


def s29(spark, sf):
    u = adapt.units(spark, sf).select("id", F.concat_ws("-", "source", "lang").alias("title"), "content")
    t = adapt.turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "content")
    path = stores.shared_folder(spark, "store")
    stores.persist_store(u, t, path)
    return stores.restore_store(spark, path).select("kind", "id", "title", F.md5("content").alias("digest"))


def u01(spark, sf):
    """A method: plain units, shared terms over three times as many filtered by language and a predicate, answers from the contexts."""
    built = methods.Method(lambda d: d, methods.Filtered(retrieval.term_sets, {"lang": "en"}, lambda hits: F.col("id") % 3 != 0), k=3)
    index = built.build(adapt.units(spark, sf))
    return built.answer(index, adapt.questions(spark, sf)).select("query_id", F.md5("answer").alias("answer"))


# Reports, replies, judges, prompts.


def _reports(spark, sf):
    """Steps written as Markdown reports."""
    e = adapt.steps(spark, sf).where("seq < 6")
    n, kind, seq = F.round("value").cast("int").cast("string"), F.col("event_type"), F.col("seq").cast("string")
    lines = F.concat_ws(
        "\n",
        F.lit("# OBJECTIVES"), F.concat(F.lit("1. "), kind, F.lit(": first at "), seq), F.lit("2. pay: in full: today"), F.lit("a note"), F.lit("3. : nameless"),
        F.lit("# STATE_CHANGES"), F.concat(F.lit("env_changed: "), F.when(F.col("seq") % 2 == 0, "True").otherwise("false")), F.lit("evidence:"), F.concat(F.lit('- "value '), n, F.lit('"')), F.lit("-"), F.concat(F.lit("- 'kind "), kind, F.lit("'")), F.lit("end"), F.lit("- late"),
        F.lit("# STATES"), F.lit("env_state:"), F.concat(F.lit("- value: "), n), F.lit("- bare"), F.lit("object_states:"), F.lit("- name: cart"), F.lit("- early: 1"), F.lit("state:"), F.concat(F.lit("  - kind: "), kind), F.lit("- name: till"), F.lit("state:"), F.concat(F.lit("- open: a:"), seq), F.lit("- : none"),
    )
    return e.select("key", "seq", lines.alias("report"))


def i27(spark, sf):
    r = _reports(spark, sf).select("key", "seq", reports.parsed(F.col("report")).alias("r"))
    pairs = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return r.select(
        "key", "seq", F.array_join(F.transform("r.objectives", lambda o: F.concat(o["name"], F.lit("="), o["description"])), ";").alias("objectives"),
        "r.env_changed", "r.objective_changed", F.array_join("r.evidence", ";").alias("evidence"), pairs(F.col("r.env")).alias("env"),
        F.array_join(F.transform("r.objects", lambda o: F.concat(o["name"], F.lit("["), pairs(o["state"]), F.lit("]"))), ";").alias("objects"),
    )


def i27_inventory(spark, sf):
    return reports.inventory(_reports(spark, sf))


def x26(spark, sf):
    """Nested JSON in replies: bare, fenced, in prose, cut off; and an array after a marker, with brackets in its strings."""
    t = adapt.turns(spark, sf)
    inner = F.to_json(F.struct(F.col("turn").alias("t"), F.struct(F.col("role").alias("who"), F.array(F.lit("[x"), F.col("role")).alias("l")).alias("o")))
    n = F.col("turn") % 5
    said = F.when(n == 0, inner).when(n == 1, F.concat(F.lit("so\n```JSON\n"), inner, F.lit("\n``` {"))).when(n == 2, F.concat(F.lit("I say "), inner, F.lit(" and that's it"))).when(n == 3, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(F.concat(F.lit("```json\n{\n``` "), inner))
    graph = F.concat(F.lit("first **Causal_Graph** then [["), inner, F.lit(', "]"], []] and [more'))
    array = answers.marked_array(graph, "**CAUSAL_GRAPH**")
    found = answers.json_value(said)
    return t.select("conv_id", "turn", F.get_json_object(found, "$.o.l[1]").alias("last"), F.get_json_object(found, "$.t").try_cast("int").alias("t"), F.get_json_object(array, "$[0][0].o.who").alias("who"), F.get_json_object(array, "$[0][1]").alias("bracket"))


def x14(spark, sf):
    """Identifiers, exact answers and plans judged against gold that differs for some."""
    p = adapt.dealt(adapt.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey")
    k, own = F.col("p_partkey"), answers.synthetic_id(F.col("p_name"))
    said = F.when(k % 4 == 0, F.concat(F.lit("buy "), F.lower(own))).when(k % 4 == 1, F.concat(F.lit("buy "), answers.synthetic_id(F.col("p_type")), F.lit(" or "), own)).otherwise(F.concat(F.lit("buy "), own, F.lit(" now")))
    asin = answers.identifier(said)
    gold = F.concat(F.lit("Because.\n**Exact Answer**: "), F.col("p_type"), F.lit("\nConfidence: 90%"))
    reply = F.when(k % 4 == 0, F.concat(F.lit("Exact Answer:  "), F.lower("p_type"))).when(k % 4 == 1, F.concat(F.lit("Answer: "), F.col("p_type"), F.lit(" Confidence: low"))).when(k % 4 == 2, F.concat(F.lit("it is "), F.col("p_name"), F.lit("\nnot known"))).otherwise(F.concat(F.lit("a long\ntext says "), F.col("p_type")))
    plan = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.array(F.col("p_type"), F.lit("-"), F.lit("")).alias("days")).alias("in"), F.col("p_size").alias("size")))
    recall = answers.leaf_recall(F.concat(F.lit("Plan:  "), F.upper("p_name"), F.when(k % 2 == 0, F.concat(F.lit(" with "), F.col("p_brand"))).otherwise("")), plan)
    return p.select("p_partkey", asin.alias("asin"), F.coalesce(asin == own, F.lit(False)).alias("bought"), answers.exact_answer(reply).alias("exact"), answers.progressive_correct(reply, gold).alias("correct"), answers.holds_gold(reply, F.col("p_type")).alias("held"), recall.alias("r")).select("p_partkey", "asin", "bought", "exact", "correct", "held", "r.total", F.round("r.score", 6).alias("score"))


def x16(spark, sf):
    """Replies of both kinds as they are scored."""
    t = adapt.turns(spark, sf)
    n, who = F.col("turn") % 6, F.col("role")
    raw = F.when(n == 0, F.concat(F.lit('<think>no\n</think>```json\nfirst\n\nAnswer: "'), who, F.lit('"\n```'))).when(n == 1, "Cannot determine.").when(n == 2, F.concat(F.lit("It would still be likely, "), who)).when(n == 3, "<think>endless").when(n == 4, F.concat(F.lit("Probably not likely "), who)).otherwise(who)
    category = F.when(n == 5, 5).otherwise(3)
    hop = F.when(n == 0, F.concat(F.lit("Reasoning: x\n### Answer: 'Yes!'"))).when(n == 1, F.concat(F.lit("so\n\nThe answer is "), who, F.lit(". Really"))).when(n == 2, F.concat(F.lit("Final Answer: "), who, F.lit("\nanswer: other\n"))).when(n == 3, "<think>a</think> no answer").when(n == 4, F.concat(F.lit("yes, "), who)).otherwise(F.lit(None).cast("string"))
    return t.select("conv_id", "turn", answers.dialogue_prediction(raw, category, F.lit("Would it?")).alias("dialogue"), answers.hop_prediction(hop).alias("hop"))


def x24(spark, sf):
    t = adapt.turns(spark, sf)
    kind = F.when(F.col("turn") % 3 == 0, "Pick").when(F.col("turn") % 3 == 1, "")
    text = F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.concat(F.lit(" You are in the hall of "), "role", F.lit(".  Look  around Then "), "content"))
    domain = F.when(F.col("turn") % 2 == 0, "WEB").otherwise("Text2SQL")
    return t.select("conv_id", "turn", F.md5(answers.task_description(text, kind)).alias("task"), prompts.domain_kind(kind, domain).alias("kind"), F.md5(prompts.category_query(F.col("role"), F.col("turn") % 6)).alias("hinted"), F.md5(prompts.domain_query(F.col("role"), kind, domain)).alias("hinted_domain"), F.size(prompts.hop_queries(F.col("role"))).alias("hops"))


def x28(spark, sf):
    t = adapt.turns(spark, sf)
    asked = F.concat(F.lit("What did "), "role", F.lit(" say?"))
    return t.select("conv_id", "turn", F.md5(prompts.answer_prompt(asked, F.col("content"), F.col("turn") % 6)).alias("answer"), F.md5(prompts.session_prompt(asked, F.when(F.col("turn") % 2 == 0, asked).otherwise(F.lit("all")), F.lit(" "), F.col("content"), F.lit("web"))).alias("session"))


def a15(spark, sf):
    """Usage maps of customers, with some counters missing or under their other name."""
    c = adapt.table(spark, sf, "customer")
    k = F.col("c_custkey").cast("double")
    build = F.map_filter(F.create_map(F.lit("build_input_tokens"), F.when(k % 2 == 0, k), F.lit("construction_input_tokens"), k * 2, F.lit("build_wallclock_seconds"), k / 10), lambda _, v: v.isNotNull())
    query = F.map_filter(F.create_map(F.lit("prompt_tokens"), F.when(k % 3 == 0, k * 3), F.lit("llm_seconds"), k / 4, F.lit("gpu_util_mean"), F.when(k % 5 == 0, F.lit(0.5))), lambda _, v: v.isNotNull())
    return c.select("c_custkey", evaluation.canonical_usage(build, query).alias("u")).select("c_custkey", "u.*")


# Named pipelines.


def _inputs(spark, sf):
    return adapt.units(spark, sf).select("id", "content"), adapt.questions(spark, sf)


def c6(spark, sf):
    return configs.build("C6")(*_inputs(spark, sf), K)


def c6_state(spark, sf):
    return configs.dual_index(_inputs(spark, sf)[0])[1].select("key", "seq", "n", F.md5("state").alias("digest"))


def c7(spark, sf):
    return configs.build("C7")(*_inputs(spark, sf), K)


def c8(spark, sf):
    return configs.build("C8")(*_inputs(spark, sf), K)


def c9(spark, sf):
    return configs.build("C9")(*_inputs(spark, sf), K)


QUERIES = {
    "Q04_Q03_Q05_F08_A24_search_loop": q04,
    "Q06_T11_loop_variants": q06,
    "Q03_Q04_Q06_set_loop": q03,
    "R18_fallback_ranking": r18,
    "P14_read_only_guard": p14,
    "X21_question_patterns": x21,
    "P16_W11_broad_requests": p16,
    "R29_bounded_expansion": r29,
    "S25_vector_store": s25,
    "U02_T05_record_store": u02,
    "I32_S23_embedding_cache": i32,
    "U05_embedding_callback": u05,
    "S01_S02_S03_S04_json_lines": s01,
    "S05_S11_S19_named_source": s05,
    "S29_persisted_store": s29,
    "U01_U03_U04_method": u01,
    "I27_state_report": i27,
    "I27_objective_inventory": i27_inventory,
    "X26_nested_json": x26,
    "X14_judges": x14,
    "X16_predictions": x16,
    "X24_task_hints": x24,
    "X28_prompts": x28,
    "A15_canonical_usage": a15,
    "I28_U09_C6_causal_reasoner": c6,
    "I28_C6_state_memory": c6_state,
    "I28_U09_C7_concept_hops": c7,
    "U09_C8_entity_ranks": c8,
    "U09_C9_late_interaction": c9,
}

_DATED = "d AS (SELECT doc_id AS id, CASE WHEN doc_id%2=0 THEN strftime(DATE '2024-01-01'+(doc_id*7%300)::INT,'%Y-%m-%d')||chr(10) ELSE '' END||coalesce(text,'') AS content FROM documents)"


def _matched(query: str, question: str, filters: tuple[str, ...] = (), source: str = "r") -> str:
    w = q_plan._terms("'" + f"{query} {question}".replace("'", "''") + "'")
    found = f"list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN regexp_matches(x,'(?i){query}') THEN i||': '||substr(x,1,500) END), lambda x: x IS NOT NULL)[1:5]"
    hay = "CASE WHEN len(m)>0 THEN array_to_string(m, chr(10)) ELSE content END"
    passes = " AND ".join(f"regexp_matches({hay},'(?i){f}')" for f in filters) or "true"
    return f"SELECT id, m, CASE WHEN {passes} THEN len(list_intersect({w}, w))::DOUBLE/greatest(1,len({w})) + 0.15::DOUBLE*len(m) ELSE 0 END AS score FROM (SELECT id, content, w, {found} AS m FROM {source})"


#: What the question asks for beside a plan's queries, written out.
_WIDE = ("text", "calls", "person", "idiot", "text.*calls|calls.*text", "calls.*person|person.*calls", "person.*idiot|idiot.*person", "text|calls|person|idiot")


def _best(plan_query: str, k: int, filters: tuple[str, ...] = ()) -> str:
    hits = " UNION ALL ".join(_matched(q, QUESTION, filters) for q in (plan_query, *_WIDE))
    return f"SELECT id, m, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, m, round(score,4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, m DESC) AS k FROM ({hits}) WHERE score>0) WHERE k=1) QUALIFY rank<={k}"


_LOOP = f"""{_DATED}, r AS (SELECT id, content, {q_plan._terms('content')} AS w FROM d), b0 AS ({_best('moron', 5)}), b1 AS ({_best('clown', 5, ('th',))}),
    un AS (SELECT id FROM d WHERE regexp_matches(content,'(?i)clown|moron')), it AS (SELECT id FROM d WHERE regexp_matches(content,'(?i)clown') AND regexp_matches(content,'(?i)moron')),
    da AS (SELECT b0.id, rank, nullif(regexp_extract(substr(content,1,400),'([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})',1),'') AS day FROM b0 JOIN d USING (id)),
    obs AS (SELECT 0 AS round, 0 AS stage, 'dump' AS kind, 'dump' AS id, 1.0::DOUBLE AS score, (SELECT count(*) FROM d)||' records' AS told
    UNION ALL SELECT 0, 1, 'record', id::VARCHAR, score, len(m)::VARCHAR FROM b0 UNION ALL SELECT 0, 2, 'graph', 'graph_q1', 1.0, ''
    UNION ALL SELECT 0, 3, 'count', 'agg', 1.0, 'count='||(SELECT count(*) FROM d WHERE regexp_matches(content,'(?i)idiot'))
    UNION ALL SELECT 0, 3, 'union', 'agg', 1.0, 'union_ids='||coalesce((SELECT string_agg(id,',' ORDER BY id) FROM (SELECT id FROM un ORDER BY id LIMIT 10)),'none')||'|count='||(SELECT count(*) FROM un)
    UNION ALL SELECT 0, 3, 'intersect', 'agg', 1.0, 'intersect_ids='||coalesce((SELECT string_agg(id,',' ORDER BY id) FROM (SELECT id FROM it ORDER BY id LIMIT 10)),'none')||'|count='||(SELECT count(*) FROM it)
    UNION ALL SELECT 0, 3, 'temporal_sort', 'agg', 1.0, 'order='||string_agg(id,',' ORDER BY day, rank) FROM da WHERE day IS NOT NULL HAVING count(*)>0
    UNION ALL SELECT 1, 1, 'record', id::VARCHAR, score, len(m)::VARCHAR FROM b1)"""
_ESC = "list_transform({0}, lambda x: replace(x,'-','\\-'))"
_SET_LOOP = f"""{_DATED}, r AS (SELECT id, content, {q_plan._terms('content')} AS w FROM d), {Q}, k AS (SELECT query_id, query, list_sort(list_distinct(regexp_extract_all(lower(query),'[a-z0-9]{{6,}}'))) AS x, {q_plan._terms('query')} AS g0 FROM q),
    a AS (SELECT query_id, query, x, g0, 0 AS round, x[1] AS word FROM k UNION ALL SELECT query_id, query, x, g0, 1, x[len(x)] FROM k WHERE len(x)%2=1),
    g AS (SELECT query_id, query, round, word, list_filter(t, lambda x, i: list_position(t, x)=i) AS g FROM (SELECT *, list_filter(regexp_extract_all(lower(query),'[a-z0-9][a-z0-9_''/-]+'), lambda x: list_contains(g0, x)) AS t FROM a)),
    e AS (SELECT *, {_ESC.format('g[1:16]')} AS e FROM g),
    u AS (SELECT DISTINCT query_id, round, query, t.p AS pat, t.a AS a, t.b AS b FROM (SELECT query_id, round, query, unnest(list_concat([struct_pack(p:=word, a:=word, b:=word)], list_transform(g[1:16], lambda x: struct_pack(p:=replace(x,'-','\\-'), a:=x, b:=x)), list_transform(range(1, least(12,len(g)-1)+1), lambda i: struct_pack(p:=e[i]||'.*'||e[i+1]||'|'||e[i+1]||'.*'||e[i], a:=g[i], b:=g[i+1])), CASE WHEN len(g)>0 THEN [struct_pack(p:=array_to_string(e[1:12],'|'), a:='', b:='')] ELSE [] END)) AS t FROM e)),
    h AS MATERIALIZED (SELECT pat, id, list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN (a=b AND a<>'' AND contains(lower(x),a)) OR ((a<>b OR a='') AND contains(lower(x),a) AND contains(lower(x),b) AND regexp_matches(x,'(?i)'||pat)) THEN i||': '||substr(x,1,500) END), lambda x: x IS NOT NULL)[1:5] AS m FROM (SELECT DISTINCT pat, a, b FROM u), (SELECT id, content, lower(content) AS low FROM d) WHERE contains(low,a) AND contains(low,b)),
    wu AS (SELECT DISTINCT query_id, round, pat, list_sort({q_plan._terms("(pat||' '||query)")}) AS w FROM u), wd AS (SELECT DISTINCT w, md5(array_to_string(w,' ')) AS wk FROM wu),
    o AS (SELECT wk, r.id, len(list_intersect(wd.w, r.w))::DOUBLE/greatest(1,len(wd.w)) AS o FROM wd CROSS JOIN r),
    s AS (SELECT query_id, round, o.id, o + 0.15::DOUBLE*len(coalesce(m, [])) AS score, coalesce(m, []) AS m FROM wu JOIN o ON o.wk=md5(array_to_string(wu.w,' ')) LEFT JOIN h ON h.pat=wu.pat AND h.id=o.id AND len(h.m)>0),
    b AS MATERIALIZED (SELECT query_id, round, id, round(score,4) AS score, m, row_number() OVER (PARTITION BY query_id, round ORDER BY round(score,4) DESC, id)::INT AS rank FROM (SELECT * FROM s WHERE score>0 QUALIFY row_number() OVER (PARTITION BY query_id, round, id ORDER BY score DESC, m DESC)=1) QUALIFY rank<=5),
    hit AS (SELECT query_id, id, len(list_filter(x[1:2], lambda y: contains(lower(content), y))) AS n, contains(lower(content), x[1]) AS f, len(x[1:2]) AS z FROM k, d),
    agg AS (SELECT query_id, 0 AS at0, 'count' AS op, 'count='||count_if(f) AS told FROM hit GROUP BY 1
    UNION ALL SELECT query_id, 1, 'union', 'union_ids='||coalesce(array_to_string(list_sort(list(id) FILTER (n>0))[1:10],','),'none')||'|count='||count_if(n>0) FROM hit GROUP BY 1
    UNION ALL SELECT query_id, 2, 'intersect', 'intersect_ids='||coalesce(array_to_string(list_sort(list(id) FILTER (n=z))[1:10],','),'none')||'|count='||count_if(n=z) FROM hit GROUP BY 1
    UNION ALL SELECT query_id, 3, 'temporal_sort', 'order='||string_agg(id, ',' ORDER BY day, rank) FROM (SELECT query_id, b.id, rank, nullif(regexp_extract(substr(content,1,400),'([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})',1),'') AS day FROM b JOIN d USING (id) WHERE round=0) WHERE day IS NOT NULL GROUP BY 1)"""
_FALL = "regexp_extract_all(query,'[A-Za-z0-9][A-Za-z0-9_''/-]+')"
_STOP = "[" + ",".join(f"'{w}'" for w in X.GREP_STOPWORDS) + "]"
_AROUND = "range(greatest({0}-6,0),{0}+7)"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x)=i)"


def _expanded() -> str:
    levels = []
    for k in range(1, 4):
        held = " UNION ALL ".join(f"SELECT query_id, node FROM l{i}" + (" WHERE place<=12" if i == 0 else "") for i in range(k))
        extra = " OR (nth=1 AND held=12)" if k == 1 else ""
        levels.append(
            f"e{k} AS (SELECT l.query_id, a.neighbour AS node, l.depth, min(l.place*10+a.pos) AS first FROM l{k - 1} l JOIN adj a ON a.node=l.node WHERE l.depth>={k} GROUP BY ALL), h{k} AS ({held}), f{k} AS (SELECT e.*, row_number() OVER (PARTITION BY query_id ORDER BY first) AS nth FROM e{k} e WHERE NOT EXISTS (SELECT 1 FROM h{k} h WHERE h.query_id=e.query_id AND h.node=e.node)), "
            f"l{k} AS (SELECT query_id, node, held+nth AS place, depth FROM f{k} JOIN (SELECT query_id, count(*) AS held FROM h{k} GROUP BY 1) USING (query_id) WHERE held+nth<=12{extra})"
        )
    whole = " UNION ALL ".join(f"SELECT query_id, node, place FROM l{i}" + (" WHERE place<=12" if i == 0 else "") for i in range(4))
    return f"WITH c AS (SELECT c_custkey::BIGINT AS node FROM customer), adj AS (SELECT node, 0 AS pos, node*2%1000 AS neighbour FROM c UNION ALL SELECT node, 1, (node*3+1)%1000 FROM c UNION ALL SELECT node, 2, (node+7)%1000 FROM c), l0 AS (SELECT node AS query_id, node+i AS node, i+1 AS place, greatest(1,least(3,(node//50)%6)) AS depth FROM c, (SELECT unnest([0,1,2]) AS i) WHERE c.node%50=0), {', '.join(levels)} SELECT query_id, node, place::INT AS place FROM ({whole})"


_BUCKETS = "array_to_string(list_transform(range(0,16), lambda i: len(list_filter({0}, lambda w: substr(md5(w),2,1)=substr('0123456789abcdef',i+1,1)))),',')"
_SPLIT = "list_filter(regexp_split_to_array(lower({0}),'[\\s\\p{{Z}}]+'), lambda x: x<>'')"
_STEP6 = f"{S}, e AS (SELECT key, seq, event_type AS kind, round(value)::INT AS n FROM s WHERE seq<6)"
_HINT = "trim(role)||chr(10)||chr(10)||'Retrieval hint: '||"
_TRIPLES = "w AS (SELECT id, list_filter(list_transform(string_split(content,'.'), lambda s: list_filter(regexp_split_to_array(s,'[\\s\\p{Z}]+'), lambda x: x<>'')), lambda w: len(w)>=3)[1:15] AS p FROM u0), x AS (SELECT id, generate_subscripts(p,1)-1 AS i, unnest(p) AS w FROM w), u AS (SELECT id*100+i AS id, lower(w[1])||' '||lower(w[2])||' '||lower(w[len(w)]) AS content FROM x UNION ALL SELECT id*100+99, content FROM u0 WHERE id IN (SELECT id FROM w WHERE len(p)=0))"
_CAT = "CASE turn%6 WHEN 2 THEN '{2}' WHEN 3 THEN '{3}' WHEN 5 THEN '{5}' ELSE '{0}' END".format(prompts.CATEGORY_HINT, "", *(prompts.CATEGORY_HINTS.get(k, "") for k in (2, 3, 4, 5)))
_DOM = "CASE WHEN turn%2=0 THEN '{1}' ELSE '{2}' END".format(*(h for _, h in prompts.DOMAIN_HINTS))

ORACLE = {
    "Q04_Q03_Q05_F08_A24_search_loop": f"WITH {_LOOP} SELECT * FROM obs",
    "Q06_T11_loop_variants": f"WITH {_LOOP}, v AS (SELECT unnest(['u1','single','nograph']) AS variant) SELECT variant, round, stage, kind, id FROM v, obs WHERE CASE variant WHEN 'u1' THEN kind<>'dump' WHEN 'single' THEN kind<>'dump' AND round=0 ELSE kind<>'graph' END",
    "Q03_Q04_Q06_set_loop": f"WITH {_SET_LOOP} SELECT query_id, round, 1 AS stage, rank AS at, 'record' AS kind, id::VARCHAR AS id, score, md5(array_to_string(m, chr(10))) AS told FROM b UNION ALL SELECT query_id, 0, 3, at0, op, 'agg', 1.0, md5(told) FROM agg",
    "R18_fallback_ranking": f"WITH {U}, r AS (SELECT id, {q_plan._terms('content')} AS w FROM u), q AS (SELECT {q_plan._terms(chr(39) + QUESTION + chr(39))} AS t) SELECT id, score, 0 AS matches, rank FROM (SELECT id, round(len(list_intersect(t,w))::DOUBLE/len(t),4) AS score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM r, q) WHERE rank<={K}",
    "P14_read_only_guard": "SELECT event_id, event_id%10 IN (0,3,6,8) AS allowed FROM events",
    "X21_question_patterns": f"""WITH b AS (SELECT item_id AS query_id, coalesce(text,'') AS plain, coalesce(text,'')||' from step 3 to step '||(3+item_id%35)||' and turn '||(item_id%40)||' in "the plot"' AS query FROM benchmark),
    f AS (SELECT *, list_filter({_FALL}, lambda t: length(t)>2 AND NOT list_contains({_STOP}, lower(t))) AS t, list_filter(regexp_extract_all(lower(plain),'[a-z0-9][a-z0-9_''/-]+'), lambda x: length(x)>2 AND NOT list_contains({_STOP}, x)) AS g0 FROM b),
    g AS (SELECT *, {_ORDERED.format('g0')} AS g FROM f), p AS (SELECT *, list_concat(['moron'], list_transform(g[1:16], lambda x: replace(x,'-','\\-')), list_transform(range(1, least(12,len(g)-1)+1), lambda i: replace(g[i],'-','\\-')||'.*'||replace(g[i+1],'-','\\-')||'|'||replace(g[i+1],'-','\\-')||'.*'||replace(g[i],'-','\\-')), CASE WHEN len(g)>0 THEN [array_to_string(list_transform(g[1:12], lambda x: replace(x,'-','\\-')),'|')] ELSE [] END) AS a FROM g)
    SELECT query_id, md5(array_to_string(list_concat(['the plot'], t[1:8], [array_to_string(list_transform(t[1:4], lambda x: replace(x,'-','\\-')),'|')])[1:8],' # ')) AS fallback,
    array_to_string(list_sort(list_distinct(list_concat(CASE WHEN query_id%35<=30 THEN range(3,4+query_id%35) ELSE [] END, {_AROUND.format('3')}, {_AROUND.format('(3+query_id%35)')}, {_AROUND.format('(query_id%40)')}))),',') AS anchors, len(list_distinct(a)) AS patterns, md5(array_to_string(list_sort(list_distinct(a)),' # ')) AS digest FROM p""",
    "P16_W11_broad_requests": f"WITH {T}, n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM t), k AS (SELECT DISTINCT conv_id, unnest(CASE WHEN n<=4 THEN range(0,n) ELSE list_transform(range(0,4), lambda i: round_even(i*(n-1)/3.0,0)::BIGINT) END) AS turn FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS rank FROM k) SELECT t.conv_id, t.turn, t.turn%6=0 AS broad, rank::INT AS rank, round(1-0.01::DOUBLE*rank,4) AS score FROM t LEFT JOIN r ON r.conv_id=t.conv_id AND r.turn=t.turn",
    "R29_bounded_expansion": _expanded(),
    "S25_vector_store": f"WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id%7=0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS vector FROM embeddings WHERE vec_id%11<>0), vq AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id%50=0), sc AS (SELECT query_id, id, round(1/(1+list_sum(list_transform(range(1,65), lambda i: (query[i]::DOUBLE-vector[i]::DOUBLE)*(query[i]::DOUBLE-vector[i]::DOUBLE)))),6) AS score FROM v, vq) {top('sc', 5)}",
    "U02_T05_record_store": "SELECT c_custkey::BIGINT AS id, c_name AS content, CASE WHEN c_custkey%12=0 THEN 1 END AS k FROM customer WHERE c_custkey%12=0 OR (c_custkey%3<>0 AND c_custkey%4<>0)",
    "I32_S23_embedding_cache": f"WITH {U}, t AS (SELECT id, CASE WHEN id%3<>0 THEN substr(trim(source||' '||lang),1,1500) ELSE substr(content,1,1500) END AS t FROM u) SELECT id, sha256(t) AS key, {_BUCKETS.format(_SPLIT.format('t'))} AS vector FROM t WHERE t<>''",
    "U05_embedding_callback": f"WITH {Q} SELECT query_id, {_BUCKETS.format(_SPLIT.format('query'))} AS vector FROM q",
    "S01_S02_S03_S04_json_lines": "SELECT c_custkey, c_name, c_mktsegment, 'strict' AS how FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'lenient' FROM customer WHERE c_custkey%10=0",
    "S05_S11_S19_named_source": "SELECT c_custkey, c_name, c_mktsegment AS domain FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY')",
    "S29_persisted_store": f"WITH {U}, {T} SELECT 'record' AS kind, id, source||'-'||lang AS title, md5(content) AS digest FROM u UNION ALL SELECT 'history', seq, NULL, md5(content) FROM (SELECT conv_id*1000+turn AS seq, content FROM t ORDER BY seq DESC LIMIT 200)",
    "U01_U03_U04_method": f"WITH {U}, {Q}, {q_retrieval._R23}, w AS ({top('sc23', 9)}), f AS (SELECT query_id, w.id, score, content FROM w JOIN u ON u.id=w.id WHERE lang='en' AND w.id%3<>0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM f), c AS (SELECT query_id, string_agg(content, chr(10)||chr(10) ORDER BY k) AS c FROM r WHERE k<=3 GROUP BY 1) SELECT query_id, md5(trim(string_split(c,'.')[1], chr(10)||chr(9)||chr(13)||' ')) AS answer FROM c",
    "I27_state_report": f"WITH {_STEP6} SELECT key, seq::INT AS seq, kind||'=first at '||seq||';pay=in full: today' AS objectives, seq%2=0 AS env_changed, false AS objective_changed, 'value '||n||';kind '||kind AS evidence, 'value='||n||';bare=' AS env, 'cart[kind='||kind||'];till[open=a:'||seq||']' AS objects FROM e",
    "I27_objective_inventory": f"WITH {_STEP6}, f AS (SELECT key, kind AS name, min(seq)*10 AS place, 'first at '||min(seq) AS description FROM e GROUP BY ALL UNION ALL SELECT key, 'pay', min(seq)*10+1, 'in full: today' FROM e GROUP BY key) SELECT key, row_number() OVER (PARTITION BY key ORDER BY place)::INT AS place, name, description FROM f",
    "X26_nested_json": f"WITH {T} SELECT conv_id, turn, CASE WHEN turn%5<3 THEN role END AS last, CASE WHEN turn%5<3 THEN turn::INT END AS t, role AS who, ']' AS bracket FROM t",
    "X14_judges": "WITH p AS (SELECT *, 'B'||upper(substr(sha1(p_name),1,9)) AS a, 'B'||upper(substr(sha1(p_type),1,9)) AS b FROM part) SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN NULL WHEN 1 THEN b ELSE a END AS asin, CASE p_partkey%4 WHEN 0 THEN false WHEN 1 THEN a=b ELSE true END AS bought, CASE p_partkey%4 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type END AS exact, p_partkey%4<>2 OR contains(lower(p_name),lower(p_type)) AS correct, p_partkey%4<>2 OR contains(lower(p_name),lower(p_type)) AS held, 4 AS total, round(((1+(p_partkey%2=0)::INT)+(CASE WHEN contains(lower('Plan: '||p_name||CASE WHEN p_partkey%2=0 THEN ' with '||p_brand ELSE '' END), lower(p_type)) THEN 1 ELSE 0 END)+(CASE WHEN contains(lower('Plan: '||p_name||CASE WHEN p_partkey%2=0 THEN ' with '||p_brand ELSE '' END), p_size::VARCHAR) THEN 1 ELSE 0 END))/4.0::DOUBLE,6) AS score FROM p",
    "X16_predictions": f"WITH {T} SELECT conv_id, turn, CASE turn%6 WHEN 0 THEN role WHEN 1 THEN 'Not mentioned in the conversation' WHEN 2 THEN 'Likely yes' WHEN 3 THEN '' WHEN 4 THEN 'Probably not likely '||role ELSE 'Not mentioned in the conversation' END AS dialogue, CASE turn%6 WHEN 0 THEN 'yes' WHEN 1 THEN role WHEN 2 THEN role WHEN 3 THEN 'noanswer' WHEN 4 THEN role ELSE '' END AS hop FROM t",
    "X24_task_hints": f"WITH {T}, k AS (SELECT *, CASE turn%3 WHEN 0 THEN 'pick | ' ELSE '' END AS p, trim(regexp_replace(lower(content),'\\s+',' ','g')) AS c FROM t) SELECT conv_id, turn, md5(CASE WHEN turn%4=3 THEN CASE WHEN turn%3=0 THEN 'Pick' ELSE '' END ELSE p||trim(regexp_replace(regexp_replace(regexp_replace(lower('Look  around Then '||content),'\\s+',' ','g'),'you are in the [^.]+\\.\\s*','','g'),'\\blook around\\b','','g')) END) AS task, CASE WHEN turn%2=0 THEN 'web' ELSE 'sql' END AS kind, md5({_HINT}{_CAT}) AS hinted, md5({_HINT}{_DOM}) AS hinted_domain, 3 AS hops FROM k",
    "X28_prompts": f"WITH {T}, k AS (SELECT *, chr(10)||chr(10) AS b, 'What did '||role||' say?' AS q FROM t) SELECT conv_id, turn, md5(CASE turn%6 WHEN 5 THEN 'Reply exactly: Not mentioned in the conversation.' WHEN 3 THEN 'Infer the likeliest answer from the snippets; don''t abstain. A yes/no question is answered Likely yes or Likely no where it isn''t certain.' ELSE 'Answer shortly from the snippets. Only without any evidence reply exactly: Not mentioned in the conversation.' END||b||'Memory snippets:'||chr(10)||content||b||'Question: '||q||b||CASE WHEN turn%6=2 THEN 'Give dates or the order of events where possible.'||chr(10) ELSE '' END||'Return only the answer.') AS answer, md5('Domain: web'||b||CASE WHEN turn%2=1 THEN 'Whole task:'||chr(10)||'all'||b ELSE '' END||'Background:'||chr(10)||'None'||b||'Memory of earlier sessions:'||chr(10)||CASE WHEN trim(regexp_replace(content,'\\s+',' ','g'))='' THEN 'None (first session).' ELSE regexp_replace(content,'^\\s+|\\s+$','','g') END||b||'Task:'||chr(10)||q||b||'Return only the final answer.') AS session FROM k",
    "A15_canonical_usage": "SELECT c_custkey, CASE WHEN c_custkey%2=0 THEN c_custkey ELSE c_custkey*2 END::BIGINT AS t_build_input, 0::BIGINT AS t_build_output, CASE WHEN c_custkey%3=0 THEN c_custkey*3 ELSE 0 END::BIGINT AS t_query_input, 0::BIGINT AS t_query_output, c_custkey/4.0::DOUBLE AS w_llm, 0.0::DOUBLE AS w_tool, c_custkey/10.0::DOUBLE AS w_llm_build, CASE WHEN c_custkey%5=0 THEN 0.5::DOUBLE END AS gpu_util_mean FROM customer",
    "I28_U09_C6_causal_reasoner": f"WITH {q_retrieval._bm25_sql(q_retrieval._BM, True).replace(U, U.replace('u AS', 'u0 AS') + ', ' + _TRIPLES)}, h AS ({top('sc', K)}) SELECT query_id, id, round(1.0::DOUBLE/rank,6) AS score, rank FROM h",
    "I28_C6_state_memory": f"WITH {U}, s AS (SELECT id AS key, list_filter(string_split(content,'.'), lambda x: trim(x)<>'') AS p FROM u), x AS (SELECT key, len(p) AS k, p, unnest(range(1,len(p)+1)) AS n FROM s) SELECT key, (n-1)::INT AS seq, n::INT AS n, md5(right(array_to_string(p[1:n],chr(10)),4000)) AS digest FROM x WHERE n%3=0 OR n=k",
    "I28_U09_C7_concept_hops": f"WITH {U}, {Q}, s AS (SELECT id, list_filter(list_transform(string_split(content,'.'), lambda x: trim(x)), lambda x: x<>'')[1:10] AS p, content FROM u), p AS (SELECT id*100+unnest(range(0,greatest(len(p),1))) AS id, unnest(CASE WHEN len(p)>0 THEN p ELSE [content] END) AS content FROM s), c AS (SELECT DISTINCT id, unnest(list_filter({stopped(WORDS.format('content'), X.BM25_STOPWORDS)}, lambda x: length(x)>=4)) AS concept FROM p), n AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS concept FROM q), sd AS (SELECT query_id, concept FROM n WHERE concept IN (SELECT concept FROM c) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY concept)<=5), h0 AS (SELECT DISTINCT query_id, id FROM sd JOIN c USING (concept)), c1 AS (SELECT DISTINCT query_id, concept FROM h0 JOIN c USING (id) WHERE (query_id, concept) NOT IN (SELECT query_id, concept FROM sd)), h1 AS (SELECT DISTINCT query_id, id FROM c1 JOIN c USING (concept)), sc AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, 1.0::DOUBLE AS score FROM h0 UNION ALL SELECT query_id, id, 0.5::DOUBLE FROM h1) GROUP BY ALL) {top('sc', K)}",
    "U09_C9_late_interaction": f"WITH {U}, {Q}, w AS (SELECT id, list_filter(regexp_split_to_array(content,'[\\s\\p{{Z}}]+'), lambda x: x<>'') AS words FROM u), k AS (SELECT id, words, unnest(range(0, greatest(len(words),1), 224)) AS start FROM w), ch AS (SELECT id*100000+start//224 AS id, list_distinct(list_transform(words[start+1:start+256], lambda x: substr(md5(lower(x)),2,1))) AS b FROM k), qw AS (SELECT query_id, list_transform(({_SPLIT.format('query')})[1:32], lambda x: substr(md5(x),2,1)) AS t FROM q), sc AS (SELECT query_id, id, len(list_filter(t, lambda x: list_contains(b,x)))::DOUBLE AS score FROM ch, qw WHERE len(b)>0) {top('sc', K)}",
}
