"""Worked examples and edge rows of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import models, scores
from quarry.functions import text as X
from quarry.operators import chunking, evaluation, plan, ranking, windows
from quarry.sources import tables
from quarry.streaming import sessions


def one(df):
    return df.collect()[0][0]


def test_chunks_without_early_stop(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefghij")), (2, "")], "id long, content string")
    got = [(r["id"], r["start"], r["end"]) for r in chunking.token_chunks(docs, 4, 1).orderBy("id", "chunk").collect()]
    assert got == [(1, 0, 4), (1, 3, 7), (1, 6, 10), (1, 9, 10), (2, 0, 0)]
    early = [(r["start"], r["end"]) for r in chunking.token_chunks(docs.where("id = 1"), 4, 1, stop_early=True).orderBy("chunk").collect()]
    assert early == [(0, 4), (3, 7), (6, 10)]


def test_packer_cuts_long_blocks(spark):
    blocks = F.array(*map(F.lit, ["aa", "bb", "c" * 7, "d"]))
    assert one(spark.range(1).select(chunking.pack_blocks(blocks, 6))) == ["aa\n\nbb", "cccccc", "c", "d"]


def test_reciprocal_rank_fusion(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id int, id string, rank int")
    got = {r["id"]: (r["score"], r["rank"]) for r in ranking.reciprocal_rank_fusion([(a, 0.5), (b, 0.5)], 3, ["query_id"]).collect()}
    assert [k for k, v in sorted(got.items(), key=lambda x: x[1][1])] == ["b", "a", "c"]
    assert got["b"][0] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-8)
    swapped = ranking.reciprocal_rank_fusion([(b, 0.5), (a, 0.5)], 3, ["query_id"])
    assert {r["id"]: (r["score"], r["rank"]) for r in swapped.collect()} == got


def test_constant_list_counts_nothing(spark):
    d = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0)], "query_id int, id int, score double")
    assert {r["score"] for r in ranking.linear_fusion([(d, 1.0)], 2, ["query_id"]).collect()} == {0.0}


def test_answer_scores(spark):
    row = spark.range(1).select(X.answer_words(F.lit("the cat sat")).alias("a"), X.answer_words(F.lit("cat sat down")).alias("b"))
    assert one(row.select(scores.token_f1(F.col("a"), F.col("b")))) == pytest.approx(0.8)
    row = spark.range(1).select(X.answer_words(F.lit("a b c d")).alias("a"), X.answer_words(F.lit("b d")).alias("b"))
    assert one(row.select(scores.rouge_l(F.col("a"), F.col("b")))) == pytest.approx(0.8)
    same = spark.range(1).select(F.array(F.lit("x"), F.lit("x"), F.lit("y")).alias("a"), F.array(F.lit("x"), F.lit("y"), F.lit("y")).alias("b"))
    assert one(same.select(scores.overlap(F.col("a"), F.col("b")))) == 2
    assert one(same.select(scores.bleu(F.col("a"), F.col("b"), 1))) == pytest.approx(2.1 / 3.1)


def test_ndcg(spark):
    ranked = spark.createDataFrame([(0, "x", 1), (0, "g1", 2), (0, "g2", 3)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(0, "g1"), (0, "g2")], "query_id int, id string")
    r = evaluation.ranking_metrics(ranked, gold, (3,)).first()
    assert r["ndcg_3"] == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert (r["recall_3"], r["precision_3"]) == (1.0, pytest.approx(0.666667))


def test_quartiles_and_spread(spark):
    rows = spark.createDataFrame([(i, "g", i) for i in range(6)], "id int, grp string, length int")
    assert [r["quartile"] for r in windows.length_quartile(rows, "grp").orderBy("id").collect()] == [0, 0, 1, 2, 2, 3]
    seq = spark.createDataFrame([(1, i) for i in range(6)], "key int, seq long")
    assert sorted(r["seq"] for r in windows.spread(seq, 3).collect()) == [0, 2, 5]


def test_utility_fold_and_prefixes(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, -1.0)], "key int, seq int, reward double")
    assert sessions.utilities(rows).first()["q"] == pytest.approx(-0.09)
    prompts = spark.createDataFrame([(1, 0, ["1", "2", "3"]), (1, 1, ["1", "2", "4", "3"])], "grp int, id int, tokens array<string>")
    assert evaluation.common_prefix(prompts).first()["tokens"] == 2
    assert evaluation.shared_tokens(prompts).first()["tokens"] == 3


def test_degenerate_spread_counts_as_one(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(1, 5.0)], "k int, v double")
    assert one(rows.select(ranking.standard_score(F.col("v"), Window.partitionBy("k")))) == 0.0


def test_multi_hop(spark):
    links = spark.createDataFrame([("A", "p1"), ("A", "p2"), ("B", "p2"), ("B", "p3")], "concept string, id string")
    seeds = spark.createDataFrame([(0, "A")], "query_id int, concept string")
    assert {r["id"]: r["score"] for r in plan.multi_hop(links, seeds, 2).collect()} == {"p1": 1.0, "p2": 1.0, "p3": 0.5}


def test_patterns_and_plans(spark):
    rows = spark.createDataFrame([(1, "call a( now"), (2, None), (3, "")], "id int, content string")
    assert [r["id"] for r in rows.where(F.col("content").rlike(plan.safe_pattern("a("))).collect()] == [1]
    assert rows.where(F.col("content").rlike(plan.safe_pattern(""))).count() == 0
    p = plan.SearchPlan.of({"queries": [str(i) for i in range(20)] + ["1"], "filters": list("abcdefgh"), "graph_queries": [{"template": "drop_all"}]})
    assert (len(p.queries), len(p.filters), p.graph_queries) == (8, 6, [])
    said = ["MATCH (n) RETURN n", "MATCH (n) DELETE n", "MATCH (n) WHERE n.x = 'load' RETURN n", "load  csv from 'x' return 1", "SHOW x", " ", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in said], "q string").select(plan.read_only(F.col("q"))).collect()] == [True, False, True, False, False, False, False]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in tables.json_lines(spark, str(tmp_path / "a.jsonl"), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        tables.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    tables.write_json_lines(spark.createDataFrame([(3,)], "a int"), str(tmp_path / "out"))
    tables.write_json_lines(spark.createDataFrame([(4,)], "a int"), str(tmp_path / "out"), append=True)
    assert sorted(r["a"] for r in tables.json_lines(spark, str(tmp_path / "out"), "a int").collect()) == [3, 4]


def test_models(spark):
    rows = spark.createDataFrame([(1, "One. Two."), (2, None)], "id int, text string")
    assert {r["id"]: r["answer"] for r in models.generate(rows, "text", models.first_sentence).collect()} == {1: "One", 2: ""}
    assert {len(r["embedding"]) for r in models.embed(rows, "text", models.hashed_embedding).collect()} == {16}


def test_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # the stateful processor's server needs it
    rows = spark.createDataFrame([(k, s, float((k * s) % 3 - 1)) for k in range(4) for s in range(5)], "key long, seq int, reward double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = sessions.stream_utilities(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("utilities").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["key"]: r["q"] for r in spark.table("utilities").collect()}
    assert got == {r["key"]: r["q"] for r in sessions.utilities(rows).collect()}


def test_quotas_fill_evenly(spark):
    rows = spark.createDataFrame([(g, i) for g, n in (("a", 2), ("b", 10), ("c", 10)) for i in range(n)], "grp string, id int")
    got = sorted(tuple(r) for r in windows.water_filled(rows, "grp", "id", 12).collect())
    assert got == [("a", 0), ("a", 1)] + [(g, i) for g in "bc" for i in range(5)]
    assert windows.water_filled(rows.where("grp = 'a'"), "grp", "id", 5).count() == 2 and windows.water_filled(rows.where("false"), "grp", "id", 3).count() == 0


def test_answers(spark):
    from quarry.functions import answers

    row = spark.createDataFrame([("go ###Answer: Paris \n### x", "I will take lamp 2 now", ["take lamp", "take lamp 2"])], "a string, b string, c array<string>")
    got = row.select(answers.marked_answer(F.col("a")), answers.picked_action(F.col("b"), F.col("c")), answers.last_line(F.lit("x\n y \n\n")), answers.bounded_read(F.lit("1\n2\n3\nhit\n5\n6\n7"), "hit", 1)).first()
    assert tuple(got) == ("Paris", "take lamp 2", "y", "3\nhit\n5")


def test_rolled_up_levels(spark):
    from quarry.operators.records import rolled_up

    rows = spark.createDataFrame([(1, i, str(i)) for i in range(7)], "grp int, seq long, content string")
    got = sorted((r["level"], r["seq"], r["content"]) for r in rolled_up(rows, 3, lambda c: F.replace(c, F.lit("\n"), F.lit("+"))).collect())
    assert got == [(1, 0, "0+1+2"), (1, 1, "3+4+5"), (1, 2, "6"), (2, 0, "0+1+2+3+4+5+6")]


def test_named_pipelines(spark):
    from quarry.plans import configs

    units = spark.createDataFrame([(1, "red car drives"), (2, "blue boat swims")], "id long, content string")
    queries = spark.createDataFrame([(0, "what is red car")], "query_id long, query string")
    for name in ("C1", "C2", "C3", "C4", "C5"):
        assert configs.build(name)(units, queries, 1).first()["id"] in (1, 100_000)
    with pytest.raises(KeyError):
        configs.build("C77")


def test_concepts_of_whole_contents(spark, tmp_path):
    from quarry.plans import registry

    rows = [(i, "filler " * 60 + "Zanzibar zanzibar", "en", "s") for i in range(3)] + [(3, None, "en", "s"), (4, "zanzibar", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["concept"]: (r["units"], r["ids"]) for r in registry.queries()["I18_concept_graph"](spark, str(tmp_path)).collect()}
    assert got == {"filler": (3, [0, 1, 2]), "zanzibar": (4, [0, 1, 2, 4])}


def test_whole_passages_are_searched(spark, tmp_path):
    """Words after the twelfth find, in the retrievers and in the second half of a decomposed query."""
    from quarry.plans import registry

    docs = [(1, "late zebra here", "en", "s"), (2, "w1 w2 here", "en", "s"), (3, "nothing", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = [(0, " ".join(f"w{i}" for i in range(1, 20)) + " zebra"), (1, None)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("R23_term_sets", "F05_decomposition"):
        got = {(r["query_id"], r["id"]): r["score"] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {(0, 1): 1.0, (0, 2): 2.0}, name
    assert {r["query_id"]: len(r["query"].split()) for r in registry.queries()["R36_condensed_query"](spark, str(tmp_path)).collect()}[0] == 6


def _ranks(edges, seed, rounds=50):
    """Page rank by brute force, to an L1 change below 1e-6, and its rounds."""
    total, rank = {}, {seed: 1.0}
    for a, _, w in edges:
        total[a] = total.get(a, 0.0) + w
    for n in range(1, rounds + 1):
        new = {seed: 0.5}
        for a, b, w in edges:
            new[b] = new.get(b, 0.0) + 0.5 * rank.get(a, 0.0) * w / total[a]
        change = sum(abs(new.get(v, 0.0) - rank.get(v, 0.0)) for v in new.keys() | rank.keys())
        rank = new
        if change < 1e-6:
            break
    return rank, n


def test_page_rank_converges(spark, sf):
    from quarry.plans import q_plan, registry

    chain = [(f"v{i}", f"v{i + 1}", 1.0) for i in range(12)]
    edges = chain + [(b, a, w) for a, b, w in chain]
    frame = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("v0",)], "node string")
    expected, rounds = _ranks(edges, "v0")
    got = {r["node"]: r["rank"] for r in plan.page_rank(frame, seeds, rounds=50, tolerance=1e-6).collect()}
    assert 12 < rounds < 50 and set(got) == {f"v{i}" for i in range(13)}
    assert all(got[v] == pytest.approx(expected[v], abs=1e-12) for v in got)
    expected, _ = _ranks([tuple(r) for r in q_plan._r11_edges(spark, sf).collect()], "r1")
    got = {r["node"]: r["score"] for r in registry.queries()["R11_page_rank_converged"](spark, sf).collect()}
    assert set(got) == {v for v, x in expected.items() if x > 0}
    assert all(got[v] == pytest.approx(expected[v], abs=2e-8) for v in got)


def test_substrings_by_grams(spark):
    """Words within runs and whole queries within texts, against brute force; of one, two and more characters, and beyond ASCII."""
    import random

    from quarry.operators import retrieval

    r = random.Random(3)
    texts = [(i, "".join(r.choice("abAB1 é-\n") for _ in range(r.randint(0, 40)))) for i in range(150)]
    words = ["a", "ab", "1b", "bab", "abab", "baba", "zz", "aabb"]
    units = spark.createDataFrame(texts, "id int, content string")
    got = {tuple(x) for x in retrieval.holding(units, spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == {(w, i) for i, t in texts for w in words if w in t.lower()} and len(got) > 50
    queries = [(k, q) for k, q in enumerate(["a b", "é-", " 1 ", "b\na", "ab é", "-", "bé a1"])]
    asked = spark.createDataFrame(queries, "query_id int, q string")
    low = units.select("id", F.lower("content").alias("low"))
    got = {tuple(x) for x in retrieval.containing(low, asked).collect()}
    assert got == {(k, i) for i, t in texts for k, q in queries if q in t.lower()}
    assert "NestedLoop" not in retrieval.containing(low, asked)._jdf.queryExecution().toString()


def test_plan_without_hits_ranks_by_the_question(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "id int, content string")
    p = plan.SearchPlan.of({"queries": ["delta"], "filters": ["nowhere"], "read_ids": [], "top_k": 2})
    assert [(r["id"], r["score"]) for r in plan.execute(rows, p, "alpha beta").orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]
    read = plan.SearchPlan.of({"queries": ["delta"], "filters": ["nowhere"], "read_ids": [3], "top_k": 2})
    assert [(r["id"], r["score"], r["matches"]) for r in plan.execute(rows, read, "alpha").collect()] == [(3, 1.0, [])]
    steps = spark.createDataFrame([(1, "Step 3: go"), (2, "step three")], "id int, content string")
    hits = plan.execute(steps, plan.SearchPlan.of({"queries": [r"Step\\s+3\\s*:".replace("\\\\", "\\")]}), "x").collect()
    assert [r["id"] for r in hits] == [1] and hits[0]["score"] > 2


def test_titles_have_dates_too(spark):
    rows = spark.createDataFrame([(1, "x", "on 2024-02-01"), (2, "of 2024-01-01", "none"), (3, "x", "x")], "id int, title string, content string")
    assert [(r["id"], r["date"]) for r in plan.temporal_order(rows).orderBy("rank").collect()] == [(2, "2024-01-01"), (1, "2024-02-01")]


def test_expansion_is_bounded(spark):
    """By breadth-first search in plain Python, with more seeds than may come and without neighbours."""

    def walk(adjacency, seeds, detail, most):
        numbers = [int("".join(g)) for d, g in __import__("itertools").groupby(detail, str.isdigit) if d]
        depth = min(3, max(1, max(numbers, default=1)))
        found, level = list(seeds[:most]), list(seeds)
        for _ in range(depth):
            level, before = [], level
            for n in before:
                for m in adjacency.get(n, []):
                    if m not in found:
                        found.append(m)
                        level.append(m)
                        if len(found) >= most:
                            return found
        return found

    import random

    r = random.Random(5)
    adjacency = {n: r.sample(range(40), r.randint(0, 4)) for n in range(30)}
    edges = spark.createDataFrame([(n, i, m) for n, ms in adjacency.items() for i, m in enumerate(ms)], "node int, pos int, neighbour int")
    cases = [(0, [1], "", 8), (1, [2, 3], "2 hops", 8), (2, list(range(12)), "9", 8), (3, [39], "3", 8), (4, [4, 5, 6, 7, 8, 9, 10, 11], "depth 3", 8), (5, [20], "within 30", 8)]
    seeds = spark.createDataFrame([(q, i, n) for q, ns, _, _ in cases for i, n in enumerate(ns)], "query_id int, pos int, node int")
    details = spark.createDataFrame([(q, d) for q, _, d, _ in cases], "query_id int, detail string")
    got = {}
    for x in plan.bounded_expand(edges, seeds, details, 8).orderBy("query_id", "place").collect():
        got.setdefault(x["query_id"], []).append(x["node"])
    assert got == {q: walk(adjacency, ns, d, most) for q, ns, d, most in cases}


def test_search_loop_asks_again(spark):
    from quarry.operators import search

    rows = spark.createDataFrame([(i, f"record {i} " + ("red" if i % 2 else "blue")) for i in range(6)], "id int, content string")
    asked, hints = [], []

    def planner(question, hint):
        hints.append(hint)
        return {"queries": ["blue" if hint else "red"], "filters": ["blue" if hint else "red"], "use_dump": True, "top_k": 2}

    def judge(question, seen):
        asked.append(seen)
        return {"sufficient": len(asked) > 2, "why_more": "something blue"}

    run = lambda v, **more: [(r["round"], r["kind"], r["id"]) for r in search.search(rows, "which colour", planner, judge, search.VARIANTS[v], dump=lambda d, q: "all", **more).collect()]
    assert run("full") == [(0, "dump", "dump"), (0, "record", "1"), (0, "record", "3"), (1, "record", "0"), (1, "record", "2"), (2, "record", "0"), (2, "record", "2")]
    assert hints == ["", "something blue", "something blue"]
    assert run("single") == [(0, "record", "1"), (0, "record", "3")]
    caches, before = search.Caches(), len(hints)
    assert run("u3", caches=caches) == run("u3", caches=caches) and len(hints) == before + 1


def test_variants_share_passes(spark, monkeypatch):
    from quarry.operators import loop, search

    rows = spark.createDataFrame([(i, f"record {i}\nred {'blue' * (i % 2)}") for i in range(6)], "id long, content string")
    plans = {"queries": ["blue"], "aggregate_ops": [{"op": o, "args": ["blue", "record 3"]} for o in ("count", "union", "intersect")], "top_k": 2}
    passes, scans, scan = [], {}, loop.scanned
    monkeypatch.setattr(loop, "scanned", lambda *a: passes.append(a) or scan(*a))
    for v in ("u1", "single", "nograph"):
        told = search.search(rows, "which colour", lambda q, h: plans, lambda q, s: {"sufficient": True}, search.VARIANTS[v], scans=scans).collect()
        assert [(r["kind"], r["id"], list(r["matches"])) for r in told] == [
            ("record", "1", ["2: red blue"]),
            ("record", "3", ["2: red blue"]),
            ("count", "agg", ["count=3"]),
            ("union", "agg", ["union_ids=1,3,5", "count=3"]),
            ("intersect", "agg", ["intersect_ids=3", "count=1"]),
        ]
    assert len(passes) == 1


def test_named_sources(tmp_path, spark):
    from quarry.sources import registry as sources

    known = sources.Sources()
    known.register(sources.Source("Dialogues", lambda s, p: s.range(3).withColumn("domain", F.when(F.col("id") > 0, "x")), category="talk", axes=("recall",), variants=("b", "a")), "talks")
    assert known.available() == ["dialogues", "talks"] and known.by_category() == {"talk": ["dialogues", "talks"]} and known.by_category(canonical=True) == {"talk": ["Dialogues"]}
    assert known.describe(" TALKS ")["variants"] == ["a", "b"] and known.read("talks", spark, "", "x").count() == 2
    with pytest.raises(KeyError):
        known.get("none")


def test_vector_store_after_clear(spark, tmp_path):
    from quarry.sources.stores import VectorStore

    store = VectorStore(spark, f"file://{tmp_path}/v")
    rows = spark.createDataFrame([(1, "red car"), (2, "blue boat"), (3, None)], "id long, content string")
    assert store.count() == 0
    store.add(rows)
    store.delete(spark.createDataFrame([(2,), (9,)], "id long"))
    asked = spark.createDataFrame([(0, "red car"), (1, " ")], "query_id int, query string")
    assert [(r["query_id"], r["id"], r["score"]) for r in store.search(asked, 1).collect()] == [(0, 1, 1.0)]
    assert VectorStore(spark, f"file://{tmp_path}/v").count() == 2
    store.clear()
    assert store.count() == 0 and store.search(asked, 3).count() == 0


def test_packers_by_brute_force(spark, sf):
    """Paragraphs and lines packed one by one in plain Python."""
    import hashlib

    from quarry.plans import registry

    def packed(blocks, limit, joint):
        done, held = [], ""
        for b in blocks:
            if len(b) > limit:
                done += [held] if held else []
                done += [b[i : i + limit] for i in range(0, len(b), limit)]
                held = ""
            elif held and len(held) + len(joint) + len(b) > limit:
                done.append(held)
                held = b
            else:
                held = held + joint + b if held else b
        return done + ([held] if held else [])

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for limit, joint, name, value in ((600, "\n\n", "I05_I06_paragraph_packer", lambda t: hashlib.md5(t.encode()).hexdigest()), (6000, "\n", "I10_I07_experiences", len)):
        expected = {(i, k, value(t)) for i, text in texts.items() for k, t in enumerate(packed([b.strip(" ") for b in text.split("\n") if b.strip(" ")], limit, joint))}
        assert {(r["id"], r["chunk"], r["digest"] if "digest" in r else r["chars"]) for r in registry.queries()[name](spark, sf).collect()} == expected


def test_rouge_and_bleu_by_brute_force(spark):
    import random
    from collections import Counter

    from quarry.functions import scores

    r = random.Random(2)
    pairs = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(60)]

    def common(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = [0] + [max(old + 1 if a == b else 0, up, 0) for old, up, b in zip(row, row[1:], y, strict=False)]
            for i in range(1, len(row)):
                row[i] = max(row[i], row[i - 1])
        return row[-1]

    def rouge(x, y):
        if not x and not y:
            return 1.0
        n = common(x, y)
        return 0.0 if not n else 2 * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y))

    def bleu(x, y, order):
        if not x or not y:
            return 0.0
        total = 0.0
        for n in range(1, order + 1):
            p, q = Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)), Counter(tuple(y[i : i + n]) for i in range(len(y) - n + 1))
            if p:
                total += math.log((sum(min(c, q[g]) for g, c in p.items()) + 0.1) / (sum(p.values()) + 0.1)) / order
        return math.exp(total) * (1.0 if len(x) > len(y) else math.exp(1 - len(y) / len(x)))

    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = rows.select("a", "b", scores.rouge_l(F.col("a"), F.col("b")).alias("r"), *(scores.bleu(F.col("a"), F.col("b"), n).alias(f"b{n}") for n in (1, 4))).collect()
    for x in got:
        assert (x["r"], x["b1"], x["b4"]) == (pytest.approx(rouge(x["a"], x["b"])), pytest.approx(bleu(x["a"], x["b"], 1)), pytest.approx(bleu(x["a"], x["b"], 4)))


def test_entity_ranks_by_brute_force(spark):
    """C8: personalised ranks over triples and the units that hold their entities."""
    from quarry.plans import configs

    texts = {1: "red car drives fast. big dog sees car.", 2: "old boat carries dog. car likes boat.", 3: "none.", 4: "sun warms old boat"}
    units = spark.createDataFrame(list(texts.items()), "id long, content string")
    queries = spark.createDataFrame([(0, "where is the dog"), (1, "Red Boat"), (2, "nothing here")], "query_id long, query string")
    edges = {}
    for i, t in texts.items():
        held = set()
        for s in t.split("."):
            w = s.split()
            if len(w) >= 3:
                a, b = w[0].lower(), w[-1].lower()
                held |= {a, b}
                if a != b:
                    for x, y in ((f"e:{a}", f"e:{b}"), (f"e:{b}", f"e:{a}")):
                        edges[x, y] = edges.get((x, y), 0.0) + 1.0
        for e in held:
            for x, y in ((f"u:{i}", f"e:{e}"), (f"e:{e}", f"u:{i}")):
                edges[x, y] = edges.get((x, y), 0.0) + 0.05
    known = {a[2:] for a, _ in edges if a.startswith("e:")}
    expected = {}
    for q, text in ((0, "where is the dog"), (1, "Red Boat"), (2, "nothing here")):
        seeds = [f"e:{w}" for w in set(text.lower().split()) & known]
        rank = {s: 1 / len(seeds) for s in seeds}
        out = {}
        for (a, _), w in edges.items():
            out[a] = out.get(a, 0.0) + w
        for _ in range(60 if seeds else 0):
            new = {s: 0.5 / len(seeds) for s in seeds}
            for (a, b), w in edges.items():
                new[b] = new.get(b, 0.0) + 0.5 * rank.get(a, 0.0) * w / out[a]
            rank = new
        expected |= {(q, int(n[2:])): x for n, x in rank.items() if n.startswith("u:") and round(x, 6) > 0}
    got = {(r["query_id"], r["id"]): r["score"] for r in configs.build("C8")(units, queries, 5).collect()}
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k], abs=3e-6) for k in got)


def test_late_interaction_and_reasoner(spark):
    from quarry.plans import configs

    units = spark.createDataFrame([(1, "red car drives"), (2, "blue boat swims"), (3, "")], "id long, content string")
    queries = spark.createDataFrame([(0, "what drives the red car")], "query_id long, query string")
    for name, first in (("C6", 100), ("C7", 100), ("C8", 1), ("C9", 100_000)):
        assert configs.build(name)(units, queries, 1).first()["id"] == first, name
    listed = configs.reasoned(units, queries, 3, lambda prompts: ["2, then 1 and 77" for _ in prompts])
    assert [(r["id"], r["score"]) for r in listed.orderBy("rank").collect()] == [(2, 1.0), (1, 0.5)]


def test_empty_report(spark):
    from quarry.functions import reports

    row = spark.createDataFrame([(None,), ("# STATES\nobject_states:\n- name: a",)], "t string").select(reports.parsed(F.col("t")).alias("r")).collect()
    assert row[0]["r"]["objectives"] == [] and row[0]["r"]["objects"] == [] and row[0]["r"]["env_changed"] is False
    assert [o["name"] for o in row[1]["r"]["objects"]] == ["a"]


def test_episodes_end(spark):
    from quarry.operators.methods import Fused, Method

    m = Method(lambda d: d, Fused(()))
    assert m.run_episode(lambda a: (a.upper(), a == "c"), lambda seen: "abc"[len(seen)]) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert len(m.run_episode(lambda a: ("", False), lambda seen: "x", most=4)) == 4 and m.counters["steps"] == 7


def test_judges_compute_an_answer_once(spark):
    """The judges' expressions name what they use several times once, so their plans stay small."""
    from quarry.functions import answers

    rows = spark.createDataFrame([("Exact Answer: **Paris**\nConfidence: 90%", "so\n**Exact Answer**: paris", '{"a": "Paris", "b": "-", "c": 7}'), (None, "Answer: a b", "{}"), ("x\ny", None, None), ("the answer is the b of a", "a b", "[1]")], "p string, g string, j string")
    told = rows.select(answers.exact_answer(F.col("p")).alias("e"), answers.progressive_correct(F.col("p"), F.col("g")).alias("c"), answers.leaf_recall(F.col("p"), F.col("j")).alias("r"))
    assert [(x["e"], x["c"], tuple(x["r"])) for x in told.collect()] == [("Paris", True, (1, 2, 0.5)), (None, False, (0, 0, 0.0)), (None, True, (0, 0, 0.0)), ("the answer is the b of a", True, (0, 1, 0.0))]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("(?i)(?:\\*\\*)?\\s*Confidence") <= 3


def test_pipelines_embed_a_text_once(spark, tmp_path):
    """A model meets each text and each query once, whatever reads its vectors (F29)."""
    from quarry.plans import configs

    told = str(tmp_path / "told")

    def model(texts):
        with open(told, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return models.hashed_embedding(texts)

    units = spark.createDataFrame([(i, f"text {i} of car{i % 7}") for i in range(40)], "id long, content string")
    queries = spark.createDataFrame([(0, "car3"), (1, "text 5")], "query_id long, query string")
    assert configs._dense(units, queries, 5, model).count() == 10
    with open(told) as f:
        assert sorted(f.read().splitlines()) == sorted([f"text {i} of car{i % 7}" for i in range(40)] + ["car3", "text 5"])


def test_centres_are_met_some_rows_at_a_time():
    """No table of all rows' distances to all centres is held (F29): that of these is 64 MB."""
    import tracemalloc

    import numpy as np

    from quarry.operators import vectors

    rows = np.random.default_rng(1).normal(size=(8192, 8))
    tracemalloc.start()
    centres = vectors._centres(rows, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    apart = np.sqrt(((rows[:500, None, :] - centres[None]) ** 2).sum(2))
    cell, near = vectors._nearest(rows[:500], centres)
    assert np.allclose(near, apart.min(1)) and np.allclose(apart[np.arange(500), cell], near)
    assert np.allclose(vectors._distances(rows[:500], centres), apart)
    assert [len(x) for x in vectors._nearest(rows[:3], np.empty((0, 8)))] == [3, 3]


def test_late_interaction_embeds_a_chunk_once(spark, tmp_path):
    """A token model meets each chunk and each query once (F4)."""
    from quarry.plans import configs

    told = tmp_path / "told"

    def model(texts):
        with told.open("a") as f:
            f.write("".join(t + "\n" for t in texts))
        return models.token_vectors(texts)

    units = spark.createDataFrame([(i, f"text number {i} about trees") for i in range(20)], "id long, content string")
    queries = spark.createDataFrame([(0, "number trees"), (1, "about text")], "query_id long, query string")
    found = configs.c9(units, queries, 3, model)
    assert found.count() == 6
    assert sorted(told.read_text().splitlines()) == sorted([*(f"text number {i} about trees" for i in range(20)), "number trees", "about text"])
