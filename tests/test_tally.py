"""Sums over a question's terms, taken in one pass, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval, tally


def _rows(spark, n=300):
    r = random.Random(8)
    words = ["ab", "abab", "b1", "zeta", "eta", "et", "a", "Ta", "xé", "x"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))) if i % 17 else None) for i in range(n)]
    return texts, spark.createDataFrame(texts, "id int, content string").repartition(5)


def _best(scored, k):
    return [(q, i, pytest.approx(s), n) for q in sorted(scored) for n, (i, s) in enumerate(sorted(scored[q].items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1)]


def test_counts_within_words(spark, monkeypatch):
    """Many blocks, equal questions, small parts, many ties; a task gives k rows of a question at most."""
    texts, units = _rows(spark)
    asked = [(q, " ".join(w)) for q, w in enumerate([["ab", "eta"], ["abab", "abab", "ta"], ["ab", "eta"], ["zz"], ["b1"], ["eta", "ab"], []])]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    for name, value in (("TOGETHER", 2), ("MATCHES", 50), ("REMEMBERED", 2)):
        monkeypatch.setattr(tally, name, value)
    scored = {}
    for q, text in asked:
        terms = text.split()
        for i, t in texts:
            low = (t or "").lower()
            found = sum(low.count(w) * terms.count(w) for w in set(terms) if w in low)
            if found:
                scored.setdefault(q, {})[i] = float(found)
    found = retrieval.count_ranker(units, queries, 4, F.filter(F.split("query", " "), lambda w: w != ""), lambda n, times: n * times)
    got = [(r["query_id"], r["id"], r["score"], r["rank"]) for r in found.orderBy("query_id", "rank").collect()]
    assert got == _best(scored, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("MapInArrow")[0] and "NestedLoop" not in plan


def test_shares_and_phrases(spark):
    """A share of 1 in 128 rounds upwards, as SQL does; a phrase adds 0.3; lists are filled up with the first ids."""
    texts = [(1, "w1"), (2, "w1 w2 of w3"), (3, "none"), (4, "w2 w3")]
    units = spark.createDataFrame(texts, "id long, content string")
    queries = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(1001, 1128)) + " none"), (1, "w2 w3"), (2, "the")], "query_id long, query string")
    got = {}
    for r in retrieval.substring(units, queries, 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == {0: [(3, 0.007813), (1, 0.0), (2, 0.0)], 1: [(4, 1.3), (2, 1.0), (1, 0.0)], 2: [(1, 0.0), (2, 0.0), (3, 0.0)]}


def test_a_task_keeps_k(spark):
    block = tally._Block([{"query_id": 7, "terms": [{"term": "a", "times": 1}], "phrase": None}], 3, False, lambda n, _: np.ones(len(n)), None)
    for start in range(0, 200_000, 50_000):
        block.read(range(start + 49_999, start - 1, -1), ["a"] * 50_000)
    (out,) = block.results()
    assert out.to_pydict() == {"query_id": [7, 7, 7], "id": [0, 1, 2], "score": [1.0, 1.0, 1.0]}


def test_equal_labels_are_compared_once(spark, sf):
    from quarry.plans import q_rest

    plan = q_rest.r22(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [label" in plan and plan.count("Join") == 2


def test_best_hops(spark):
    """The k best of three hops are those of all; a list of 3,000 ids gives 2k."""
    from quarry.operators import plan, ranking

    r = random.Random(5)
    rows = [("all", i) for i in range(3000)] + [(f"c{r.randint(0, 60)}", r.randint(0, 150)) for _ in range(200)]
    concepts = spark.createDataFrame([*rows, *rows[3000:3010]], "concept string, id long")
    seeds = spark.createDataFrame([(q, f"c{q}") for q in range(40)] + [(99, "all"), (98, "none")], "query_id long, concept string")
    for k in (1, 4, 12):
        want = ranking.top(plan.multi_hop(concepts, seeds, 3), k, ["query_id"])
        bounded = plan.multi_hop(concepts, seeds, 3, k)
        assert bounded.where("query_id = 99").count() == k
        assert {tuple(x) for x in ranking.top(bounded, k, ["query_id"]).collect()} == {tuple(x) for x in want.collect()}


def test_a_task_gives_k_neighbours(spark):
    """Of 60 and more blocks a task gives k rows for each query, with ties to the lower id."""
    from quarry.operators import vectors

    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 4)).astype(np.float32)
    x[1000:] = x[:1000]
    v = spark.createDataFrame([(i, a) for i, a in enumerate(x.tolist())], "id long, vector array<float>").repartition(2)
    q = v.where("id < 20").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    for measure in ("cosine", "l2"):
        index = vectors.build(v, measure)
        assert index.blocks.count() > 60
        asked = q.withColumn("reach", F.lit(None).cast("double")).withColumn("kth", F.lit(None).cast("double"))
        assert vectors._met(index, asked, 3, 20, None).count() <= index.blocks.rdd.getNumPartitions() * 20 * 3
        assert {tuple(r) for r in vectors.search(index, q, 2).select("query_id", "id", "score").collect()} == {(i, j, 1.0) for i in range(20) for j in (i, i + 1000)}


def test_equal_late_scores_are_k_of_a_task(spark):
    """Of 3,000 documents of one score a task tells k for each query; those that it can't tell are told once, by their id."""
    from quarry.operators import late

    v = spark.createDataFrame([(d, [1.0, 0.0] if p else [0.0, 1.0]) for d in range(3000) for p in (0, 1)], "id long, vector array<float>").repartition(2)
    q = spark.createDataFrame([(i, 0, [1.0, 0.5], 2) for i in range(10)], "query_id long, part int, query array<float>, times int")
    index = late.build(v, 2)
    (sent,) = late._blocks(q)
    assert late._told(index, sent, 5).count() <= index.documents.rdd.getNumPartitions() * 10 * 5
    assert {(r["query_id"], r["id"], r["score"]) for r in late.search(index, v, q, 5).collect()} == {(i, d, 2.0) for i in range(10) for d in range(5)}


def test_questions_are_not_sent_with_every_shard(spark):
    from quarry.operators import inverted

    units = spark.createDataFrame([(i, f"a{i % 7} b") for i in range(50)], "id long, content string")
    index = inverted.build(units, F.split("content", " "), shard_tokens=10)
    asked = spark.createDataFrame([(0, "a1", 1), (1, "b", 1)], "query_id long, term string, times long")
    found = inverted.search(index, asked, 3, F.lit(1.0) / F.col("df"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["query_id"], r["id"]) for r in retrieval.top(found, 3, ["query_id"]).collect()} == {(0, 1), (0, 8), (0, 15), (1, 0), (1, 1), (1, 2)}


def test_key_value_keeps_k_rows_of_a_task(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice(["ab", "Ba", "c", " ", "  ", "\n", "-"]) for _ in range(n))
    rows = [(i, r.choice(["ab", "c", "x_ab"]), text(r.randint(0, 14))) for i in range(300)] + [(900, None, None)]
    asked = [(i, text(r.randint(1, 6))) for i in range(40)] + [(50, "ab"), (51, " X_AB "), (52, None)]
    told = set()
    for query, q in ((i, (q or "").lower().strip(" ")) for i, q in asked):
        found = []
        for i, key, content in rows if q else ():
            low = (content or "").lower()
            shared, parts = len(set(q.split()) & set(low.split())), (q in low) + (key is not None and q in key)
            if q == key or shared or parts:
                found.append((-3.0 if q == key else -(1 + shared + 0.5 * parts), i))
        told |= {(query, i, -s, at + 1) for at, (s, i) in enumerate(sorted(found)[:4])}
    found = retrieval.key_value(spark.createDataFrame(rows, "id long, key string, content string").repartition(3), spark.createDataFrame(asked, "query_id long, query string"), 4)
    assert {(x["query_id"], x["id"], x["score"], x["rank"]) for x in found.collect()} == told
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
