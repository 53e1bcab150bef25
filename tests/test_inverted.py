"""The stored inverted index against brute force: BM25, appended units, blocks left unread."""

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import inverted, retrieval

WORDS = [f"{'abcdefghij'[i % 10]}{i}" for i in range(120)]


def prose(r, n):
    return " ".join(r.choices(WORDS, [1 / (1 + i) for i in range(len(WORDS))], k=n))


def brute(units, queries, k, fill=True, k1=1.5, b=0.75):
    tokens = {i: re.findall("[a-z0-9]+", (t or "").lower()) or [""] for i, t in units}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    out = []
    for q, text in queries:
        asked = re.findall("[a-z0-9]+", (text or "").lower()) or [""]
        scored = []
        for i, ts in tokens.items():
            tf = Counter(ts)
            s = sum(idf[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / mean)) for t in asked if t in tf)
            if any(t in tf for t in asked) or fill:
                scored.append((-round(s, 6) + 0.0, i))
        scored = [x for x in sorted(scored) if fill or x[0] < 0][:k]
        out += [(q, i, pytest.approx(-s, abs=2e-6), r + 1) for r, (s, i) in enumerate(scored)]
    return out


@pytest.fixture(scope="module")
def units():
    r = random.Random(8)
    rows = [(i, prose(r, r.choice([0, 1, 8, 60, 500]))) for i in range(700)]
    return [*rows, (700, None), (701, ""), (702, "--"), (703, rows[5][1]), (704, "once " + "a0 " * 30_000)]


@pytest.fixture(scope="module")
def questions():
    r = random.Random(9)
    return [(i, prose(r, r.choice([1, 3, 20, 60]))) for i in range(25)] + [(90, None), (91, "unknown words"), (92, "once a0"), (93, "a0 a0 a0")]


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"id long, {name} string").repartition(3)


def results(df):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


def ranks(rows):
    return sorted(rows, key=lambda x: (x[0], x[3]))


def test_bm25(spark, units, questions):
    u, q = frame(spark, units, "content"), frame(spark, questions, "query").withColumnRenamed("id", "query_id")
    tokens = [X.terms(F.col(c)) for c in ("content", "query")]
    for fill in (True, False):
        got = retrieval.bm25(u, q, 10, *tokens, fill=fill)
        assert ranks(results(got)) == ranks(brute(units, questions, 10, fill))


def test_many_shards_and_appended_units(spark, units, questions, monkeypatch):
    u, q = frame(spark, units, "content"), frame(spark, questions, "query").withColumnRenamed("id", "query_id")
    tokens = [X.terms(F.col(c)) for c in ("content", "query")]
    monkeypatch.setattr(inverted, "QUESTION_TERMS", 40)  # several blocks of questions
    first = inverted.build(u.where("id % 3 <> 0"), tokens[0], shard_tokens=4000)
    index = inverted.append(first, u.where("id % 3 = 0"), tokens[0], shard_tokens=4000)
    assert index.shards.count() > 10 and index.units == len(units)
    got = retrieval.bm25_search(index, u.select("id"), q, 7, tokens[1])
    assert ranks(results(got)) == ranks(brute(units, questions, 7))
    old = [x for x in units if x[0] % 3]
    assert ranks(results(retrieval.bm25_search(first, u.where("id % 3 <> 0").select("id"), q, 7, tokens[1]))) == ranks(brute(old, questions, 7))


def test_empty(spark, units, questions):
    u, q = frame(spark, units, "content"), frame(spark, questions, "query").withColumnRenamed("id", "query_id")
    tokens = [X.terms(F.col(c)) for c in ("content", "query")]
    assert retrieval.bm25(u.where("false"), q, 10, *tokens).count() == 0
    assert retrieval.bm25(u, q.where("false"), 10, *tokens).count() == 0


def test_blocks_are_left_unread(spark):
    """A few short units hold a rare word often; the common word's blocks can't reach them."""
    r = random.Random(10)
    rows = [(i, "rare rare rare") for i in range(12)] + [(100 + i, "common " * r.randint(1, 3) + prose(r, 30)) for i in range(6000)]
    u = spark.createDataFrame(rows, "id long, content string").coalesce(1)
    q = spark.createDataFrame([(0, "rare common")], "query_id long, query string")
    index = inverted.build(u, X.terms(F.col("content")))
    asked = retrieval.query_terms(q, X.terms(F.col("query")))
    told = inverted.search(index, asked, 10, retrieval.okapi(index), counted=True).agg(F.sum("read"), F.sum("blocks")).first()
    assert told[1] > 40 and told[0] < told[1] / 2
    assert results(retrieval.bm25_search(index, u.select("id"), q, 10, X.terms(F.col("query")))) == brute(rows, [(0, "rare common")], 10)


def test_row_groups_are_small(spark):
    """A row group is held whole by tasks that write or read it, so it has few shards, however many a file has."""
    words = "transform(sequence(1, 20000), i -> hex(xxhash64(id, i)))"
    u = spark.range(60).coalesce(1).select("id", F.expr(words).alias("words"))
    index = inverted.build(u, F.col("words"), shard_tokens=20000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert not any(m.row_group(0).column(c).is_stats_set for m in files for c in range(m.num_columns))  # a writer keeps the values in them until the end
    assert sum(m.num_rows for m in files) == 60 and sum(sizes) > 30 << 20 and max(sizes) < 16 << 20
