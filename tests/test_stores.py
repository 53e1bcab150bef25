"""Versioned tables and the vector index: lost writers, two writers at a time, compaction; neighbours against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval, vectors
from quarry.sources.stores import VectorStore, embedded
from quarry.sources.versions import VersionedTable


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(table, version=None):
    return sorted(r["v"] for r in table.rows(version).collect())


def test_versions_and_lost_writers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a b"
    table = VersionedTable(spark, path, "v long")
    assert held(table) == [] and table.latest() == (0, [])
    assert [table.append(numbers(spark, 1, 2)), table.append(numbers(spark, 3))] == [1, 2]
    # A writer dies after its rows, another one within its manifest.
    table._write(numbers(spark, 99))
    (tmp_path / "a b" / "versions" / f"{3:020d}.json").write_text('{"fold')
    assert held(table) == [1, 2, 3] and table.append(numbers(spark, 4)) == 4
    assert held(VersionedTable(spark, path, "v long")) == [1, 2, 3, 4] and held(table, 2) == [1, 2, 3] and held(table, 3) == []
    # A compaction dies before its commit: nothing changes. Then one that goes through, while another writer appends.
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.compact(lambda log: log.drop("change"))
    assert held(table) == [1, 2, 3, 4]
    other, write = VersionedTable(spark, path, "v long"), VersionedTable._write

    def meanwhile(self, rows):
        name = write(self, rows)
        monkeypatch.setattr(VersionedTable, "_write", write)
        other.append(numbers(spark, 5))
        return name

    monkeypatch.setattr(VersionedTable, "_write", meanwhile)
    table.compact(lambda log: log.where("v <> 2").drop("change"))
    assert held(table) == [1, 3, 4, 5] and len(table.latest()[1]) == 2
    changes = {r["v"]: r["change"] for r in table.rows().collect()}
    assert changes[5] > changes[1] == changes[4]
    table.replace(None)
    assert held(table) == [] and table.append(numbers(spark, 7)) > 6 and held(table) == [7]


def test_two_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    a, b = (VersionedTable(spark, f"file://{tmp_path}/t", "v long") for _ in range(2))
    a.append(numbers(spark, 0))
    create, told = VersionedTable._create, []

    def late(self, version, folders):
        if not told:  # the other one commits between this one's look and its commit
            told.append(version)
            b.append(numbers(spark, 1))
        return create(self, version, folders)

    monkeypatch.setattr(VersionedTable, "_create", late)
    assert a.append(numbers(spark, 2)) == 3 and told == [2]
    assert held(a) == [0, 1, 2] and {r["v"]: r["change"] for r in a.rows().collect()} == {0: 1, 1: 2, 2: 3}


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/v")
    row = lambda i, c, *v: spark.createDataFrame([(i, c, list(map(float, v)))], "id long, content string, vector array<float>")
    store.add(row(1, "a", 1, 0).unionByName(row(2, "b", 0, 1)))
    before, _ = store.table.latest()
    store.add(row(1, "c", 0, 2))
    store.delete(spark.createDataFrame([(2,), (9,)], "id long"))
    assert [tuple(r)[:2] for r in store.records().collect()] == [(1, "c")]
    assert sorted(tuple(r)[:2] for r in store.records(before).collect()) == [(1, "a"), (2, "b")]
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, query array<float>")
    assert [(r["id"], r["score"]) for r in store.search(asked, 3).collect()] == [(1, 0.5)]
    store.compact()
    assert len(store.table.latest()[1]) == 1 and store.count() == 1
    store.add(row(5, "d", 0, 1))
    assert [r["id"] for r in store.search(asked, 3).orderBy("rank").collect()] == [5, 1]
    store.clear()
    assert store.search(asked, 3).count() == 0


def test_embedded_by_two_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "w"), (3, None, None, "c"), (4, None, " ", "")], "id long, compact string, title string, content string")
    path = f"file://{tmp_path}/e"
    first = embedded(rows, path)
    known = VersionedTable(spark, path, "key string, embedding array<float>")
    known.append(known.rows().drop("change"))  # another writer's
    assert sorted(r["id"] for r in first.collect()) == sorted(r["id"] for r in embedded(rows, path).collect()) == [1, 2, 3]


def points(n, size, groups, seed):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, size)) * 4
    return (middles[r.integers(0, groups, n)] + r.normal(size=(n, size)) * 0.3).astype(np.float32)


def brute(rows, queries, k, measure):
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q, v in queries:
        v = np.array(v, np.float64)
        if measure == "cosine":
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
            s = np.where(size > 0, x @ v / np.where(size > 0, size, 1), 0)
        else:
            s = 1 / (1 + ((x - v) ** 2).sum(1))
        scored = sorted((-round(float(a), 6), i) for a, (i, _) in zip(s, rows, strict=True))[:k]
        out[q] = [(i, pytest.approx(-a, abs=1.1e-6)) for a, i in scored]
    return out


@pytest.mark.parametrize("measure", ["cosine", "l2"])
def test_neighbours(spark, measure, monkeypatch):
    x = points(3000, 16, 12, 1).tolist()
    x += [[0.0] * 16, x[5], x[5], x[5], [-v for v in x[7]]]
    rows = list(enumerate(x))
    queries = [(i, x[i]) for i in range(0, 3000, 300)] + [(5, x[5]), (9000, [0.0] * 16), (9001, [100.0] * 16)]
    v = spark.createDataFrame([*rows, (9999, None)], "id long, vector array<float>").repartition(3)
    q = spark.createDataFrame([*queries, (9002, None)], "query_id long, query array<float>")
    monkeypatch.setattr(vectors, "TOGETHER", 4)
    index = vectors.build(v, measure)
    found = vectors.search(index, q, 10)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == brute(rows, queries, 10, measure)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    near = vectors.recall(index, q.where("query_id < 9000"), 10)
    assert near.agg(F.avg("recall")).first()[0] >= 0.9
    # Few blocks are met within the radius.
    reach = spark.createDataFrame([(0, x[0], 0.5)], "query_id long, query array<float>, reach double")
    asks = vectors._asks(index, reach, None)
    met = index.blocks.join(asks, "cell").where("low <= far and high >= near").count()
    assert 0 < met < index.blocks.count() / 3


def test_neighbours_of_few(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    one = spark.createDataFrame([(4, [0.0, 0.0])], "id long, vector array<float>")
    for measure in ("cosine", "l2"):
        assert retrieval.dense(none, q, 3, measure).count() == 0
        assert [r["id"] for r in retrieval.dense(one, q, 3, measure).collect()] == [4]
        assert retrieval.dense(one, q.where("false"), 3, measure).count() == 0


def test_late_interaction(spark, monkeypatch):
    """Equal to all pairs, with few documents scored."""
    from quarry.operators import late

    r = np.random.default_rng(4)
    docs = []  # a document's vectors are of a few kinds
    middles = r.normal(size=(20, 8))
    for d in range(400):
        kinds = r.integers(0, 20, 3)
        docs += [(d, v.tolist()) for v in (middles[r.choice(kinds, r.integers(1, 12))] + r.normal(size=(1, 8)) * 0.01).astype(np.float32)]
    docs += [(900, [0.0] * 8), (901, docs[0][1])]
    queries = [(q, p, v.tolist(), t) for q in range(6) for p, (v, t) in enumerate(zip((middles[r.integers(0, 20, 5)]).astype(np.float32), [1, 2, 1, 1, 3], strict=True))]
    v = spark.createDataFrame([*docs, (7, None)], "id long, vector array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, part int, query array<float>, times int")
    monkeypatch.setattr(late, "TOGETHER", 10)
    got = {}
    for x in retrieval.max_similarity(v, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["id"], x["score"]))
    for k in range(6):
        scores = {}
        for d in {d for d, _ in docs}:
            own = np.array([x for i, x in docs if i == d], np.float64)
            scores[d] = round(sum(t * float((own @ np.array(x, np.float64)).max()) for i, _, x, t in queries if i == k), 5)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert got[k] == [(d, pytest.approx(s, abs=1.1e-5)) for d, s in best]
    index = late.build(v)
    assert late.candidates(index, q, 5).count() < 6 * 402 / 4
    assert retrieval.max_similarity(v.where("false"), q, 5).count() == 0 and retrieval.max_similarity(v, q.where("false"), 5).count() == 0


def test_change_log_asks_its_store_once_for_a_batch():
    """Changes in any order over several batches, against a plain fold; what a batch brings of an id costs a few calls, however many rows."""
    import random

    from pyspark.sql import Row
    from quarry.streaming import stateful

    class State:
        def __init__(self, calls):
            self.value, self.rows, self.calls = None, [], calls

        def get(self):
            self.calls.append("get")
            return iter(self.rows) if self.value is None and self.rows else self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def put(self, rows):
            self.calls.append("put")
            self.rows = list(rows)

        def appendValue(self, row):
            self.calls.append("append")
            self.rows.append(row)

        def clear(self):
            self.calls.append("clear")
            self.rows = []

    r = random.Random(6)
    for _ in range(60):
        changes = [Row(seq=s, op=r.choice(["put", "put", "delete"]), content=str(s)) for s in range(r.randint(1, 40))]
        shuffled, log, calls = r.sample(changes, len(changes)), stateful.ChangeLog(), []
        log.last, log.puts = State(calls), State(calls)
        seen = []
        while shuffled:
            n = r.randint(1, 12)
            batch, shuffled = shuffled[:n], shuffled[n:]
            seen += batch
            calls.clear()
            (got,) = log.handleInputRows(("x",), iter(batch), None)
            assert len(calls) <= 4
            gone = max((c.seq for c in seen if c.op == "delete"), default=-1)
            puts = [c.seq for c in seen if c.op == "put" and c.seq > gone]
            last = max(seen, key=lambda c: c.seq)
            assert tuple(got) == ("x", min(puts) if last.op == "put" else None, last.content)
