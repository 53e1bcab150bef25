"""The loop over a table of questions against the loop of one question, and literals that patterns need."""

import random
import re

import pytest

from quarry.operators import loop
from quarry.operators import search as L


@pytest.mark.parametrize(
    "pattern,literals",
    [
        ("Moron", ["moron"]),
        (r"foo\-bar", ["foo-bar"]),
        ("red.*boat|boat.*red", ["boat", "boat"]),
        ("alpha|be", ["alpha", "be"]),
        ("(?:abc){2}x?", ["abc"]),
        (r"Step\s+12\s*:", ["step"]),
        ("[ab]c", ["c"]),
        ("x?|long", None),
        (r"\d+", None),
        (".*", None),
        ("", None),
        ("Ünï", ["Ünï"]),
    ],
)
def test_required(pattern, literals):
    found = loop.required(pattern)
    assert (found and sorted(set(found))) == (literals and sorted(set(literals)))


def test_required_is_sound():
    r = random.Random(3)
    atoms = ["a", "b", "cd", "E", r"\-", "[ab]", ".", r"\d", "(x|yz)", "(?:ab)+", "c?", "e{2,3}", "d*"]
    texts = ["".join(r.choice("abcdexyz-E1\n") for _ in range(r.randint(0, 25))) for _ in range(120)]
    told = 0
    for _ in range(300):
        pattern = "|".join("".join(r.choices(atoms, k=r.randint(1, 4))) for _ in range(r.randint(1, 3)))
        found = loop.required(pattern)
        told += found is not None
        for t in texts:
            if found is not None and re.search(pattern, t, re.I | re.A):
                assert any(s in loop._low(t) for s in found), (pattern, t)
    assert told > 100


WORDS = "red boat sails over blue water while clowns watch from far-off hills and nobody's counting turns".split()


def stand_ins():
    """Functions that go to the workers by value."""

    def plans(question, hint):
        if hint:
            return {"queries": [hint, "[bad"], "filters": ["e"], "top_k": 3}
        kind = len(question) % 4
        return [
            {"queries": ["boat.*water", "clown|hill"], "top_k": 4, "read_ids": [2, 5], "aggregate_ops": [{"op": "union", "args": ["boat", "zzz", r"\d\d"]}, {"op": "count", "args": ["red", "x"]}, {"op": "temporal_sort"}, {"op": "intersect", "args": ["b.at", "w[ae]ter"]}]},
            {"queries": [], "top_k": 2, "aggregate_ops": [{"op": "intersect", "args": ["qqq", "boat"]}, {"op": "odd", "args": ["x"]}]},
            {"queries": ["red"], "filters": ["nothing has this"], "top_k": 3, "read_ids": [1, 99]},
            {"queries": [r"Turn\s+7\s*:"], "filters": ["blue"], "top_k": 5},
        ][kind]

    def verdict(question, seen):
        return {"sufficient": len(question) % 3 != 0, "why_more": "water"} if len(question) % 5 else {}

    return plans, verdict


def test_all_questions_as_one_by_one(spark, monkeypatch):
    plans, verdict = stand_ins()
    r = random.Random(4)
    text = lambda: "\n".join(" ".join(r.choices(WORDS, k=r.randint(0, 8))) for _ in range(r.randint(0, 7)))
    rows = [(i, r.choice(["", "2024-01-0%d\n" % (i % 9 + 1)]) + text() + r.choice(["", f"\nTurn {i % 9}: red boat 42", "\nRED"])) for i in range(60)] + [(60, ""), (61, "line\n" * 9 + "Red " * 300)]
    records = spark.createDataFrame(rows, "id long, content string").repartition(3)
    questions = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 9)))) for i in range(10)] + [(20, "what happens at step 7 and turn 3"), (21, 'say "red boat" again')]
    questions += [(22, questions[0][1].upper() + "  ")]
    monkeypatch.setattr(loop, "TOGETHER", 60)  # several blocks
    asked = spark.createDataFrame(questions, "query_id long, question string")
    got = {}
    found = loop.search_all(records, asked, lambda qs, hs: [plans(q, h) for q, h in zip(qs, hs, strict=True)], lambda qs, cs: [verdict(q, c) for q, c in zip(qs, cs, strict=True)], L.Variant(graph=False, cache=False), dump=lambda qs: [q.upper() for q in qs])
    for x in found.orderBy("query_id", "round", "stage", "at").collect():
        got.setdefault(x["query_id"], []).append((x["round"], x["stage"], x["kind"], x["id"], round(x["score"], 4), list(x["matches"])))
    assert {o[0] for os in got.values() for o in os} == {0, 1, 2}
    for i, q in questions[:4] + questions[-3:]:
        alone = L.search(records, q, plans, verdict, L.Variant(graph=False, cache=False), dump=lambda _, question: question.upper())
        assert got[i] == [(x["round"], x["stage"], x["kind"], x["id"], round(x["score"], 4), list(x["matches"])) for x in alone.collect()], q


def test_plans_are_cached_and_edges(spark):
    asked = spark.createDataFrame([(1, "Red  boat", ""), (2, "red boat ", ""), (3, "blue", "")], "query_id long, question string, hint string")
    made = lambda cached: {x["query_id"]: x["queries"] for x in loop.planned(asked, lambda qs, hs: [{"queries": [f"{len(qs)} {q}"]} for q in qs], cached).collect()}
    with_cache = made(True)
    assert with_cache[1] == with_cache[2] and "Red  boat" in with_cache[1][0] and made(False)[1] != made(False)[2]
    records = spark.createDataFrame([(1, "red boat")], "id long, content string")
    none = loop.search_all(records.where("false"), asked.drop("hint"), lambda qs, hs: [{"queries": ["red"]} for _ in qs], lambda qs, cs: [{} for _ in qs])
    assert none.count() == 0
    assert loop.search_all(records, asked.drop("hint").where("false"), lambda qs, hs: [], lambda qs, cs: []).count() == 0


@pytest.mark.parametrize("pattern,strings", [("(?i)Moron", ["moron"]), (r"foo\-bar", ["foo-bar"]), ("text|tests|b", ["text", "tests", "b"]), ("(ab|c)d", ["abd", "cd"]), ("Ünï", ["Ünï"]), ("a|", None), ("a.*b", None), (r"a\nb", None), ("[^a]b", None), ("^a", None), ("(?!)", None)])
def test_spelled(pattern, strings):
    found = loop.spelled(pattern)
    assert (found and sorted(found)) == (strings and sorted(strings))
    r = random.Random(5)
    for _ in range(200 if strings else 0):
        text = "".join(r.choice(["Moron", "foo-bar", "te", "xt", "sts", "A", "b", "c", "D", "Ünï", "ünï", "\n"]) for _ in range(4))
        assert bool(re.search(pattern, text, re.I | re.A)) == any(s in loop._low(text) for s in strings)


def test_words_are_counted_without_expressions():
    """Lines and set operations of plain words come from the one pass over the literals, in whatever order records are read."""
    operations = [{"op": "count", "args": ["red", "x"]}, {"op": "union", "args": ["boat", "sky"]}, {"op": "intersect", "args": ["boat", "red"]}]
    plan = {"query_id": 1, "patterns": ["red", "boat|sky"], "pattern_terms": [["red"], ["boat"]], "own_terms": ["red"], "filters": [], "read_ids": [], "top_k": 2, "operations": operations}
    block = loop._Block([plan])

    class Never:
        def search(self, text):
            raise AssertionError(text)

    block.compiled = {p: Never() for p in block.compiled}
    texts = {i: ["Red boat\nsky", "a RED\nred red\nx", "none", "boat"][i % 4] for i in range(40)}
    for i in sorted(texts, key=lambda i: i * 7 % 40):
        block.scan(i, texts[i], texts[i].lower().split())
    got = {(kind, i): (score, lines, n, ids) for _, kind, i, score, lines, n, ids in block.results()}
    assert got[0, 0][:2] == (1.3, ["1: Red boat", "2: sky"]) and got[0, 1][:2] == (1.3, ["1: a RED", "2: red red"])
    told = [got[2 + k, None][2:] for k in range(3)]
    assert told == [(20, [0, 1, 4, 5, 8, 9, 12, 13, 16, 17]), (20, [0, 3, 4, 7, 8, 11, 12, 15, 16, 19]), (10, list(range(0, 40, 4)))]
