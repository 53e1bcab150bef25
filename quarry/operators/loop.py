"""Planned search for a table of questions at once: plans, results and verdicts are tables, and a round is one pass over the records.

A round plans all open questions (a planner is asked once for equal ones), scans the records once for all patterns of all
plans, and asks a judge about the observations so far; questions that it isn't content with stay open and are planned again with
its hint. Rounds are few; nothing is done question by question on the driver.

The scan goes by bounds. Literals that a pattern can't match without are taken from its parse tree; one automaton finds those of all
patterns in a text. How many lines hold one bounds how many a pattern can match, and with the terms that a record shares that
bounds its score. Regular expressions are only run where that reaches a question's k-th score of the task so far.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import plan as P
from quarry.operators import search as L
from quarry.sources.shared import arrow_rows, spool

#: Patterns that meet every record together, on average; lines that a query shows, and how long.
TOGETHER, LINES, WIDTH = 1 << 14, 5, 500
_PLAN = "query_id long, queries array<string>, filters array<string>, read_ids array<long>, top_k int, use_dump boolean, operations array<struct<op string, args array<string>>>"
FOUND = "query_id long, kind int, id long, score double, matches array<string>, n long, ids array<long>"
OBSERVATIONS = "query_id long, round int, stage int, at int, kind string, id string, score double, matches array<string>"


def required(pattern: str) -> list[str] | None:
    """Strings of lower-case ASCII letters and other characters, of which a text with a match holds one; None if there are none to tell. Case of ASCII letters is ignored."""
    from re import _parser as parser

    def best(found: list[list[str]]) -> list[str] | None:
        return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def walk(items) -> list[str] | None:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is parser.LITERAL:
                run += chr(arg).lower() if arg < 128 else chr(arg)
                continue
            if run:
                found.append([run])
                run = ""
            inner = None
            if op is parser.BRANCH:
                parts = [walk(b) for b in arg[1]]
                inner = [s for p in parts for s in p] if all(parts) else None
            elif op is parser.SUBPATTERN:
                inner = walk(arg[-1])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and arg[0] > 0:
                inner = walk(arg[2])
            elif op is parser.ATOMIC_GROUP:
                inner = walk(arg)
            if inner:
                found.append(list(dict.fromkeys(inner)))
        return best(found)

    return walk(parser.parse(pattern, re.I | re.A))


def spelled(pattern: str, most: int = 16) -> list[str] | None:
    """All strings that a pattern matches, as ``required`` writes them, where it is but a choice of a few of one line; else None. Such a text matches just if it holds one."""
    from re import _parser as parser

    def walk(items) -> list[str] | None:
        told = [""]
        for op, arg in items:
            if op is parser.LITERAL:
                some = [chr(arg).lower() if arg < 128 else chr(arg)]
            elif op is parser.IN and all(o is parser.LITERAL for o, _ in arg):
                some = walk_any([[x] for x in arg])
            elif op is parser.BRANCH:
                some = walk_any(arg[1])
            elif op is parser.SUBPATTERN and not arg[1] and not arg[2]:
                some = walk(arg[3])
            else:
                return None
            if some is None or len(told) * len(some) > most:
                return None
            told = [a + b for a in told for b in some]
        return told

    def walk_any(parts) -> list[str] | None:
        found = [walk(p) for p in parts]
        return None if any(f is None for f in found) else list(dict.fromkeys(s for f in found for s in f))

    told = walk(parser.parse(pattern, re.I | re.A))
    return told if told and all(s and "\n" not in s for s in told) else None


def _low(text: str) -> str:
    return text.encode("utf-8", "replace").lower().decode()


def _rounded(score: float) -> float:
    return float(Decimal(repr(score)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


class _Best:
    """The k best (score, id, matches): greatest score, then least id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def put(self, score: float, i: int, matches: list[str]) -> None:
        self.rows = sorted([*self.rows, (score, i, matches)], key=lambda x: (-x[0], x[1]))[: self.k]

    @property
    def last(self) -> tuple[float, int]:
        return (self.rows[-1][0], self.rows[-1][1]) if self.rows and len(self.rows) == self.k else ((-1.0, -1) if self.k else (float("inf"), -1))


class _Block:
    """A block of plans, prepared for a scan."""

    def __init__(self, plans: list[dict]):
        import ahocorasick
        import numpy as np

        self.plans = plans
        self.terms: dict[str, int] = {}
        sets: dict[tuple, int] = {}
        self.literals: dict[str, int] = {}
        self.compiled: dict[str, re.Pattern] = {}
        known: dict[str, list[int] | None] = {}
        exact: set[str] = set()

        def literals(pattern: str) -> list[int] | None:
            if pattern not in known:
                safe = P.safe_pattern(pattern)
                self.compiled[pattern] = re.compile(safe, re.A)
                found = spelled(safe)
                if found:
                    exact.add(pattern)
                found = found or required(safe)
                known[pattern] = None if found is None else [self.literals.setdefault(s, len(self.literals)) for s in found]
            return known[pattern]

        def numbered(words: list[str]) -> int:
            return sets.setdefault(tuple(sorted(self.terms.setdefault(w, len(self.terms)) for w in set(words))), len(sets))

        flat, starts, open_, anchors, shared, of = [], [], [], [], [], [0]
        self.own, self.exact, self.operations = [], [], []
        sought: dict[str, int] = {}
        for p in plans:
            for q, words in zip(p["patterns"], p["pattern_terms"], strict=True):
                found = literals(q)
                starts.append(len(flat))
                flat += found if found else [0]
                open_.append(found is None)
                anchors.append(bool(P.ANCHOR.search(q)))
                self.exact.append(q in exact)
                shared.append(numbered(words))
            of.append(len(starts))
            for f in p["filters"]:
                literals(f)
            self.own.append(numbered(p["own_terms"]))
            for o in p["operations"]:
                args = o["args"][:1] if o["op"] == "count" else o["args"]
                told = o["op"] in ("count", "union", "intersect") and args
                self.operations.append((o["op"], [sought.setdefault(a, len(sought)) for a in args] if told else []))
        self.flat, self.starts, self.open, self.anchors = np.array(flat, np.int64), np.array(starts, np.int64), np.array(open_, np.bool_), np.array(anchors, np.bool_)
        self.shared, self.of, self.own = np.array(shared, np.int64), of, np.array(self.own, np.int64)
        self.literals_of = [sorted(set(flat[a:b])) for a, b in zip(starts, [*starts[1:], len(flat)], strict=True)]
        # Patterns of set operations, each looked for once: their literals, those without, and those that literals alone decide.
        self.sought = [self.compiled[a].search if literals(a) is None or a not in exact else None for a in sought]
        self.sought_open = np.array([known[a] is None for a in sought], np.bool_)
        parts = [known[a] or [0] for a in sought]
        self.sought_flat = np.array([x for p in parts for x in p], np.int64)
        self.sought_starts = np.cumsum([0, *map(len, parts)])[:-1]
        of_told = [(at, args, op) for at, (op, args) in enumerate(self.operations) if args]
        self.told_at, self.told_flat = np.array([at for at, _, _ in of_told], np.int64), np.array([x for _, args, _ in of_told for x in args], np.int64)
        self.told_starts = np.cumsum([0, *(len(args) for _, args, _ in of_told)])[:-1]
        self.told_needs = np.array([1 if op == "union" else len(args) for _, args, op in of_told], np.int64)
        lists = [list(s) for s in sets]
        self.sizes = np.array([max(1, len(s)) for s in lists])
        self.set_flat = np.array([t for s in lists for t in (s or [len(self.terms)])], np.int64)  # an empty set: a term that no record has
        self.set_starts = np.cumsum([0, *(max(1, len(s)) for s in lists)])[:-1]
        self.numbers = np.arange(len(self.literals) + 1)
        self.automaton = ahocorasick.Automaton()
        for s, i in self.literals.items():
            self.automaton.add_word(s, i)
        if self.literals:
            self.automaton.make_automaton()
        self.hits = [_Best(p["top_k"]) for p in plans]
        self.instead = [_Best(p["top_k"]) for p in plans]
        # Of every operation how many records, and the first ids; an id from ``told_last`` on isn't one of them.
        self.told_n, self.told_ids = np.zeros(len(self.operations), np.int64), [[] for _ in self.operations]
        self.told_last = np.full(len(self.operations), np.iinfo(np.int64).max)
        self.reading = [(k, set(p["read_ids"])) for k, p in enumerate(plans) if p["read_ids"]]
        self.floor, self.floor_id = np.full(len(plans), -1.0), np.full(len(plans), -1)
        self.low, self.low_id = np.full(len(plans), -1.0), np.full(len(plans), -1)

    def scan(self, i: int, content: str, terms: list[str]) -> None:
        import numpy as np

        text = _low(content)
        lines = content.split("\n")
        count, held = np.zeros(max(1, len(self.literals)), np.int64), np.empty(0, np.int64)
        if self.literals and text:
            found = np.array([x for pair in self.automaton.iter(text) for x in pair], np.int64).reshape(-1, 2)
            at = np.searchsorted(np.flatnonzero(np.array([c == "\n" for c in text])) if len(lines) > 1 else np.empty(0, np.int64), found[:, 0])
            held = np.unique(found[:, 1] * (len(lines) + 1) + at)
            count = np.bincount(held // (len(lines) + 1), minlength=len(self.literals))
        present = np.zeros(len(self.terms) + 1)
        present[[self.terms[t] for t in terms if t in self.terms]] = 1.0
        overlap = np.add.reduceat(present[self.set_flat], self.set_starts) / self.sizes
        own = overlap[self.own]
        lined = np.where(self.open, LINES, np.minimum(LINES, np.add.reduceat(count[self.flat], self.starts)))
        most = overlap[self.shared] + 0.15 * lined + 2.0 * self.anchors
        most[self.anchors & (lined == 0)] = 0.0
        most = np.maximum.reduceat(most, self.of[:-1])
        # A score is rounded to four places, and of equal ones the lower id is better.
        able = (most > 0) & ((most > self.floor + 4.9e-5) | (most > self.floor - 5.1e-5) & (i < self.floor_id))
        where = ((held % (len(lines) + 1)).tolist(), np.searchsorted(held, self.numbers * (len(lines) + 1)).tolist()) if able.any() or self.reading else ()
        for k in np.flatnonzero(able).tolist():
            score, matches = self._exact(k, content, lines, overlap, lined, *where)
            if score > 0:
                self._hit(k, _rounded(score), i, matches)
        for k, wanted in self.reading:
            if i in wanted and not any(x[1] == i for x in self.hits[k].rows):
                score, _ = self._exact(k, content, lines, overlap, lined, *where)
                if score <= 0:
                    self._hit(k, 1.0, i, [])
        for k in np.flatnonzero((own + 1e-4 >= self.low) & ((own > self.low - 1e-4) | (i < self.low_id))).tolist():
            self.instead[k].put(_rounded(float(own[k])), i, [])
            self.low[k], self.low_id[k] = self.instead[k].last
        if len(self.told_at):
            found = self.sought_open | (np.add.reduceat(count[self.sought_flat], self.sought_starts) > 0)
            for a in np.flatnonzero(found).tolist():
                if self.sought[a] is not None:
                    found[a] = self.sought[a](content) is not None
            told = self.told_at[np.add.reduceat(found[self.told_flat].astype(np.int64), self.told_starts) >= self.told_needs]
            self.told_n[told] += 1
            for at in told[i < self.told_last[told]].tolist():
                ids = self.told_ids[at] = sorted([*self.told_ids[at], i])[: L.SHOWN]
                if len(ids) == L.SHOWN:
                    self.told_last[at] = ids[-1]

    def _hit(self, k: int, score: float, i: int, matches: list[str]) -> None:
        self.hits[k].put(score, i, matches)
        self.floor[k], self.floor_id[k] = self.hits[k].last

    def _lines(self, j: int, lines: list[str], held: list[int], at: list[int]) -> list[int]:
        """Of the lines those that hold a literal of a pattern, or all for one without. held: lines by literal; those of literal x from at[x] on."""
        if self.open[j]:
            return list(range(len(lines)))
        own = self.literals_of[j]
        return held[at[own[0]] : at[own[0] + 1]] if len(own) == 1 else sorted({n for x in own for n in held[at[x] : at[x + 1]]})

    def _exact(self, k: int, content: str, lines: list[str], overlap, lined, held: list[int], at_literal: list[int]) -> tuple[float, list[str]]:
        import numpy as np

        best: tuple[float, list[str]] = (0.0, [])
        plan = self.plans[k]
        filters = [self.compiled[f] for f in plan["filters"]]
        first, last = self.of[k], self.of[k + 1]
        most = overlap[self.shared[first:last]] + 0.15 * lined[first:last] + 2.0 * self.anchors[first:last]
        for at in np.argsort(-most, kind="stable").tolist():
            if most[at] + 1e-9 < best[0]:  # nor can one after it be better
                break
            j, q = first + at, plan["patterns"][at]
            found: list[str] = []
            if lined[j]:
                match = self.compiled[q].search
                for n in self._lines(j, lines, held, at_literal):
                    if self.exact[j] or match(lines[n]):
                        found.append(f"{n + 1}: {lines[n][:WIDTH]}")
                        if len(found) == LINES:
                            break
            score = float(overlap[self.shared[j]]) + 0.15 * len(found)
            if self.anchors[j]:
                score = score + 2.0 if found else 0.0
            elif filters:
                hay = "\n".join(found) if found else content
                score = score if all(f.search(hay) for f in filters) else 0.0
            best = max(best, (score, found))
        return best

    def results(self) -> Iterator[tuple]:
        """(query_id, kind, id, score, matches, n, ids): kind 0 hits, 1 the question's own ranking, from 2 on the plan's set operations."""
        done = 0
        for k, p in enumerate(self.plans):
            for kind, rows in enumerate((self.hits[k].rows, self.instead[k].rows)):
                yield from ((p["query_id"], kind, i, s, m, 0, []) for s, i, m in rows)
            for at in range(len(p["operations"])):
                yield p["query_id"], 2 + at, None, 0.0, [], int(self.told_n[done + at]), self.told_ids[done + at]
            done += len(p["operations"])


def planned(questions: DataFrame, planner: Callable[[list[str], list[str]], list[dict]], cached: bool = True) -> DataFrame:
    """The plans of questions (query_id, question, hint), within their limits. planner(questions, hints) gives raw plans; with ``cached`` it is asked once for questions that differ in case and blanks alone."""
    key = F.array_join(F.filter(F.split(F.lower("question"), r"\s+"), lambda w: w != ""), " ") if cached else F.col("query_id").cast("string")
    keyed = questions.withColumn("key", F.struct(key.alias("key"), "hint"))
    first = keyed.groupBy("key").agg(F.min(F.struct("query_id", "question")).alias("q"))

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, raw in zip(f["query_id"], planner(f["question"].tolist(), f["hint"].tolist()), strict=True):
                p = P.SearchPlan.of(raw)
                rows.append((i, p.queries, p.filters, p.read_ids, p.top_k, p.use_dump, [{"op": o, "args": a} for o, a in p.set_operations]))
            yield pd.DataFrame(rows, columns=["query_id", "queries", "filters", "read_ids", "top_k", "use_dump", "operations"])

    made = first.select("q.query_id", "q.question", "key.hint").mapInPandas(told, _PLAN).withColumnRenamed("query_id", "first")
    return keyed.join(first.select("key", F.col("q.query_id").alias("first")), "key").join(made, "first").drop("first", "key", "hint")


def scanned(records: DataFrame, plans: DataFrame) -> DataFrame:
    """What one pass over the records (id, content, and perhaps title) finds for all plans, of every task: query_id, kind, id, score, matches, n, ids."""
    asked = F.when(F.size("queries") > 0, F.col("queries")).otherwise(L.fallback_queries(F.col("question")))
    wide = plans.withColumn("patterns", L.grep_queries(F.col("question"), asked))
    whole = wide.select(
        "query_id",
        "patterns",
        F.transform("patterns", lambda q: P.grep_terms(F.concat(q, F.lit(" "), F.col("question")))).alias("pattern_terms"),
        P.grep_terms(F.col("question")).alias("own_terms"),
        "filters",
        "read_ids",
        "top_k",
        "operations",
    ).where("size(patterns) > 0")
    packed = spool(whole, "plans")
    blocks = max(1, ceil((packed.agg(F.sum(F.size("patterns"))).first()[0] or 0) / TOGETHER))
    named = F.concat_ws(" ", "title", "content") if "title" in records.columns else F.col("content")

    spark = records.sparkSession
    arrow_rows(spark, 200)
    rows = records.select("id", "content", P.grep_terms(named).alias("terms"))
    parts = []
    for b in range(blocks):  # TOGETHER patterns on average, so a block may be sent to every task, once
        block = packed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                if batch.num_rows and block is None:
                    block = _Block(sent.value.to_pylist())
                for i, content, terms in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    block.scan(i, content or "", terms)
            found = list(block.results()) if block else []
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["query_id", "kind", "id", "score", "matches", "n", "ids"])

        if block.num_rows:
            parts.append(rows.mapInArrow(scan, FOUND))
    if not parts:
        return spark.createDataFrame([], FOUND)
    return spool(reduce(DataFrame.unionByName, parts), "scanned")


def ranked(found: DataFrame, plans: DataFrame) -> DataFrame:
    """query_id, id, score, matches, rank of the best records; where a plan has no hit, of the question's own ranking."""
    rows = found.where("kind < 2").join(plans.select("query_id", "top_k"), "query_id")
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id")
    kept = rows.withColumn("rank", F.row_number().over(order)).where("rank <= top_k").withColumn("first", F.min("kind").over(Window.partitionBy("query_id")))
    return kept.where("kind = first").select("query_id", "id", "score", "matches", "rank")


def summed(found: DataFrame) -> DataFrame:
    """query_id, at, n and the first ids of the plans' set operations."""
    return found.where("kind >= 2").groupBy("query_id", (F.col("kind") - 2).alias("at")).agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, L.SHOWN).alias("ids"))  # ten of each task


def aggregated(found: DataFrame, plans: DataFrame, records: DataFrame, seen: DataFrame) -> DataFrame:
    """query_id, at, op and matches of the plans' set operations, and of temporal sorts over what was seen (query_id, id, rank)."""
    asked = plans.select("query_id", F.posexplode("operations").alias("at", "o")).select("query_id", "at", "o.op", F.size("o.args").alias("args"))
    sums = summed(found)
    shown = F.when(F.size("ids") > 0, F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).otherwise("none")
    n = F.concat(F.lit("count="), F.col("n").cast("string"))
    sets = asked.where("args > 0 and op in ('count', 'union', 'intersect')").join(sums, ["query_id", "at"], "left").na.fill(0, ["n"]).withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    told = sets.select("query_id", "at", "op", F.when(F.col("op") == "count", F.array(n)).otherwise(F.array(F.concat("op", F.lit("_ids="), shown), n)).alias("matches"))
    dated = P.temporal_order(records.join(seen.select("id").distinct(), "id", "left_semi")).select("id", "date")
    order = seen.join(dated, "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("date", "rank", "id"))).alias("d"))  # top_k of a question
    times = asked.where("op = 'temporal_sort'").join(order, "query_id").select("query_id", "at", "op", F.array(F.concat(F.lit("order="), F.array_join(F.transform("d", lambda x: x["id"].cast("string")), ","))).alias("matches"))
    return told.unionByName(times)


def _judged(told: DataFrame, asked: DataFrame, judge: Callable[[list[str], list[str]], list[dict]]) -> DataFrame:
    """query_id, question, hint of the questions that the judge isn't content with."""
    rows = told.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("round", "stage", "at", "kind", "id", "score", "matches"))).alias("seen"))  # bounded by the plans' limits
    both = asked.select("query_id", "question").join(rows, "query_id", "left")

    def verdicts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = [[{"kind": o["kind"], "id": o["id"], "score": o["score"], "matches": list(o["matches"])} for o in (s if s is not None else [])] for s in f["seen"]]
            found = [v or {} for v in judge(f["question"].tolist(), [L.context(s) for s in seen])]
            yield pd.DataFrame({"query_id": f["query_id"], "question": f["question"], "hint": [str(v.get("why_more") or "")[:400] for v in found], "enough": [bool(v.get("sufficient", True)) for v in found]})

    return both.mapInPandas(verdicts, "query_id long, question string, hint string, enough boolean").where("not enough").drop("enough")


def search_all(
    records: DataFrame,
    questions: DataFrame,
    planner: Callable[[list[str], list[str]], list[dict]],
    judge: Callable[[list[str], list[str]], list[dict]],
    variant: L.Variant = L.VARIANTS["nograph"],
    dump: Callable[[list[str]], list[str]] | None = None,
) -> DataFrame:
    """``OBSERVATIONS`` of all questions (query_id, question): of their first plans (round 0) and of those that the judge asked for.

    planner(questions, hints) gives raw plans, judge(questions, contexts) verdicts, dump(questions) answers; each sees batches. Graph
    templates are ``search.search``'s.
    """
    texts = questions.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"))
    asked = spool(texts.withColumn("hint", F.lit("")), "questions")
    told: DataFrame | None = None
    for turn in range(variant.rounds + 1):
        plans = spool(planned(asked, planner, variant.cache and turn == 0), "planned")
        found = scanned(records, plans)
        best = ranked(found, plans)
        parts = [best.select("query_id", F.lit(1).alias("stage"), F.col("rank").alias("at"), F.lit("record").alias("kind"), F.col("id").cast("string").alias("id"), "score", "matches")]
        if variant.aggregates and turn == 0:
            sets = aggregated(found, plans, records, best.select("query_id", "id", "rank"))
            parts.append(sets.select("query_id", F.lit(3).alias("stage"), "at", F.col("op").alias("kind"), F.lit("agg").alias("id"), F.lit(1.0).alias("score"), "matches"))
        if variant.dump and dump is not None and turn == 0:

            def dumped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    yield pd.DataFrame({"query_id": f["query_id"], "told": dump(f["question"].tolist())})

            answers = plans.where("use_dump").select("query_id", "question").mapInPandas(dumped, "query_id long, told string")
            parts.append(answers.select("query_id", F.lit(0).alias("stage"), F.lit(0).alias("at"), F.lit("dump").alias("kind"), F.lit("dump").alias("id"), F.lit(1.0).alias("score"), F.array("told").alias("matches")))
        now = spool(reduce(DataFrame.unionByName, parts).withColumn("round", F.lit(turn)), "observed")
        told = now if told is None else told.unionByName(now)
        if turn == variant.rounds:
            break
        asked = spool(_judged(told, asked, judge), "open")
        if asked.isEmpty():
            break
    return told.select("query_id", "round", "stage", "at", "kind", "id", "score", "matches")
