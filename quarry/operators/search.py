"""Planned search as a loop: what a question asks for by itself, dispatch of a plan in order, aggregates, and a judge that may ask for more.

Planner, judge and dump are functions (the boundary to models). Records and graphs stay in DataFrames; to the driver come only
observations, whose number a plan's limits bound.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import plan as P

# What a question asks for, as arrays of patterns.

# What counts as a word of a question, how far around a step is read, and how long a range may be.
_WORD = "[A-Za-z0-9][A-Za-z0-9_'/-]+"
_REACH, _RANGE = 6, 30


def _escaped(term: Column) -> Column:
    return F.replace(term, F.lit("-"), F.lit("\\-"))


def _any_of(terms: Column) -> Column:
    return F.array_join(F.transform(terms, _escaped), "|")


def fallback_queries(question: Column) -> Column:
    """Patterns of a question without a plan: its quoted phrases, eight of its terms, four of them as alternatives; its beginning where it has none."""
    found = F.filter(F.regexp_extract_all(question, F.lit(_WORD), F.lit(0)), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(X.GREP_STOPWORDS))
    quoted = F.regexp_extract_all(question, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0))
    phrase = F.trim(F.array_join(F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), " "))
    several = F.when(F.size(found) >= 2, F.array(_any_of(F.slice(found, 1, 4)))).otherwise(F.array().cast("array<string>"))
    asked = F.slice(F.filter(F.concat(F.array(phrase), F.slice(found, 1, 8), several), lambda q: q != ""), 1, 8)
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(F.substring(question, 1, 80)))


def anchors(question: Column) -> Column:
    """Numbers of the steps that a question names: ranges of at most thirty, and six around each."""
    low = F.lower(question)
    # How a question names a range of steps, and below one of them.
    pair = r"\b(?:between|from)\s+(?:step|turn)\s+(\d+)\s+(?:and|to|-)\s+(?:step|turn)?\s*(\d+)"
    numbers = lambda p, g: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(g)), lambda n: n.try_cast("int"))
    ends = F.filter(F.zip_with(numbers(pair, 1), numbers(pair, 2), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))), lambda r: r["b"] - r["a"] <= _RANGE)
    ranged = F.flatten(F.transform(ends, lambda r: F.sequence(r["a"], r["b"])))
    near = F.flatten(F.transform(F.filter(numbers(r"\b(?:step|turn)\s+(\d+)\b", 1), lambda n: n.isNotNull()), lambda n: F.sequence(F.greatest(n - _REACH, F.lit(0)), n + _REACH)))
    return F.array_distinct(F.concat(ranged, near))


def grep_queries(question: Column, queries: Column, most: int = 64) -> Column:
    """All patterns to look for: the plan's, the anchors as step and as turn, the question's terms, neighbouring terms in either order, and any of the terms."""
    terms = P.grep_terms(question)
    steps = F.flatten(F.transform(anchors(question), lambda n: F.array(F.concat(F.lit(r"Step\s+"), n.cast("string"), F.lit(r"\s*:")), F.concat(F.lit(r"Turn\s+"), n.cast("string"), F.lit(r"\s*:")))))
    both = F.filter(F.zip_with(F.slice(terms, 1, 12), F.slice(terms, 2, 12), lambda a, b: F.concat(_escaped(a), F.lit(".*"), _escaped(b), F.lit("|"), _escaped(b), F.lit(".*"), _escaped(a))), lambda p: p.isNotNull())
    every = F.array(_any_of(F.slice(terms, 1, 12)))
    told = F.transform(F.concat(queries, steps, F.transform(F.slice(terms, 1, 16), _escaped), both, every), lambda q: F.trim(q))
    return F.slice(F.array_distinct(F.filter(told, lambda q: q != "")), 1, most)


# The loop.


@dataclass(frozen=True)
class Variant:
    """Which tools a method may use, and how many more plans a judge may ask for."""

    aggregates: bool = True
    dump: bool = True
    cache: bool = True
    graph: bool = True
    summarise: bool = False
    stable_prompt: bool = False  # the corpus first in a prompt and the question last, so that servers reuse the beginning
    gate: bool = True  # of cheap plans, by estimated cost
    catalogue: bool = True  # only a selection of records is shown to the planner
    rounds: int = 2


_ONE = Variant(aggregates=False, dump=False, cache=False)
_COST = Variant(graph=False)
VARIANTS: dict[str, Variant] = {
    "full": Variant(),
    "u1": replace(_ONE, aggregates=True),
    "u2": replace(_ONE, dump=True),
    "u3": replace(_ONE, cache=True),
    "nograph": Variant(graph=False),
    "sum": Variant(dump=False, summarise=True),
    "graph": Variant(graph=True),
    "kv": Variant(stable_prompt=True),
    "graph_kv": Variant(graph=True, stable_prompt=True),
    "single": Variant(dump=False, rounds=0),
    "oneretry": Variant(dump=False, rounds=1),
    "graph_single": Variant(graph=True, dump=False, rounds=0),
    "graph_oneretry": Variant(graph=True, dump=False, rounds=1),
    "cost": _COST,
    "cost_spc": replace(_COST, summarise=False, gate=False, catalogue=True),
    "cost_spc_gs": replace(_COST, gate=False),
    "kvcache": replace(_COST, stable_prompt=True),
}


@dataclass
class Caches:
    """What a corpus remembers between questions on the driver: first plans by normalised question and dump answers, the oldest going first."""

    most: int = 2048
    plans: OrderedDict = field(default_factory=OrderedDict)
    dumps: OrderedDict = field(default_factory=OrderedDict)

    def get(self, kind: str, key: str, make: Callable[[], object]):
        held = getattr(self, kind)
        if key not in held:
            held[key] = make()
            if len(held) > self.most:
                held.popitem(last=False)
        return held[key]


OBSERVATIONS = "round int, stage int, kind string, id string, score double, matches array<string>"
#: Rows that one graph query shows, and ids that one aggregate shows.
SHOWN = 10


def _key(question: str) -> str:
    return " ".join(question.lower().split())


def context(observations: list, limit: int = 12_000) -> str:
    """What a judge reads: the observations in order, cut in the middle."""
    told = "\n\n".join(f"[{o['id']}] {o['kind']} | score={o['score']}\n" + "\n".join(o["matches"] or ["None"]) for o in observations)
    return told if len(told) <= limit else f"{told[: limit // 2]}\n...[truncated]...\n{told[-(limit // 2) :]}"


def _scanned(records: DataFrame, plan: P.SearchPlan, question: str, scans: dict) -> tuple[list, list | None]:
    """The best records, and of every set operation how many ids and the first: one pass over the records (``loop.scanned``), once for equal plans."""
    from quarry.operators import loop

    key = (question, repr(plan))
    if key not in scans:
        spark = records.sparkSession
        asked = spark.range(1).select(fallback_queries(F.lit(question)).alias("own"), F.lit(0))
        queries = plan.queries or asked.first()["own"]
        wide = spark.range(1).select(grep_queries(F.lit(question), F.array(*map(F.lit, queries))).alias("q")).first()["q"]
        if not wide or records.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
            scans[key] = P.execute(records, plan, question, wide).orderBy("rank").collect(), None  # top_k rows
        else:
            row = (0, question, plan.queries, plan.filters, plan.read_ids, plan.top_k, plan.use_dump, [{"op": op, "args": args} for op, args in plan.set_operations])
            plans = spark.createDataFrame([row], f"query_id long, question string, {loop._PLAN.partition(', ')[2]}")
            found = loop.scanned(records, plans)
            sums = {r["at"]: (r["n"], r["ids"]) for r in loop.summed(found).collect()}  # a row for each set operation
            scans[key] = loop.ranked(found, plans).orderBy("rank").collect(), [sums.get(at, (0, [])) for at in range(len(plan.set_operations))]  # top_k rows
    return scans[key]


def _searched(records: DataFrame, plan: P.SearchPlan, question: str, scans: dict) -> list[dict]:
    return [{"stage": 1, "kind": "record", "id": str(r["id"]), "score": float(r["score"]), "matches": list(r["matches"])} for r in _scanned(records, plan, question, scans)[0]]


def _graphed(graph: DataFrame | None, plan: P.SearchPlan) -> list[dict]:
    told = []
    for at, (name, args) in enumerate(plan.graph_queries if graph is not None else []):
        rows = P.TEMPLATES[name](graph, **args).limit(SHOWN).collect()  # ten rows
        told.append({"stage": 2, "kind": "graph", "id": f"graph_q{at + 1}", "score": 1.0, "matches": [", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows]})
    return told


def _aggregated(records: DataFrame, plan: P.SearchPlan, question: str, seen: list[dict], scans: dict) -> list[dict]:
    """Set operations over all records' matches; the first ids are shown with how many there are (``plan.set_operation`` gives all). A temporal sort orders the records seen."""
    told, sets = [], _scanned(records, plan, question, scans)[1]
    for at, (op, args) in enumerate(plan.set_operations):
        if op == "temporal_sort":
            ids = [o["id"] for o in seen if o["kind"] == "record"]
            # In the order of what was seen where dates are equal.
            dated = {str(r["id"]): r["date"] for r in P.temporal_order(records.where(F.col("id").cast("string").isin(ids))).collect()} if ids else {}  # rows seen
            order = sorted((i for i in dict.fromkeys(ids) if i in dated), key=dated.get)
            matches = [f"order={','.join(order)}"] if order else []
        elif op in ("count", "intersect", "union") and args and sets is not None:
            n, ids = sets[at]
            matches = ([] if op == "count" else [f"{op}_ids={','.join(map(str, ids)) or 'none'}"]) + [f"count={n}"]
        elif op == "count" and args:
            matches = [f"count={P.set_operation(records, op, args[:1]).first()['n']}"]
        elif op in ("intersect", "union") and args:
            ids = P.set_operation(records, op, args)
            matches = [f"{op}_ids={','.join(str(r['id']) for r in ids.orderBy('id').limit(SHOWN).collect()) or 'none'}", f"count={ids.count()}"]
        else:
            matches = []
        if matches:
            told.append({"stage": 3, "kind": op, "id": "agg", "score": 1.0, "matches": matches})
    return told


def search(
    records: DataFrame,
    question: str,
    planner: Callable[[str, str], dict],
    judge: Callable[[str, str], dict],
    variant: Variant = VARIANTS["full"],
    graph: DataFrame | None = None,
    dump: Callable[[DataFrame, str], str] | None = None,
    caches: Caches | None = None,
    scans: dict | None = None,
) -> DataFrame:
    """Observations (``OBSERVATIONS``) of a question's first plan (round 0) and of the plans that a judge asked for.

    A round's order is dump, records, graph rows; aggregates follow the first. planner(question, hint) gives a raw plan,
    judge(question, context) whether that is ``sufficient`` (a silent judge is content) and ``why_more``. ``scans``: what passes over these records
    found, where several searches share them.
    """
    spark, scans = records.sparkSession, {} if scans is None else scans
    caches = caches if caches is not None and variant.cache else Caches()
    plan = P.SearchPlan.of(caches.get("plans", _key(question), lambda: planner(question, "")))
    told: list[dict] = []
    if plan.use_dump and variant.dump and dump is not None:
        told.append({"stage": 0, "kind": "dump", "id": "dump", "score": 1.0, "matches": [str(caches.get("dumps", question, lambda: dump(records, question)))]})
    told += _searched(records, plan, question, scans)
    if variant.graph:
        told += _graphed(graph, plan)
    if variant.aggregates:
        told += _aggregated(records, plan, question, told, scans)
    told = [t | {"round": 0} for t in told]
    for again in range(1, variant.rounds + 1):
        verdict = judge(question, context(told)) or {}
        if verdict.get("sufficient", True):
            break
        plan = P.SearchPlan.of(planner(question, str(verdict.get("why_more") or "")[:400]))
        more = _searched(records, plan, question, scans) + (_graphed(graph, plan) if variant.graph else [])
        told += [t | {"round": again} for t in more]
    return spark.createDataFrame([tuple(t[k] for k in ("round", "stage", "kind", "id", "score", "matches")) for t in told], OBSERVATIONS)


# Broad requests.


def is_broad(task: Column, question: Column) -> Column:
    """Whether a question of a long-range task asks for the whole: to summarise, or for plot and characters."""
    t, q = F.lower(F.coalesce(task, F.lit(""))), F.lower(F.coalesce(question, F.lit("")))
    # What marks such tasks and questions.
    kind = F.contains(t, F.lit("category: lru")) | F.contains(t, F.lit("long-range understanding"))
    whole = [F.contains(q, F.lit(p)) for p in ("write a summary", "summarize the book", "summarize the story", "write about the plot", "plot and characters")]
    return kind & (whole[0] | whole[1] | whole[2] | whole[3] | whole[4])


def stratified(rows: DataFrame, k: int) -> DataFrame:
    """k rows of each key (key, seq from 0) spread evenly, as a broad request reads them: their rank from 0 and a score that falls by a hundredth."""
    from pyspark.sql import Window

    from quarry.operators.windows import spread

    at = F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1
    return spread(rows, k).withColumn("rank", at).withColumn("score", F.round(1.0 - 0.01 * F.col("rank"), 4))
