"""Personal data: patterns for the base kinds, and information-theoretic sanitisation of the terms around them.

Base kinds are found by regular expressions in the row that holds the text. The pieces between matches and the matches
themselves give the places of both, so a text is passed over once for each kind. The patterns are possessive and start
only where a match may start: they take time in proportion to the text, and find what the plain patterns find.

An entity is a matched value. A term is a word of three letters or more within ``REACH`` characters of an entity, whatever
stands between them: the reach is counted in the text, before the mention's start and after its end, and only words inside
valid mentions are no terms. The reach is part of the definition: what stands by an entity tells of it, and pairs of every
mention with every word of a document would grow with the square of its length. A word that gives an entity away from
further off is not found. Over the whole corpus, n(e, t) is the number of documents with the term near the entity, n(e) and n(t) those with either.
The pointwise mutual information log2(n(e, t) N / (n(e) n(t))) over the entity's own information log2(N / n(e)) is the
share of the entity that the term gives away. Terms seen near it in ``MIN_SUPPORT`` documents or more that give away
``THRESHOLD`` or more are spans of kind ``term`` where they stand near that entity, and generalised by ``sanitise``.

Pairs are made only within reach of a mention, so their number is in proportion to the text; all counts combine before
they are shuffled. Defined results: a null text is empty and has no spans; nulls in other columns are carried; repeated
rows are separate documents, each with its spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, narrow, spool

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{L}[\p{L}'-]{2,}+"
REACH, MIN_SUPPORT, THRESHOLD = 80, 2, 0.9
_BLOCK, _PAGE = 256, 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + let(F.substring(digits, -i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda n: (F.length(n) < 3) | (F.length(n) == 3) & (n <= "255")))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _places(text: Column, pattern: str, make) -> Column:
    """``make(start, end, value)`` of every match."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def told(p: Column, m: Column) -> Column:
        steps = F.zip_with(p, m, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
        sums = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / _BLOCK).cast("int")), lambda k: F.aggregate(F.slice(s, k * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))
        base = lambda b: F.transform(b, lambda _, k: F.aggregate(F.slice(b, F.lit(1), k), F.lit(0), lambda a, x: a + x))

        def start(s: Column, b: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return F.get(b, block) + F.aggregate(F.slice(s, block * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda a, x: a + x) + F.length(F.get(p, i))

        return let(steps, lambda s: let(let(sums(s), base), lambda b: F.transform(m, lambda v, i: let(start(s, b, i), lambda at: make(at, at + F.length(v), v)))))

    return let(found, lambda m: F.when(F.size(m) > 0, let(pieces, lambda p: told(p, m))))


def _words(context: Column, first: Column) -> Column:
    """(term, start, end) of the words of a short string that starts at a place."""
    return F.coalesce(_places(context, WORD, lambda a, b, v: F.struct(F.lower(v).alias("term"), (first + a).alias("start"), (first + b).alias("end"))), F.array().cast("array<struct<term:string,start:int,end:int>>"))


def _pages(text: Column) -> Column:
    """The text in pages of ``_PAGE`` characters, so that a place is looked up without a pass over the text.

    E-mails are blank. Other mentions have no letters, so no word stands in them.
    """
    mail = PATTERNS["email"]
    blank = F.zip_with(F.split(text, mail, -1), F.regexp_extract_all(text, F.lit(mail), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))))
    return F.regexp_extract_all(F.array_join(blank, ""), F.lit(f"(?s).{{1,{_PAGE}}}"), F.lit(0))


def _between(pages: Column, start: Column, end: Column) -> Column:
    page = lambda at: F.floor(at / _PAGE).cast("int")
    return F.substring(F.array_join(F.slice(pages, page(start) + 1, page(end) - page(start) + 1), ""), start % _PAGE + 1, end - start)


def _near(pages: Column, at: Column, end: Column) -> Column:
    """The words within reach of a mention. One character more shows whether the reach cuts a run of letters, apostrophes and hyphens; such a run is left out."""
    left = let(_between(pages, F.greatest(at - REACH - 1, F.lit(0)), at), lambda c: F.when(F.length(c) > REACH, F.regexp_replace(c, r"\A[\p{L}'-]+", "")).otherwise(c))
    right = let(_between(pages, end, end + REACH + 1), lambda c: F.when(F.length(c) > REACH, F.regexp_replace(c, r"[\p{L}'-]+\z", "")).otherwise(c))
    return F.concat(let(left, lambda c: _words(c, at - F.length(c))), let(right, lambda c: _words(c, end)))


def mentions(text: Column, near: bool = False) -> Column:
    """Valid base matches of a text as (start, kind, end, value) in order; with ``near`` also the terms around each."""
    found = []
    for k, kind in enumerate(KINDS[:4]):
        make = lambda a, b, v, k=k, kind=kind: F.when(
            _valid(kind, v), F.struct(a.alias("start"), F.lit(k).alias("kind"), b.alias("end"), v.alias("value"))
        )
        found.append(F.filter(F.coalesce(_places(text, PATTERNS[kind], make), F.array()), lambda m: m.isNotNull()))
    base = F.sort_array(F.concat(*found))
    if not near:
        return base
    told = lambda p, m: F.struct(*(m[n].alias(n) for n in ("start", "kind", "end", "value")), _near(p, m["start"], m["end"]).alias("near"))
    return let(base, lambda b: F.coalesce(F.when(F.size(b) > 0, let(_pages(text), lambda p: F.transform(b, lambda m: told(p, m)))), F.array()))


def find(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns, ``base`` (start, kind, end, value) and ``terms`` (start, end) of every row, stored in the shared folder."""
    text = F.coalesce("text", F.lit(""))
    rows = narrow(docs, *dict.fromkeys(("text", *columns))).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn("__found", mentions(text, near=True)).withColumn("__words", F.when(F.size("__found") >= 0, F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))))
    stored = spool(rows.select("__row", *columns, "__found"), "mentions")

    # The pairs of a document, once each; the same spans again when the decided pairs are known.
    pairs = stored.where(F.size("__found") > 0).select("__row", F.explode("__found").alias("m")).select("__row", F.col("m.value").alias("entity"), F.explode("m.near").alias("w")).select("__row", "entity", "w.*")
    documents = stored.count()
    entities = stored.select(F.explode(F.array_distinct(F.transform("__found", lambda m: m["value"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    distinct = F.array_distinct(F.flatten(F.transform("__found", lambda m: F.transform(m["near"], lambda w: F.struct(m["value"].alias("entity"), w["term"].alias("term"))))))
    joint = stored.where(F.size("__found") > 0).select(F.explode(distinct).alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= MIN_SUPPORT)
    words = rows.select(F.explode("__words").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    wanted = joint.join(words, "term").join(entities, "entity")
    own = F.log2(F.lit(documents) / F.col("n_e"))
    shared = F.log2(F.col("n_et") * F.lit(documents) / (F.col("n_e") * F.col("n_t")))
    telling = spool(wanted.where((own > 0) & (shared >= THRESHOLD * own)).select("entity", "term"), "telling")
    terms = pairs.join(telling, ["entity", "term"]).groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms"))
    base = F.transform("__found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return stored.select("__row", *columns, base.alias("base")).join(terms, "__row", "left").select("__row", *columns, "base", F.coalesce("terms", empty).alias("terms"))


def _all(base: Column, terms: Column) -> Column:
    """Base and term spans as (start, kind, end), in order."""
    return F.sort_array(
        F.concat(
            F.transform(base, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))),
            F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end"))),
        )
    )


def told(spans: Column) -> Column:
    """kind:start:end of (start, kind, end) spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, the base spans' digest and all spans of every row."""
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(docs).select("doc_id", *(count(k) for k in range(4)), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(_all(F.col("base"), F.col("terms"))).alias("spans"))


def sanitise(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns with ``text`` rewritten: each run of overlapping spans becomes the name of its first kind in brackets."""
    others = tuple(c for c in columns if c != "text")
    found = find(docs, (*others, "text"))
    runs = F.aggregate(
        _all(F.col("base"), F.col("terms")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["parts"], F.array(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), s["kind"])), F.lit("]")))).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    clean = F.when(F.col("text").isNotNull() & (F.size("base") > 0), runs).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*columns)
