"""Quality rules: an ordered decision list learned by sequential covering, applied as one Spark conditional expression.

Statistics of a text come from built-in functions inside the row that holds it: nothing is exploded or shuffled, so a
hot source or group of copies cannot load one task. The learner sees a bounded sample of labelled statistics
(``max_rows``); it grows conjunctions of thresholds on one part, prunes them on the other, and keeps a rule only where
it is precise on both.

Defined results: a null or empty text has no words, fails the base rule and is rejected; a null doc_id is carried;
repeated rows each get the same answer; an empty table gives no rows; with no usable labels the list is empty and the
base rule alone decides; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, let, narrow

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Least words of an acceptable text, and the most words of a hundred that may lie in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _positions_repeated(grams: Column) -> Column:
    """Ascending positions of the values that occur twice or more."""
    order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    same = lambda s, k, d: F.coalesce(F.get(s, k + d)["g"] == F.get(s, k)["g"], F.lit(False))
    return let(order, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((k > 0) & same(s, k, -1) | same(s, k, 1), x["i"])), lambda i: i.isNotNull())))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words found twice or more in the text, the first occurrence included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + d) for d in range(WINDOW)))))
    covered = lambda g: F.aggregate(
        _positions_repeated(g),
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n")),
        lambda a: a["n"],
    )
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def statistics(text: Column) -> Column:
    """A struct of a text's statistics; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    has_word = lambda line: F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", ""))) > 0
    lines = F.filter(F.split(whole, "\n", -1), has_word)
    words = F.filter(F.split(whole, WHITE, -1), lambda w: w != "")
    return let(
        whole,
        lambda t: let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _count_of(t, SYMBOLS).alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                F.size(lines).cast("long").alias("n_lines"),
                repeated_words(w).alias("n_repeat_words"),
                _count_of(t, "!?").alias("n_shouts"),
                _count_of(t, "|").alias("n_bars"),
                _count_of(t, "0123456789").alias("n_digits"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            ),
        ),
    )


def features(s: Column) -> dict[str, Column]:
    """Ratios that the rules may test."""
    per = lambda a, b: F.coalesce(s[a] / F.nullif(s[b], F.lit(0)), F.lit(0.0)).cast("double")
    return {
        "words": s["n_words"].cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "shouts_per_word": per("n_shouts", "n_words"),
        "bars_per_word": per("n_bars", "n_words"),
        "digits_per_char": per("n_digits", "word_chars"),
        "upper_per_char": per("n_upper", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        c = cols[self.feature]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[tuple[dict, int]]) -> tuple[int, int]:
    """(bad, good) rows that the rule covers."""
    hit = [y for x, y in rows if all(c.holds(x) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _best_condition(rows: list[tuple[dict, int]], names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the most information gained about the bad class, over one sweep of each feature."""
    bad = sum(y for _, y in rows)
    if not bad or bad == len(rows):
        return 0.0, None
    before = log2(bad / len(rows))
    best, found = 0.0, None
    for name in names:
        order = sorted((x[name], y) for x, y in rows)
        p = n = 0
        for (value, y), (following, _) in zip(order, order[1:], strict=False):
            p, n = p + y, n + 1 - y
            if value == following:
                continue
            cut = (value + following) / 2
            for above, hits, misses in ((False, p, n), (True, bad - p, len(rows) - bad - n)):
                gain = hits * (log2(hits / (hits + misses)) - before) if hits else 0.0
                if gain > best + 1e-9:
                    best, found = gain, Condition(name, above, cut)
    return best, found


def learn(rows: list[tuple[dict[str, float], int]], min_precision: float = 0.95, min_support: int = 3, max_conditions: int = 4, max_rules: int = 16) -> list[Rule]:
    """Sequential covering. rows: (features, 1 where the text is bad), in an order that doesn't depend on the label."""
    names = sorted(rows[0][0]) if rows else []
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules and any(y for _, y in left):
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions and any(not y for _, y in inside):
            _, condition = _best_condition(inside, names)
            if condition is None:
                break
            rule += (condition,)
            inside = [r for r in inside if condition.holds(r[0])]
        if not rule:
            break

        def worth(r: Rule) -> float:
            p, n = _covered(r, prune)
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        (p, n), (gp, gn) = _covered(rule, prune), _covered(rule, grow)
        if p + gp < min_support or (p + gp) < min_precision * (p + gp + n + gn) or p < min_precision * (p + n):
            break
        rules.append(rule)
        left = [r for r in left if not all(c.holds(r[0]) for c in rule)]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> list[tuple[dict[str, float], int]]:
    """Features and labels of at most ``max_rows`` labelled documents, chosen and ordered by a hash of the id."""
    chosen = narrow(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(max_rows)
    small = F.broadcast(chosen)  # max_rows ids and labels at most
    stats = narrow(docs, "doc_id", "text").join(small, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "quality", statistics(F.col("text")).alias("s"))
    cols = features(F.col("s"))
    found = stats.select("doc_id", "quality", *(c.alias(n) for n, c in cols.items())).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").collect()
    return [({n: r[n] for n in cols}, int(r["quality"] == 0)) for r in found]


def verdict(s: Column, rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects, none keeps."""
    cols = features(s)
    chain = None
    for rule in rules:
        test = rule[0].column(cols)
        for c in rule[1:]:
            test = test & c.column(cols)
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def score(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed and kept, one row for each row of docs."""
    s = F.col("s")
    return (
        narrow(docs, "doc_id", "text")
        .select("doc_id", statistics(F.col("text")).alias("s"))
        .select("doc_id", *(s[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(s, rules)).alias("kept"))
    )


def keep(docs: DataFrame, rules: list[Rule], columns: tuple[str, ...]) -> DataFrame:
    """The given columns of the rows that are kept."""
    s = F.col("__s")
    return narrow(docs, *columns).withColumn("__s", statistics(F.col("text"))).where(~base_failed(s) & verdict(s, rules)).drop("__s")
