"""Reading and judging answers: markers, options, identifiers, JSON in free text, and the rules that pick an action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as X

# Answers that are compared as they are.
CLOSED_ANSWERS = ["yes", "no", "noanswer"]


def closed_answer_f1(prediction: Column, gold: Column, f1: Column) -> Column:
    """0 where either side is a closed answer and they differ, else the token F1."""
    a, b = X.normalise(prediction), X.normalise(gold)
    return F.when((a.isin(CLOSED_ANSWERS) | b.isin(CLOSED_ANSWERS)) & (a != b), 0.0).otherwise(f1)


def contains_either(a: Column, b: Column) -> Column:
    """Whether one normalised text holds the other."""
    x, y = X.normalise_spaced(a), X.normalise_spaced(b)
    return (F.contains(x, y) | F.contains(y, x)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 without tokens."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def first_choice(text: Column) -> Column:
    return F.regexp_extract(text, "[0-9]+", 0).try_cast("int")


def marked_answer(text: Column) -> Column:
    """What follows the answer marker, up to the next marker; the whole text without one."""
    mark = r"(?is)###\s*Answer\s*:\s*(.*?)(?=###|\z)"
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = bare(F.regexp_extract(text, mark, 1))
    return F.when(found != "", found).otherwise(bare(text))


def last_line(text: Column) -> Column:
    """The last line that isn't blank."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda t: t != ""), F.lit(-1)), F.lit(""))


def bounded_read(text: Column, pattern: str, around: int = 2, most: int = 3) -> Column:
    """The lines within ``around`` of the first matching lines; the beginning of a text without any."""
    lines = F.split(text, "\n")
    hits = F.slice(F.filter(F.transform(lines, lambda t, i: F.when(t.rlike(pattern), i)), lambda i: i.isNotNull()), 1, most)
    kept = F.filter(F.transform(lines, lambda t, i: F.when(F.exists(hits, lambda h: F.abs(h - i) <= around), t)), lambda t: t.isNotNull())
    return F.when(F.size(hits) > 0, F.array_join(kept, "\n")).otherwise(F.substring(text, 1, 200))


def json_object(text: Column) -> Column:
    """The first ``{...}`` of a text without nesting, fenced or not."""
    return F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)


def picked_action(text: Column, commands: Column) -> Column:
    """The admissible command that a reply names: as it is, else in any case, else the longest that it holds."""
    said = F.trim(text)
    same = F.filter(commands, lambda c: c == said)
    alike = F.filter(commands, lambda c: F.lower(c) == F.lower(said))
    held = F.array_sort(F.transform(F.filter(commands, lambda c: F.contains(F.lower(said), F.lower(c))), lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c"))))
    return F.coalesce(F.get(same, F.lit(0)), F.get(alike, F.lit(0)), F.get(held, F.lit(0))["c"])


def synthetic_id(name: Column) -> Column:
    """B and the first nine digits of a name's SHA-1, in upper case."""
    return F.concat(F.lit("B"), F.upper(F.substring(F.sha1(name), 1, 9)))


def condensed(text: Column, most: int) -> Column:
    """A search query: the first distinct content words."""
    return F.array_join(F.slice(F.array_distinct(X.keywords(text)), 1, most), " ")


def sufficiency(wanted: Column, found: Column, best: Column, second: Column, sources: Column, margin: float = 0.1) -> Column:
    """Four predicates on evidence: all wanted terms found, a clear best, more than one source, something to show."""
    return F.struct(
        (F.size(F.array_except(wanted, found)) == 0).alias("covered"),
        (best - F.coalesce(second, F.lit(0.0)) >= margin).alias("clear"),
        (sources > 1).alias("diverse"),
        (F.size(found) > 0).alias("renderable"),
    )


# JSON in free text.


def valid_json(text: Column) -> Column:
    """The text where it is one JSON value and nothing after it, else null."""
    listed = F.concat(F.lit("["), text, F.lit("]"))  # a parser stops after the first value, but not within a list
    return F.when(F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1), text)


def json_array(text: Column) -> Column:
    """The first complete ``[...]`` of a text, brackets in strings not counted; null without one."""
    rest = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\[.*", 0)
    # Strings, an unfinished string, brackets, and what lies between.
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|".*+|[\[\]]|[^"\[\]]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "[", 1).when(t == "]", -1).otherwise(0)
        n = a["n"] + F.length(t)
        return F.struct(depth.alias("depth"), n.alias("n"), F.when((a["end"] == 0) & (depth == 0), n).otherwise(a["end"]).alias("end"))

    end = F.aggregate(tokens, start, step, lambda a: a["end"])
    return F.when(end > 0, F.substring(rest, F.lit(1), end))


def json_value(text: Column) -> Column:
    """The JSON in a reply: the whole text, else the first fenced block (only that, if there is one), else from the first brace to the last; null where that is no JSON."""
    t = F.coalesce(text, F.lit(""))
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(valid_json(F.nullif(_bare(t), F.lit(""))), F.when(t.rlike(fence), valid_json(F.nullif(F.regexp_extract(t, fence, 1), F.lit("")))).otherwise(valid_json(F.nullif(braces, F.lit("")))))


def marked_array(text: Column, marker: str) -> Column:
    """The JSON array after a marker in any case; null without marker or array."""
    at = F.locate(marker.upper(), F.upper(F.coalesce(text, F.lit(""))))
    return F.when(at > 0, valid_json(json_array(F.substring(text, at + len(marker), F.length(text)))))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_leaves(text: Column) -> Column:
    """The values of a JSON text that are no objects, lists, keys or nulls, as text."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|-?[0-9][0-9.eE+-]*|true|false'), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.endswith(":"))
    return F.transform(values, lambda t: F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]"))


# Judges of multi-session answers.


def _loose(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def identifier(text: Column) -> Column:
    """The first product identifier, B and nine capitals or digits; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\bB[A-Z0-9]{9}\b", 0), F.lit(""))


def holds_gold(prediction: Column, gold: Column) -> Column:
    return F.contains(_loose(prediction), _loose(gold))


# Labels that are no content of an answer.
ANSWER_LABELS = ["answer", "final", "exact", "confidence", "month", "country", "poem", "book"]


def exact_answer(text: Column) -> Column:
    """What a text gives as its exact answer, up to its confidence; else the text before that, if it is one line of twelve words or less; else null."""
    return X.let(_bare(F.coalesce(text, F.lit(""))), lambda raw: F.when(text.isNotNull(), _stated(raw)))


def _stated(raw: Column) -> Column:
    # The patterns of the labels, here and below.
    confidence = r"(?:\*\*)?\s*Confidence\s*(?:\*\*)?\s*:"
    marked = rf"(?is)(?:\*\*)?\s*Exact\s+Answer\s*(?:\*\*)?\s*:\s*(.+?)(?:\n\s*{confidence}|\z)"
    line = lambda c: F.regexp_replace(_bare(c), r"\s+", " ")
    given = F.regexp_replace(line(F.regexp_extract(raw, marked, 1)), r"^[ *]+|[ *]+$", "")
    before = _bare(F.split(raw, f"(?i){confidence}", 2)[0])
    plain = F.regexp_replace(F.regexp_replace(before, r"(?i)^\s*(?:\*\*)?\s*(?:Answer|Final Answer)\s*(?:\*\*)?\s*:\s*", ""), r"^[ *\n\t]+|[ *\n\t]+$", "")
    short = lambda c: (c != "") & (F.size(X.split_words(c)) <= 12) & ~F.contains(c, F.lit("\n"))
    return F.when(raw.rlike(marked), given).otherwise(X.let(plain, lambda c: F.when(short(c), line(c))))


def progressive_correct(prediction: Column, gold: Column) -> Column:
    """Whether a final answer is right: the exact answers are equal, one holds the gold one, or all its content words are there; without a gold exact answer, whether the gold text is held."""
    tokens = lambda c: F.array_except(F.array_distinct(X.words(c)), F.array(*map(F.lit, ANSWER_LABELS)))

    def against(want: Column, said: Column) -> Column:
        inside = X.let(tokens(want), lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, tokens(said))) == 0))
        return F.when(F.coalesce(want, F.lit("")) != "", F.contains(_loose(said), _loose(want)) | inside).otherwise(holds_gold(prediction, gold))

    return X.let(exact_answer(gold), lambda want: X.let(F.coalesce(exact_answer(prediction), prediction, F.lit("")), lambda said: against(want, said)))


def leaf_recall(prediction: Column, gold_json: Column) -> Column:
    """(matched, total, score): how many of a structured plan's leaves a prediction holds; blanks and dashes don't count."""
    leaves = F.filter(F.transform(json_leaves(gold_json), _loose), lambda x: (x != "") & (x != "-"))
    score = lambda some, n: F.struct(some.alias("matched"), n.alias("total"), F.when(n > 0, some / n).otherwise(0.0).alias("score"))
    held = lambda found, said: X.let(F.size(F.filter(found, lambda x: F.contains(said, x))), lambda some: score(some, F.size(found)))
    return X.let(leaves, lambda found: X.let(_loose(prediction), lambda said: held(found, said)))


# Predictions as they are scored.

# How a reply abstains, and the phrase that stands for it; beginnings of yes/no questions; what leans to either answer.
ABSTAINED = "Not mentioned in the conversation"
ABSTENTIONS = ["not mentioned", "not explicitly mentioned", "not mentioned in the conversation", "unknown", "i don't know", "cannot determine", "can't determine"]
BINARY = "^(would|will|is|are|do|does|did|can|could|should|has|have|had|was|were) "
NEGATIVE = ["likely no", "no,", " no ", "would not", "wouldn't", "unlikely", "not likely", "not pursue"]
POSITIVE = ["likely yes", "yes,", " yes ", "would still", "would continue", "likely", "probably"]


def _quotes(text: Column) -> Column:
    return _bare(F.btrim(_bare(text), F.lit("\"'")))


def dialogue_prediction(raw: Column, category: Column, question: Column) -> Column:
    """A dialogue answer as it is scored: thoughts and fences out, last line, abstentions as one phrase; category 5 always abstains, a yes/no question of category 3 becomes likely yes or no."""
    text = F.coalesce(raw, F.lit(""))
    cleaned = text
    # What is cut from a reply.
    for pattern in (r"(?i)```(?:json)?", r"(?is)<think>.*?</think>", r"(?is)<tool_call>.*?</tool_call>", r"(?is)^\s*<think>.*$"):
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    line = _quotes(F.regexp_replace(last_line(cleaned), r"(?i)^\s*answer\s*:\s*", ""))
    low = F.lower(line)
    cue = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    no, yes = cue(NEGATIVE), cue(POSITIVE)
    leans = (category == 3) & F.lower(F.trim(F.coalesce(question, F.lit("")))).rlike(BINARY)
    abstains = F.trim(F.regexp_replace(low, "[.!]+$", "")).isin(ABSTENTIONS)
    empty = F.when(F.contains(F.lower(text), F.lit(ABSTAINED.lower())), ABSTAINED).otherwise("")
    return F.when(F.coalesce(category == 5, F.lit(False)) | abstains, ABSTAINED).when(_bare(cleaned) == "", empty).when(leans & no & ~yes, "Likely no").when(leans & yes & ~no, "Likely yes").otherwise(line)


def hop_prediction(raw: Column) -> Column:
    """A multi-hop answer as it is scored: after the last marker, the last line of the last paragraph, without lead-ins, its first sentence; yes, no and no answer in one spelling."""
    plain = F.coalesce(raw, F.lit(""))
    # What is cut from a reply, and the patterns of its markers below.
    for pattern in (r"(?is)<think>.*?</think>", r"(?is)<tool_call>.*?</tool_call>"):
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.btrim(F.btrim(_bare(plain), F.lit("`")), F.lit("\"'"))
    after = F.nullif(_bare(F.regexp_extract(plain, r"(?is)^.*#{2,}\s*answer\s*:\s*(\S.*)$", 1)), F.lit(""))
    told = F.coalesce(after, plain)
    named = lambda p: F.filter(F.transform(F.regexp_extract_all(told, F.lit(p), F.lit(1)), _bare), lambda t: t != "")
    final, answer = named(r"(?im)^\s*final\s+answer\s*:\s*(.+?)\s*$"), named(r"(?im)^\s*answer\s*:\s*(.+?)\s*$")
    told = F.coalesce(F.try_element_at(final, F.lit(-1)), F.try_element_at(answer, F.lit(-1)), told)
    paragraph = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(told, r"\n\s*\n"), _bare), lambda t: t != ""), F.lit(-1)), _bare(told))
    lines = F.filter(F.transform(F.split(paragraph, "\n"), _bare), lambda t: (t != "") & ~t.rlike(r"(?i)^#{2,}\s*(reasoning|answer)\s*:?$"))
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.nullif(paragraph, F.lit("")), _bare(plain))
    line = F.regexp_replace(_bare(F.regexp_replace(line, r"(?i)^#{2,}\s*(reasoning|answer)\s*:\s*", "")), r"(?i)^reasoning\s*:\s*", "")
    line = F.btrim(_bare(line), F.lit("\"'"))
    lead = _bare(F.regexp_replace(line, "(?i)^(the answer is |answer is |final answer: |answer: |it is )", ""))
    short = _quotes(F.split(_bare(F.regexp_replace(lead, r"(?i)^(yes|no)[,;:]\s+", "")), r"[.!?]\s+", 2)[0])
    return F.when(plain == "", "").when(line.rlike(r"(?i)^yes[.!]?$"), "yes").when(line.rlike(r"(?i)^no[.!]?$"), "no").when(line.rlike(r"(?i)^no\s*answer[.!]?$"), "noanswer").otherwise(F.coalesce(F.nullif(short, F.lit("")), _bare(plain)))


def task_description(text: Column, kind: Column) -> Column:
    """An embodied task's text for comparison: lower case, without the room's introduction and the look around, after its kind; the kind alone without a text."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_bare(F.coalesce(text, F.lit("")))), r"\s+", " "), r"you are in the [^.]+\.\s*", ""), r"\blook around\b", ""))
    own = F.trim(F.coalesce(kind, F.lit("")))
    return F.when(_bare(F.coalesce(text, F.lit(""))) == "", own).when(own != "", F.concat(F.lower(own), F.lit(" | "), bare)).otherwise(bare)
