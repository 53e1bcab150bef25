"""Texts at the boundary to models: retrieval hints and answer prompts, as column expressions. Their wording is free; what they hold and when is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hints by question category: 2 temporal, 3 open or counterfactual, 5 perhaps unanswerable.
CATEGORY_HINTS = {2: "look for dates and for what came before or after", 3: "look for what makes an inference likely", 5: "look whether it is said at all"}
CATEGORY_HINT = "look for what is said directly"
#: Hints by kind of task or domain.
DOMAIN_HINTS = (("embodied", "look for places of objects, contents, state changes and the actions behind them"), ("web", "look for clicked elements, filled fields, addresses and page contents"), ("sql", "look for tables, joins, operators and the rows returned"))
DOMAIN_HINT = "look for actions and observations on the question"
HOPS = ("", "look for bridging entities and linked pages", "look for the answer itself and the last supporting sentence")
NOTHING = "Not mentioned in the conversation."


def _hinted(question: Column, hint: Column) -> Column:
    return F.concat(F.trim(F.coalesce(question, F.lit(""))), F.lit("\n\nRetrieval hint: "), hint)


def category_query(question: Column, category: Column) -> Column:
    hint = F.lit(CATEGORY_HINT)
    for k, text in CATEGORY_HINTS.items():
        hint = F.when(category == k, text).otherwise(hint)
    return _hinted(question, hint)


def domain_kind(task: Column, domain: Column) -> Column:
    """embodied, web, sql or other, by a task's type first and its domain's name."""
    t, d = F.lower(F.trim(F.coalesce(task, F.lit("")))), F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    return (
        F.when((t == "alfworld") | F.contains(d, F.lit("embodied")), "embodied")
        .when((t == "webarena") | (d == "web"), "web")
        .when((t == "spider2") | F.contains(d, F.lit("sql")) | F.contains(t, F.lit("text2sql")), "sql")
        .otherwise("other")
    )


def domain_query(question: Column, task: Column, domain: Column) -> Column:
    kind, hint = domain_kind(task, domain), F.lit(DOMAIN_HINT)
    for name, text in DOMAIN_HINTS:
        hint = F.when(kind == name, text).otherwise(hint)
    return _hinted(question, hint)


def hop_queries(question: Column) -> Column:
    """A question as it is and with each hint, once each; none for a blank one."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return F.array_distinct(F.filter(F.array(*(q if not h else F.concat(q, F.lit(f"\n\nRetrieval hint: {h}")) for h in HOPS)), lambda t: t != ""))


def answer_prompt(question: Column, context: Column, category: Column) -> Column:
    """A dialogue question with its snippets: category 5 asks for the abstention, 3 forbids it, the others allow it; 2 asks for dates."""
    how = (
        F.when(category == 5, f"Reply exactly: {NOTHING}")
        .when(category == 3, "Infer the likeliest answer from the snippets; don't abstain. A yes/no question is answered Likely yes or Likely no where it isn't certain.")
        .otherwise(f"Answer shortly from the snippets. Only without any evidence reply exactly: {NOTHING}")
    )
    dates = F.when(category == 2, "Give dates or the order of events where possible.\n").otherwise("")
    return F.concat(how, F.lit("\n\nMemory snippets:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n\n"), dates, F.lit("Return only the answer."))


def session_prompt(question: Column, overall: Column, background: Column, memory: Column, domain: Column) -> Column:
    """A session's task: its domain, the whole task where it is another text, background and memory (or that there is none), the question."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    whole = F.when((bare(overall) != "") & (bare(overall) != bare(question)), F.concat(F.lit("Whole task:\n"), bare(overall), F.lit("\n\n"))).otherwise("")
    return F.concat(
        F.lit("Domain: "), domain, F.lit("\n\n"), whole,
        F.lit("Background:\n"), F.coalesce(F.nullif(bare(background), F.lit("")), F.lit("None")),
        F.lit("\n\nMemory of earlier sessions:\n"), F.coalesce(F.nullif(bare(memory), F.lit("")), F.lit("None (first session).")),
        F.lit("\n\nTask:\n"), question, F.lit("\n\nReturn only the final answer."),
    )
