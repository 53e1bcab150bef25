"""State reports in Markdown: objectives, changes and states, read by folds over the lines of a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The headings of a report's sections, in order.
SECTIONS = ("# OBJECTIVES", "# STATE_CHANGES", "# STATES")
_PAIR = "struct<key:string,value:string>"
_OBJECT = f"struct<name:string,state:array<{_PAIR}>>"


def _section(report: Column, at: int) -> Column:
    """The text between a heading and the next one's first place after it; nothing without the heading."""
    rest = "(?s)" + SECTIONS[at] + (rf"(.*?)(?:{SECTIONS[at + 1]}|\z)" if at + 1 < len(SECTIONS) else r"(.*)")
    return F.regexp_extract(F.replace(F.coalesce(report, F.lit("")), F.lit("\r\n"), F.lit("\n")), rest, 1)


def _lines(section: Column) -> Column:
    return F.filter(F.transform(F.split(section, "\n"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _pair(item: Column) -> Column:
    return F.struct(_bare(F.substring_index(item, ":", 1)).alias("key"), _bare(F.regexp_replace(item, "(?s)^[^:]*:?", "")).alias("value"))


def objectives(report: Column) -> Column:
    """(name, description) of the numbered lines ``1. name: description`` that have a name."""
    numbered = F.filter(_lines(_section(report, 0)), lambda t: t.rlike(r"^\d+\."))
    pairs = F.transform(numbered, lambda t: _pair(F.regexp_replace(t, r"^\d+\.\s*", "")))
    return F.filter(F.transform(pairs, lambda p: F.struct(p["key"].alias("name"), p["value"].alias("description"))), lambda o: o["name"] != "")


def changed(report: Column, field: str) -> Column:
    """Whether a field of the changes (``env_changed`` or ``objective_changed``) is true; a missing one is not."""
    return F.lower(F.regexp_extract(_section(report, 1), rf"(?im)^{field}:\s*(true|false)\s*$", 1)) == "true"


def evidence(report: Column) -> Column:
    """The items under ``evidence:``, without quotes; another line ends them."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("ended"), F.array().cast("array<string>").alias("items"))

    def step(a: Column, t: Column) -> Column:
        head, item = F.lower(t) == "evidence:", t.startswith("-")
        bare = F.btrim(F.btrim(_bare(F.substring(t, F.lit(2), F.length(t))), F.lit('"')), F.lit("'"))
        taken = a["inside"] & ~a["ended"] & item & (bare != "")
        return F.struct((a["inside"] | head).alias("inside"), (a["ended"] | a["inside"] & ~item & ~head).alias("ended"), F.when(taken, F.concat(a["items"], F.array(bare))).otherwise(a["items"]).alias("items"))

    return F.aggregate(_lines(_section(report, 1)), start, step, lambda a: a["items"])


def states(report: Column) -> Column:
    """(env, objects): the environment's pairs, and the named objects with their pairs."""
    none = F.array().cast(f"array<{_PAIR}>")
    start = F.struct(F.lit("").alias("mode"), F.lit(False).alias("state"), none.alias("env"), F.array().cast(f"array<{_OBJECT}>").alias("objects"))

    def step(a: Column, t: Column) -> Column:
        mode = F.when(t == "env_state:", "env").when(t == "object_states:", "objects").otherwise(a["mode"])
        turned = t.isin("env_state:", "object_states:")
        named = ~turned & (mode == "objects") & t.startswith("- name:")
        item = ~turned & ~named & t.startswith("- ")
        pair = _pair(F.substring(t, F.lit(3), F.length(t)))
        keyed = item & (pair["key"] != "")
        n = F.size(a["objects"])
        open_object = F.struct(_bare(F.regexp_replace(t, r"^- name:", "")).alias("name"), none.alias("state")).cast(_OBJECT)
        last = F.get(a["objects"], n - 1)
        grown = F.concat(F.slice(a["objects"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["name"].alias("name"), F.concat(last["state"], F.array(pair)).alias("state")).cast(_OBJECT)))
        return F.struct(
            mode.alias("mode"),
            F.when(turned | named, F.lit(False)).when((mode == "objects") & (t == "state:"), F.lit(True)).otherwise(a["state"]).alias("state"),
            F.when(keyed & (mode == "env"), F.concat(a["env"], F.array(pair))).otherwise(a["env"]).alias("env"),
            F.when(named, F.concat(a["objects"], F.array(open_object))).when(keyed & (mode == "objects") & a["state"] & (n > 0), grown).otherwise(a["objects"]).alias("objects"),
        )

    return F.aggregate(_lines(_section(report, 2)), start, step, lambda a: F.struct(a["env"].alias("env"), a["objects"].alias("objects")))


def parsed(report: Column) -> Column:
    s = states(report)
    return F.struct(
        objectives(report).alias("objectives"),
        changed(report, "env_changed").alias("env_changed"),
        changed(report, "objective_changed").alias("objective_changed"),
        evidence(report).alias("evidence"),
        s["env"].alias("env"),
        s["objects"].alias("objects"),
    )


def inventory(reports: DataFrame) -> DataFrame:
    """Each key's objectives by name with the first description, in the order of their first report (key, seq, report): key, place, name, description."""
    from pyspark.sql import Window

    rows = reports.select("key", "seq", F.posexplode(objectives(F.col("report"))).alias("at", "o")).select("key", F.struct("seq", "at").alias("place"), "o.*")
    first = rows.groupBy("key", "name").agg(F.min("place").alias("place"), F.min_by("description", "place").alias("description"))
    return first.select("key", F.row_number().over(Window.partitionBy("key").orderBy("place")).alias("place"), "name", "description")
