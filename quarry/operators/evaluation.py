"""Metrics of ranked lists and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """recall, precision and ndcg at each k for every query with relevant ids. ranked: query_id, id, rank; relevant: query_id, id."""
    wanted = relevant.select("query_id", "id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(wanted, ["query_id", "id"], "left_semi").select("query_id", "id", "rank")
    told = sizes.join(hits, "query_id", "left")
    cols = []
    for k in ks:
        inside = F.col("rank") <= k
        found = F.count_distinct(F.when(inside, F.col("id")))
        gain = F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        cols += [F.round(found / F.col("n"), 6).alias(f"recall_{k}"), F.round(found / k, 6).alias(f"precision_{k}"), F.round(gain / ideal, 6).alias(f"ndcg_{k}")]
    return told.groupBy("query_id", "n").agg(*cols).drop("n")


def best_over_references(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The greatest value of each metric over the references of a row."""
    return scores.groupBy(*keys).agg(*(F.max(m).alias(m) for m in metrics))


def category_report(rows: DataFrame, metrics: list[str], error: str = "error") -> DataFrame:
    """A row for each category: rows, answered, failed, and means over answered rows."""
    ok = F.col(error).isNull()
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(ok).alias("answered"), F.count_if(~ok).alias("failed"), *(F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in metrics))


def macro_report(rows: DataFrame, dimension: DataFrame, metrics: list[str], error: str = "error") -> DataFrame:
    """Means for each category of the dimension (null where it has no answered row), and as category ``all`` the mean of the means, times 100."""
    means = rows.where(F.col(error).isNull()).groupBy("category").agg(*(F.avg(m).alias(m) for m in metrics))
    each = dimension.select("category").join(means, "category", "left")
    overall = each.agg(*(F.avg(m).alias(m) for m in metrics)).select(F.lit("all").alias("category"), *metrics)
    return each.unionByName(overall).select("category", *(F.round(100 * F.col(m), 4).alias(m) for m in metrics))


def missing_as_zero(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Sums and means in which a missing value is 0 and still counts."""
    zero = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.sum(zero(m)), 4).alias(f"sum_{m}") for m in metrics), *(F.round(F.sum(zero(m)) / F.greatest(F.count("*"), F.lit(1)), 6).alias(f"mean_{m}") for m in metrics))


def judge_report(rows: DataFrame, by: str) -> DataFrame:
    """Rows, judged, errors, correct and accuracy among judged. ``correct_all`` counts correct rows whatever their error."""
    ok = F.col("error").isNull()
    right = F.coalesce(F.col("correct"), F.lit(False))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("judged"), F.count_if(~ok).alias("errors"), F.count_if(ok & right).alias("correct"), F.count_if(right).alias("correct_all"), F.round(F.coalesce(F.count_if(ok & right) / F.nullif(F.count_if(ok), F.lit(0)), F.lit(0.0)), 6).alias("accuracy")
    )


def disagreement(rows: DataFrame, by: str) -> DataFrame:
    """How often two judges agree, or only one of them says correct."""
    a, b = F.coalesce("generous", F.lit(False)), F.coalesce("strict", F.lit(False))
    return rows.groupBy(by).agg(F.count_if(a & b).alias("both_correct"), F.count_if(a & ~b).alias("only_generous"), F.count_if(~a & b).alias("only_strict"), F.count_if(~a & ~b).alias("both_wrong"))


def token_signal(explicit: Column, prompt: Column, response: Column) -> tuple[Column, Column]:
    """(tokens, signal): counted tokens, else an estimate from prompt and response, else a lower bound of one."""
    quarter = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)
    tokens = F.when(explicit > 0, explicit).when(prompt.isNotNull() | response.isNotNull(), quarter(prompt) + quarter(response)).otherwise(1)
    signal = F.when(explicit > 0, "explicit").when(prompt.isNotNull() | response.isNotNull(), "estimate").otherwise("lower_bound")
    return tokens.cast("long"), signal


def session_scores(rows: DataFrame) -> DataFrame:
    """Of each task (key, seq, correct): the share of correct sessions, whether all are, and whether the last is."""
    return rows.groupBy("key").agg(F.count("*").alias("sessions"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("progress"), F.bool_and("correct").alias("all_correct"), F.max_by("correct", "seq").alias("last_correct"))


def shared_tokens(prompts: DataFrame) -> DataFrame:
    """Size of the multiset intersection of all prompts of a group (grp, id, tokens)."""
    n = prompts.groupBy("grp").agg(F.count_distinct("id").alias("prompts"))
    each = prompts.select("grp", "id", F.explode("tokens").alias("token")).groupBy("grp", "id", "token").agg(F.count("*").alias("k"))
    shared = each.groupBy("grp", "token").agg(F.count("*").alias("held"), F.min("k").alias("least")).join(n, "grp").where("held = prompts")
    return n.join(shared.groupBy("grp").agg(F.sum("least").alias("tokens")), "grp", "left").select("grp", "prompts", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def common_prefix(prompts: DataFrame) -> DataFrame:
    """How many tokens all prompts of a group begin with."""
    n = prompts.groupBy("grp").agg(F.count_distinct("id").alias("prompts"))
    at = prompts.select("grp", "id", F.posexplode("tokens").alias("at", "token")).groupBy("grp", "at").agg(F.count("*").alias("held"), F.min("token").alias("lo"), F.max("token").alias("hi"))
    same = at.join(n, "grp").withColumn("same", (F.col("held") == F.col("prompts")) & (F.col("lo") == F.col("hi")))
    broken = same.where("not same").groupBy("grp").agg(F.min("at").alias("stop"))
    longest = same.groupBy("grp").agg((F.max("at") + 1).alias("length"))
    return n.join(longest, "grp", "left").join(broken, "grp", "left").select("grp", "prompts", F.coalesce("stop", "length", F.lit(0)).cast("long").alias("tokens"))


def map_difference(after: Column, before: Column) -> Column:
    """Counters after less counters before; one that is new counts from 0."""
    return F.map_zip_with(after, before, lambda _, a, b: a - F.coalesce(b, F.lit(0)))


def phase_report(rows: DataFrame) -> DataFrame:
    """Episodes, successes, their share and mean steps by phase and kind, with totals of a phase as kind ``all``."""
    both = rows.select("phase", F.explode(F.array(F.col("kind"), F.lit("all"))).alias("kind"), "success", "steps")
    return both.groupBy("phase", "kind").agg(F.count("*").alias("n"), F.count_if("success").alias("successes"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"), F.round(F.avg("steps"), 6).alias("mean_steps"))


def running_best(rows: DataFrame) -> DataFrame:
    return rows.withColumn("best", F.max("value").over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def canonical_usage(build: Column, query: Column) -> Column:
    """One schema for the usage maps (name -> number) of both phases: a missing counter is 0, a missing utilisation stays null."""
    count = lambda *found: F.coalesce(*found, F.lit(0.0))
    return F.struct(
        count(F.try_element_at(build, F.lit("build_input_tokens")), F.try_element_at(build, F.lit("construction_input_tokens"))).cast("long").alias("t_build_input"),
        count(F.try_element_at(build, F.lit("build_output_tokens"))).cast("long").alias("t_build_output"),
        count(F.try_element_at(query, F.lit("prompt_tokens"))).cast("long").alias("t_query_input"),
        count(F.try_element_at(query, F.lit("completion_tokens"))).cast("long").alias("t_query_output"),
        count(F.try_element_at(query, F.lit("llm_seconds"))).alias("w_llm"),
        count(F.try_element_at(query, F.lit("retrieve_seconds"))).alias("w_tool"),
        count(F.try_element_at(build, F.lit("build_wallclock_seconds"))).alias("w_llm_build"),
        F.coalesce(F.try_element_at(query, F.lit("gpu_util_mean")), F.try_element_at(build, F.lit("gpu_util_mean"))).alias("gpu_util_mean"),
    )
