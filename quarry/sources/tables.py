"""Readers and writers: JSON lines, dialogue samples, multi-hop contexts, manifests, pages, and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.answers import valid_json


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a line that is no JSON as a whole fails the read, or is left out. Blank lines are left out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    found = valid_json(F.col("value"))
    whole = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no JSON: "), F.col("value")))).otherwise(found) if strict else found
    return lines.select(F.from_json(whole, schema).alias("row")).where("row is not null").select("row.*")


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def dialogue_turns(samples: DataFrame, numeric: bool = True) -> DataFrame:
    """Turns of dialogue samples (sample_id, conversation as a JSON string): sessions by number, or by name as text; an image's caption goes first.

    conversation: session_N as a list of (speaker, text, dia_id, blip_caption), session_N_date_time as text.
    """
    turn = "array<struct<speaker:string,text:string,dia_id:string,blip_caption:string>>"
    keys = samples.select("sample_id", F.from_json("conversation", "map<string,string>").alias("m")).select("sample_id", "m", F.explode(F.map_keys("m")).alias("key")).where(F.col("key").rlike(r"^session_[0-9]+$"))
    order = F.split("key", "_")[1].cast("int") if numeric else F.col("key")
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(order))
    named = keys.select("sample_id", place.alias("session"), F.col("m")[F.concat("key", F.lit("_date_time"))].alias("ts_raw"), F.col("m")[F.col("key")].alias("turns"))
    rows = named.select("sample_id", "session", "ts_raw", F.posexplode(F.from_json("turns", turn)).alias("turn", "t"))  # numbered before the turns are rows
    text = F.concat_ws(" ", F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit("[Image: "), F.col("t.blip_caption"), F.lit("]"))), F.col("t.text"))
    return rows.select("sample_id", "session", "turn", F.col("t.speaker").alias("speaker"), text.alias("content"), "ts_raw")


def numbered_documents(text: Column) -> Column:
    """The documents of a context that marks them ``Document N:``."""
    return F.filter(F.transform(F.split(text, r"(?m)^Document [0-9]+:"), lambda t: F.trim(t)), lambda d: d != "")


def evidence(facts: Column) -> Column:
    """(title, index) facts as ``title:index``, joined by semicolons."""
    return F.array_join(F.transform(facts, lambda f: F.concat_ws(":", f["title"], f["sent_idx"].cast("string"))), ";")


def step_text(action: Column, observation: Column, index: Column) -> Column:
    """One line of a trajectory; a missing part is left out."""
    return F.concat_ws(" | ", F.concat(F.lit("[Turn "), index.cast("string"), F.lit("]")), F.concat(F.lit("Action: "), action), F.concat(F.lit("Observation: "), observation))


def sessions(tasks: DataFrame) -> DataFrame:
    """Sessions of tasks (id, questions, answers, backgrounds) by position; a single answer or background stands for all."""
    pick = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.get(c, F.col("session")))
    rows = tasks.select("id", "answers", "backgrounds", F.posexplode("questions").alias("session", "question"))
    return rows.select("id", "session", "question", pick("answers").alias("gold"), pick("backgrounds").alias("background"))


def manifest_scan(rows: DataFrame, manifest: DataFrame, limit: int) -> DataFrame:
    """The rows (idx) that a manifest (pos, idx) names, the first ``limit`` in its order."""
    return rows.join(manifest.orderBy("pos").limit(limit), "idx")


def titled_corpus(rows: DataFrame) -> DataFrame:
    """Bodies (seq, title, body) of equal titles joined by line feeds, at the first one's place."""
    return rows.groupBy("title").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "body"))), lambda r: r["body"]), "\n").alias("body"))


def unordered_digest(rows: DataFrame, by: str, id_: str, content: str) -> DataFrame:
    """A digest of each group that doesn't depend on the order of its rows (a key for stored indexes): of the rows' number and the sums of two 60-bit parts of their hashes, which combine before the shuffle."""
    each = F.sha2(F.concat_ws("\x1f", F.col(id_).cast("string"), F.coalesce(content, F.lit(""))), 256)
    part = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.select(by, each.alias("_h")).groupBy(by).agg(F.count("*").alias("n"), part(1).alias("_a"), part(16).alias("_b"))
    return sums.select(by, "n", F.sha2(F.concat_ws("\x1e", F.col("n").cast("string"), "_a", "_b"), 256).alias("digest"))


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def latest_results(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return results.withColumn("_at", at).where("_at = 1").drop("_at")


def first_urls(results: DataFrame) -> DataFrame:
    """Search results (call, pos, url): redirects unwrapped, each url at its first call only."""
    inner = F.regexp_extract("url", r"[?&]uddg=([^&]+)", 1)
    plain = results.withColumn("url", F.when(inner != "", F.url_decode(inner)).otherwise(F.col("url")))
    at = F.row_number().over(Window.partitionBy("url").orderBy("call", "pos"))
    return plain.withColumn("_at", at).where("_at = 1").drop("_at")


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """A table under a path, built and written where it isn't there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
