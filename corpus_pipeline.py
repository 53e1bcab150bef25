"""A corpus pipeline of five stages over ``documents``: quality rules, near duplicates, repeated substrings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, packing, pii, quality_rules, repeats
from quarry.llm.common import DOCUMENT, narrow, spool


#: A passage that goes has more than so many words; so many bytes have those words if each is one letter.
WORDS = 50
PASSAGE = 2 * (WORDS + 1) - 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned decision list rejects. The list is learned from the labelled rows of docs, 4000 at most.

    A null or empty text has no words and goes; repeated rows are judged alike; without labels only the base rule counts; an
    empty table stays empty.
    """
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality_rules.keep(docs, rules, DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the least id (a null one last), of repeated rows the first read.

    Texts that are null, empty or without words are in no group and stay; an empty table stays empty.
    """
    return jaccard.first_of_groups(docs, DOCUMENT)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of more than WORDS words that stand twice, within runs that repeated strings of PASSAGE bytes cover (``repeats.passages``).

    All copies go, as strings are judged on the input; a character cut by a removal goes whole. A null text stays null and an
    empty one empty; repeated rows (if near duplicates were left in) lose the same bytes; an empty table stays empty.
    """
    kept = repeats.remove(docs, ("doc_id", "lang", "source", "n_chars"), length=PASSAGE, anchor=PASSAGE // 2, texts=True, words=WORDS)
    return _counted(kept.withColumnRenamed("kept_text", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, by the names of their kinds. A null text stays null; repeated rows are rewritten alike; an empty table stays empty."""
    return _counted(pii.sanitise(docs, DOCUMENT))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is a piece of the end token alone; repeated rows have pieces of their own; an empty table has none."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*DOCUMENT)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings), ("personal_data", personal_data), ("pack", pack)]

#: The learned list, the components and the sorted suffixes can't be told in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), *DOCUMENT)
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
