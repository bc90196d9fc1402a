"""The corpus pipeline: documents through five stages of ``kvitok.llm``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvitok.llm.common import stored, table
from kvitok.llm.decontamination import find_contamination
from kvitok.llm.languages import keep_identified, train
from kvitok.llm.lines import dedup_lines
from kvitok.llm.mixing import mix_sources
from kvitok.llm.near_duplicates import near_duplicate_classes


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model learns from the labelled documents of the input."""
    return keep_identified(docs, train(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand elsewhere first; ``n_chars`` follows the text."""
    out = dedup_lines(docs).withColumn("n_chars", F.when(F.col("line_stats.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest id, rows of a null id after all others.

    Rows of a null id are classed by an id that their text gives, so copies among them collapse too. Of
    rows that repeat an id one stays; only such rows are dealt by id, and only ids that go travel to the join.
    """
    # Ids made from texts lie beyond 2**62, so they are no smallest ones of a class.
    own = F.xxhash64("text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    key = F.coalesce(F.col("doc_id").cast("long"), own)
    keyed = docs.withColumn("_near_key", key)
    classes = near_duplicate_classes(keyed.select(F.col("_near_key").alias("doc_id"), "text"))
    gone = stored(classes.where("class_id != doc_id").select(F.col("doc_id").alias("_near_key")), "pipeline-near")
    left = keyed.join(gone, "_near_key", "left_anti")
    repeated = left.groupBy("_near_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_near_key")
    repeated = stored(repeated, "pipeline-repeated")
    order = [F.xxhash64("text"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]]
    several = left.join(repeated, "_near_key", "left_semi")
    first = several.withColumn("_near_nth", F.row_number().over(Window.partitionBy("_near_key").orderBy(*order))).where("_near_nth = 1")
    return left.join(repeated, "_near_key", "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words running of a benchmark item, judged by their texts alone.

    Only hashes of contaminated texts travel to the join.
    """
    found = find_contamination(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias("_leak_id")).distinct(), "pipeline-leaks")
    return docs.join(gone, F.xxhash64("text") == F.col("_leak_id"), "left_anti")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source has the same share; ``copy`` numbers the repetitions."""
    return mix_sources(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
]

#: No SQL: naive Bayes over hashed trigrams and MinHash classes are not expressed in it; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that training sees."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
