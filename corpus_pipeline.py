"""Documents to a training mix: quality, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import decontaminate, mixing, ngram_join, quality, secrets
from examlake.llm.shared import table, written

#: The stages fit a model and look for components, so SQL cannot give their rows; tests compare them with brute force.
ORACLE_SQL = None


def _renamed(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator's result has."""
    return docs.withColumnsRenamed({c: f"doc__{c}" for c in docs.columns})


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"doc__{c}").alias(c) for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on labelled rows of ``docs``, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(_renamed(docs), model, text_col="doc__text")
    return scored.filter(quality.keeps(F.col("p_good"), F.col("doc__text"), model)).select(*_columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents linked by a Jaccard similarity of 0.75 of five-word shingles, the one of the smallest id.

    Of rows of one id and text one stays, the first by its other columns; rows without an id link with nothing, so of each text one stays.
    Rows of one id and different texts go by their id.
    """
    groups = ngram_join.jaccard_groups(docs.select("doc_id", "text"))
    kept = written(groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")))
    once = docs.join(kept.filter("n = 1"), "doc_id", "left_semi")
    repeated = docs.join(kept.filter("n > 1"), "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    return once.unionByName(_one_of_alike(repeated)).select(*docs.columns)


def _one_of_alike(rows: DataFrame) -> DataFrame:
    """Of rows of one id and text, the one whose other columns come first as JSON; combined by each task before the shuffle."""
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    if not others:
        return rows.distinct()
    rest = F.struct(*others)
    return rows.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("rest")).select("doc_id", "text", *(F.col("rest")[c].alias(c) for c in others))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a benchmark window."""
    found = decontaminate.matches(_renamed(docs), table(spark, sf_dir, "benchmark"), text_col="doc__text")
    return found.filter(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(*_columns(docs))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret; documents stay. Where the text has changed, n_chars follows."""
    found = secrets.find_secrets(_renamed(docs), text_col="doc__text")
    if "n_chars" in docs.columns:
        chars = F.when(F.size("secrets") > 0, F.char_length("doc__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc__n_chars"))
        found = found.withColumn("doc__n_chars", chars)
    return found.select(*_columns(docs))


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.taken(*mixing.mixture(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", secrets_masked),
    ("mixing sources to target weights", mixed_by_source),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
