"""Listings of files, problems and notes: what the reads of an exam or a note return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["node_id", "no"]


def _filled(c: str):
    return F.coalesce(F.col(c), F.lit("")) != ""


def node_list(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with file (pages, problem_count, mode, pua_ratio; null for folders and files not read yet), folders first, then by name in code points. A missing section is exam."""
    f = files.select("node_id", F.struct("pages", "problem_count", "mode", "pua_ratio").alias("_file"))
    j = nodes.join(f, "node_id", "left")
    file = F.when((F.col("type") == "file") & F.col("_file.pages").isNotNull(), F.col("_file"))
    j = j.withColumn("section", F.coalesce(F.nullif("section", F.lit("")), F.lit("exam"))).withColumn("file", file).drop("_file")
    return j.orderBy("section", F.when(F.col("type") == "folder", 0).otherwise(1), "name", "node_id")


def file_details(problems: DataFrame, solutions: DataFrame) -> DataFrame:
    """The problems of each file by number, with their printed label and whether they have a solution and a transcript. Texts are not read."""
    solved = solutions.select(*KEY, F.lit(True).alias("_solved")).distinct()
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("no").cast("string"))
    kept = [c for c in ("page", "bbox", "transcript_source", "transcript_note") if c in problems.columns]
    narrow = problems.select(*KEY, label.alias("label"), *kept, _filled("transcript").alias("has_transcript"))
    return narrow.join(solved, KEY, "left").withColumn("has_solution", F.col("_solved").isNotNull()).drop("_solved").orderBy(*KEY)


def transcript_list(problems: DataFrame) -> DataFrame:
    """Transcripts and notes of problems that have either, by number."""
    return problems.filter(_filled("transcript") | _filled("transcript_note")).select(*KEY, "transcript", "transcript_source", "transcript_note").orderBy(*KEY)


def note_solutions(items: DataFrame, nodes: DataFrame, solutions: DataFrame) -> DataFrame:
    """(item_id, solution) of note items whose source lives and whose problem has a saved solution."""
    live = nodes.select(F.col("node_id").alias("source_node_id")).distinct()
    saved = solutions.select(F.col("node_id").alias("source_node_id"), "no", "solution")
    return items.join(live, "source_node_id", "left_semi").join(saved, ["source_node_id", "no"]).select("item_id", "solution")


def labelled_variants(variants: DataFrame, problems: DataFrame) -> DataFrame:
    """Variants with the printed label of their problem; none is the empty text."""
    labels = problems.select(*KEY, F.col("label").alias("_label"))
    return variants.join(labels, KEY, "left").withColumn("label", F.coalesce("_label", F.lit(""))).drop("_label")


def note_items(items: DataFrame) -> DataFrame:
    """O3: items of each note in the order they were added."""
    return items.orderBy("note_id", "created_at", "seq")


def type_dictionary(types: DataFrame) -> DataFrame:
    """By id, which is the order of subjects and units."""
    return types.orderBy("id")
