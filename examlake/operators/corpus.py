"""The shared corpus: dedup by content hash, printed labels, tags, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions import text as T


def hashed(problems: DataFrame, text: str = "raw_text", image: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with content_hash, and the rejects that have neither text nor image."""
    out = problems.withColumn("content_hash", T.content_hash(F.col(text), F.col(image) if image else None))
    return out.filter("content_hash is not null"), out.filter("content_hash is null").drop("content_hash")


def deduplicated(problems: DataFrame, order: list[str], stored: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Problems with is_stored: the first of its hash in ``order`` that is not in ``stored`` yet.

    Only hash, order and key are aggregated, with map-side minima, and rows meet their hash's first by hash and order
    together, so neither a frequent hash is one task nor is a long text moved.
    """
    first = problems.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("_first"))
    if stored is not None:
        first = first.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    narrow = problems.select("content_hash", *order, *(keep or []))
    first = first.select(F.col("content_hash").alias("_hash"), *(F.col(f"_first.{c}").alias(f"_{c}_first") for c in order), F.lit(True).alias("_is_first"))
    same = F.col("content_hash") == F.col("_hash")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_first"))
    return narrow.join(first, same, "left").withColumn("is_stored", F.col("_is_first").isNotNull()).select(*narrow.columns, "is_stored")


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, the first of each key; existing rows never change."""
    ranked = new if order is None else new.withColumn("_o", order)
    first = ranked.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.col("_o")).alias("r")).select("r.*") if order is not None else new.dropDuplicates(key)
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def ingest_report(rows: DataFrame, file: str = "source") -> DataFrame:
    """A10: by file and in total ('*'): problems, matched, unmatched, duplicates, tagged and the match rate in percent."""
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    cells = [F.count("*").alias("problems"), count(F.col("matched"), "matched"), count(~F.col("matched"), "unmatched"), count(~F.col("is_stored"), "duplicates"), count(F.col("is_stored") & F.col("matched"), "tagged")]
    rate = F.when(F.col("problems") > 0, T.half_up(100.0 * F.col("matched") / F.col("problems"), 2)).otherwise(0.0).alias("match_rate")
    by_file = rows.groupBy(F.col(file).alias("file")).agg(*cells)
    total = by_file.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in by_file.columns[1:])).select(F.lit("*").alias("file"), *by_file.columns[1:])
    return by_file.unionByName(total).select("*", rate)


def labels_matched(blocks: DataFrame, problems: DataFrame) -> DataFrame:
    """A printed label tags all problems of its column if it is the only one there and ends above every one of them."""
    column = ["doc_id", "page", "col"]
    b = blocks.groupBy(*column).agg(F.count("*").alias("blocks"), F.max("y1").alias("bottom"), F.min("type_id").alias("type_id"))
    p = problems.groupBy(*column).agg(F.min("top").alias("top"))
    reason = F.when(F.col("blocks").isNull(), "no_label").when(F.col("blocks") > 1, "many_labels").when(F.col("bottom") > F.col("top"), "label_below")
    ruled = p.join(b, column, "left").withColumn("reason", reason)
    out = problems.join(ruled.select(*column, "reason", "type_id"), column)
    return out.withColumn("type_id", F.when(F.col("reason").isNull(), F.col("type_id")))


def untagged_reasons(tagged: DataFrame) -> DataFrame:
    """By reason: problems, and pages with such a problem."""
    return tagged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("problems"), F.countDistinct("doc_id", "page").alias("pages"))


def tag_counts(tags: DataFrame, types: DataFrame, top: int = 15) -> DataFrame:
    """The report of the most frequent types, with their names."""
    counted = tags.groupBy("type_id").agg(F.count("*").alias("problems"), F.min("seq").alias("first_seq"))
    return counted.join(types.select("type_id", "name"), "type_id", "left").orderBy(F.desc("problems"), "first_seq").limit(top).select("type_id", "name", "problems")


def tag_evaluation(predictions: DataFrame, printed: DataFrame) -> DataFrame:
    """By confidence band and over all ('*'): items, first and first-or-second choice right, chapter and area right."""
    level = lambda c, k: F.substring_index(F.col(c), ".", k)
    rows = predictions.join(printed, "item").select("confidence", *(x.cast("int").alias(n) for n, x in (("first", F.col("first_choice") == F.col("type_id")), ("either", (F.col("first_choice") == F.col("type_id")) | F.coalesce(F.col("second_choice") == F.col("type_id"), F.lit(False))), ("chapter", level("first_choice", 3) == level("type_id", 3)), ("area", level("first_choice", 2) == level("type_id", 2)))))
    sums = rows.groupBy("confidence").agg(F.count("*").alias("items"), *(F.sum(c).cast("long").alias(c) for c in ("first", "either", "chapter", "area")))
    total = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums.columns[1:])).select(F.lit("*").alias("confidence"), *sums.columns[1:])
    return sums.unionByName(total).select("confidence", "items", *(F.when(F.col("items") > 0, T.half_up(F.col(c) / F.col("items"), 4)).alias(f"{c}_rate") for c in ("first", "either", "chapter", "area")))
