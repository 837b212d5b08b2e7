"""The dictionary of problem types: checks and loading of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPE_ID = r"\d\d\.\d\d\.\d\d\.\d\d"
REQUIRED = ("id", "statement", "includes", "excludes")


def load_errors(definitions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(kind, id, files) of all that rejects a load: an id in several places, a blank required field, an id that the dictionary lacks. No rows: the load is good."""
    files = F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files")
    twice = definitions.groupBy("id").agg(F.count("*").alias("n"), files).filter("n > 1").select(F.lit("duplicate").alias("kind"), "id", "files")
    blank = F.lit(False)
    for c in REQUIRED:
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    empty = definitions.filter(blank).groupBy("id").agg(files).select(F.lit("blank").alias("kind"), "id", "files")
    unknown = definitions.join(dictionary.select("id"), "id", "left_anti").groupBy("id").agg(files).select(F.lit("unknown").alias("kind"), "id", "files")
    return twice.unionByName(empty).unionByName(unknown)


def applied(dictionary: DataFrame, definitions: DataFrame) -> DataFrame:
    """Statement, includes and excludes by id; everything else stays."""
    new = definitions.select("id", *(F.col(c).alias(f"_{c}") for c in REQUIRED[1:]))
    j = dictionary.join(new, "id", "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in REQUIRED[1:] else F.col(c) for c in dictionary.columns))


def exclude_errors(definitions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(kind, id, other): an id that an excludes text names but nobody defines, or its own; and pairs of a collision group (group, id) of which one does not name the other."""
    named = definitions.select("id", F.explode(F.array_distinct(F.regexp_extract_all("excludes", F.lit(TYPE_ID), F.lit(0)))).alias("other"))
    unknown = named.join(definitions.select(F.col("id").alias("other")).distinct(), "other", "left_anti").select(F.lit("unknown").alias("kind"), "id", "other")
    own = named.filter(F.col("id") == F.col("other")).select(F.lit("self").alias("kind"), "id", "other")
    out = unknown.unionByName(own)
    if groups is not None:
        pairs = groups.join(groups.select("group", F.col("id").alias("other")), "group").filter(F.col("id") != F.col("other")).select("id", "other").distinct()
        out = out.unionByName(pairs.join(named, ["id", "other"], "left_anti").select(F.lit("not_named").alias("kind"), "id", "other"))
    return out
