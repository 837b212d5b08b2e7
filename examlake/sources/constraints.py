"""Tables read with their constraints. What breaks one becomes a row of a table of rejects; nothing is lost and nothing stops the load."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.sources.staging import staged
from examlake.sources.tables import SCHEMAS, read

# Columns that must not be null, keys (a row with a null in one of their columns is alone), what a column must be found in, and defaults.
REQUIRED = {
    "nodes": "node_id type name section created_at",
    "files": "node_id pages mode pua_ratio problem_count",
    "problems": "node_id no page bbox crop_path text label",
    "solutions": "node_id no solution truncated created_at",
    "variants": "node_id no mode text created_at",
    "chat_messages": "id node_id role content created_at",
    "conversations": "id title created_at updated_at",
    "conversation_messages": "id conversation_id role content created_at",
    "note_items": "id note_id name no crop_path created_at",
    "jobs": "id kind node_id targets_json status total done_count created_at updated_at",
    "problem_types": "id subject area chapter name status",
    "bank_problems": "id raw_text content_hash origin visibility source_label",
    "problem_tags": "bank_id type_id confidence source evidence",
}
KEYS = {
    "nodes": ["node_id"], "files": ["node_id"], "problems": ["node_id no"], "solutions": ["node_id no"], "variants": ["node_id no mode"], "chat_messages": ["id"], "conversations": ["id"],
    "conversation_messages": ["id"], "note_items": ["id", "note_id source_node_id no"], "jobs": ["id"], "problem_types": ["id"], "bank_problems": ["id", "content_hash"], "problem_tags": ["bank_id"],
}
REFERENCES = {"conversation_messages": {"conversation_id": ("conversations", "id")}}
DEFAULTS = {"nodes": {"section": "exam"}, "problems": {"text": "", "label": ""}, "solutions": {"truncated": False}, "conversations": {"title": "새 대화"}, "note_items": {"crop_path": ""}, "jobs": {"total": 0, "done_count": 0}}
REJECTS = "table string, reason string, detail string, row string, copies long"


class Checked(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def _lines(spark: SparkSession, name: str, path: str, fmt: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows that could be read, and the lines (as _line) that could not; parquet and ORC have their types in the file."""
    if fmt not in ("json", "csv"):
        return read(spark, name, path, fmt), None
    kind = f"{SCHEMAS[name]}, _broken string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parse = F.from_json if fmt == "json" else F.from_csv
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("_line"), parse("value", kind, options).alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._broken").isNotNull()
    return lines.filter(~broken).select("_r.*").drop("_broken"), lines.filter(broken).select("_line")


def _rejects(name: str, reason: str, rows: DataFrame, detail: Column, row: Column, copies: Column | None = None) -> DataFrame:
    out = (F.lit(name).alias("table"), F.lit(reason).alias("reason"), detail.alias("detail"), row.alias("row"))
    if copies is not None:
        return rows.select(*out, copies.alias("copies"))
    return rows.select(*out).groupBy("table", "reason", "detail", "row").agg(F.count("*").alias("copies"))


def _one_of_each(rows: DataFrame, name: str, key: list[str]) -> Checked:
    """One row of each key stays, the least by its columns in order; the others, equal ones counted, are rejects.

    Rows of a key meet in an aggregate that is combined before the shuffle, so a key that a third of all rows have is no large group; only the
    rejects join again, by keys that repeat (AQE splits the partitions of hot ones).
    """
    row = F.struct(*rows.columns)
    keyed = functools.reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    least = staged(rows.filter(keyed).groupBy(*(F.col(k).alias(f"_k_{k}") for k in key)).agg(F.min(row).alias("_first"), F.count("*").alias("_n")))
    good = least.select("_first.*").unionByName(rows.filter(~keyed))
    again = least.filter("_n > 1").drop("_n")
    same = functools.reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_k_{k}") for k in key))
    distinct = rows.filter(keyed).groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    left = distinct.join(again, same).withColumn("_left", F.col("_copies") - F.when(row.eqNullSafe(F.col("_first")), 1).otherwise(0)).filter("_left > 0")
    return Checked(good, _rejects(name, "repeated_key", left, F.lit(" ".join(key)), F.to_json(row), F.col("_left")))


def checked(rows: DataFrame, name: str, parents: dict[str, DataFrame] | None = None, broken: DataFrame | None = None) -> Checked:
    """``rows`` of the table ``name`` that keep all its constraints, and the rejects (table, reason, detail, row, copies).

    Reasons, each row with its first: ``unreadable`` (a line of ``broken``, as it is), ``missing`` (detail: the required columns that are null, after
    defaults), ``no_parent`` (detail: the column whose value is in no row of its table of ``parents``; a null refers to nothing and a table that is not
    given is not looked at), ``repeated_key`` (detail: the key's columns). A key is looked at among the rows that keep what comes before it, so a
    rejected row never pushes out a good one; where a table has two keys, the second is looked at among what the first left. Columns that the table does not
    have are left out, those that it has and ``rows`` lacks are null. Good rows and copies of rejects are as many as the rows read.
    """
    wanted = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    default = DEFAULTS.get(name, {})
    of = lambda f: F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
    rows = rows.select(*((F.coalesce(of(f), F.lit(default[f.name])) if f.name in default else of(f)).alias(f.name) for f in wanted))
    row = F.to_json(F.struct(*rows.columns))
    rejects = [] if broken is None else [_rejects(name, "unreadable", broken, F.lit(""), F.col("_line"))]

    null = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in REQUIRED[name].split())))
    rejects.append(_rejects(name, "missing", rows.filter(F.size(null) > 0), F.array_join(null, " "), row))
    rows = rows.filter(F.size(null) == 0)
    for column, (table, key) in REFERENCES.get(name, {}).items():
        if parents and table in parents:
            there = parents[table].select(F.col(key).alias("_parent")).filter("_parent is not null").distinct()
            marked = staged(rows.join(there, F.col(column) == F.col("_parent"), "left"))
            alone = F.col(column).isNotNull() & F.col("_parent").isNull()
            rejects.append(_rejects(name, "no_parent", marked.filter(alone), F.lit(column), row))
            rows = marked.filter(~alone).drop("_parent")
    for key in KEYS[name]:
        rows, again = _one_of_each(rows, name, key.split())
        rejects.append(again)
    return Checked(rows, functools.reduce(DataFrame.unionByName, rejects))


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet", parents: dict[str, DataFrame] | None = None) -> Checked:
    """A table's files (json and csv: a row a line) as ``checked`` leaves them; an empty line is no row, and what follows a line's object is not read, as in Spark."""
    rows, broken = _lines(spark, name, path, fmt)
    return checked(rows, name, parents, broken)
