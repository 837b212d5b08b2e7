"""Saving results: upserts, guarded merges, replacement, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["node_id", "no"]
LONGEST_TRANSCRIPT = 20_000


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The last write of each key wins, any write over what was stored. One aggregate, no sort."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("_new", order)).alias("r")).select("r.*")


def merged_transcripts(problems: DataFrame, updates: DataFrame, force: bool = False) -> DataFrame:
    """Updates (node_id, no, u_transcript, u_source, u_note; one for each problem) into problems.

    What was written by hand stays unless the update is by hand, too, or forced. An update without a transcript is a note
    only. A blank one by hand clears all three. A transcript that is too long changes nothing.
    """
    j = problems.join(updates, KEY, "left")
    by_hand = F.col("u_source") == "manual"
    fits = F.coalesce(F.char_length("u_transcript") <= LONGEST_TRANSCRIPT, F.lit(True))
    guarded = (F.col("transcript_source") == "manual") & ~F.coalesce(by_hand, F.lit(False)) & F.lit(not force)
    some = F.col("u_source").isNotNull() | F.col("u_note").isNotNull() | F.col("u_transcript").isNotNull()
    action = (
        F.when(~some | ~fits | F.coalesce(guarded, F.lit(False)), "keep")
        .when(by_hand & (F.trim(F.coalesce("u_transcript", F.lit(""))) == ""), "clear")
        .when(F.col("u_transcript").isNull(), "note")
        .otherwise("write")
    )
    j = j.withColumn("action", action)
    pick = lambda old, new, note: F.when(F.col("action") == "write", new).when(F.col("action") == "clear", None).when(F.col("action") == "note", note).otherwise(old)
    t, s, n = F.col("transcript"), F.col("transcript_source"), F.col("transcript_note")
    return j.withColumns({"transcript": pick(t, F.col("u_transcript"), t), "transcript_source": pick(s, F.col("u_source"), s), "transcript_note": pick(n, F.col("u_note"), F.col("u_note"))}).drop("u_transcript", "u_source", "u_note")


def re_extracted(tables: dict[str, DataFrame], files: DataFrame, problems: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Problems of the files are replaced whole; their solutions and variants go and are counted by file; notes and chats stay."""
    own = files.select("node_id").distinct()
    kept = {name: df.join(own, "node_id", "left_anti") if name in ("problems", "solutions", "variants") else df for name, df in tables.items()}
    kept["problems"] = kept["problems"].unionByName(problems, allowMissingColumns=True)
    gone = own
    for name in ("solutions", "variants"):
        gone = gone.join(tables[name].groupBy("node_id").agg(F.count("*").alias(f"{name}_dropped")), "node_id", "left")
    return kept, gone.na.fill(0)


def cascaded(tables: dict[str, DataFrame], closure: DataFrame) -> dict[str, DataFrame]:
    """Delete the nodes in ``closure`` (node_id). Items of deleted notes go; items that point at deleted files lose their source; all that hangs on deleted nodes goes."""
    gone = closure.select("node_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "note_items":
            left = df.join(gone.withColumnRenamed("node_id", "note_id"), "note_id", "left_anti")
            dead = gone.select(F.col("node_id").alias("source_node_id"), F.lit(True).alias("dead"))
            out[name] = left.join(dead, "source_node_id", "left").withColumn("source_node_id", F.when(F.col("dead").isNull(), F.col("source_node_id"))).drop("dead").select(*df.columns)
        else:
            out[name] = df.join(gone, "node_id", "left_anti")
    return out


def added_items(items: DataFrame, requested: DataFrame, problems: DataFrame) -> DataFrame:
    """Requests (note_id, source_node_id, no), once each, with outcome added, skipped (there already) or unknown (no such problem), and the snapshots that an added one takes."""
    r = requested.dropDuplicates(["note_id", "source_node_id", "no"])
    known = problems.select(F.col("node_id").alias("source_node_id"), "no", "name", "transcript", "label", F.lit(True).alias("_known"))
    there = items.filter("source_node_id is not null").select("note_id", "source_node_id", "no", F.lit(True).alias("_there")).distinct()
    j = r.join(known, ["source_node_id", "no"], "left").join(there, ["note_id", "source_node_id", "no"], "left")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(F.col("_there").isNotNull(), "skipped").otherwise("added")
    j = j.withColumn("outcome", outcome)
    return j.select("note_id", "source_node_id", "no", "outcome", *(F.when(F.col("outcome") == "added", F.col(c)).alias(c) for c in ("name", "transcript", "label")))


def note_detail(items: DataFrame, nodes: DataFrame, problems: DataFrame, clean) -> DataFrame:
    """Items with whether their source lives and, if so, ``clean`` of their problem's text (the cleaned text, or its hash). It is made once for each problem of a living source, before items are joined."""
    live = nodes.select(F.col("node_id").alias("source_node_id"), F.lit(True).alias("alive"))
    text = problems.join(nodes.select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("source_node_id"), "no", clean(F.col("text")).alias("text"))
    j = items.join(live, "source_node_id", "left").join(text, ["source_node_id", "no"], "left")
    return j.withColumn("alive", F.coalesce("alive", F.lit(False)))


def back_filled(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows of an older schema: missing columns come as nulls, an empty section is 'exam', an empty label the number. Twice is once."""
    for name, kind in wanted.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if "section" in wanted:
        rows = rows.withColumn("section", F.coalesce(F.nullif("section", F.lit("")), F.lit("exam")))
    if "label" in wanted:
        rows = rows.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col("no").cast("string")))
    return rows
