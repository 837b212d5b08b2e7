"""Documents as ordered blocks: exams, variants and notes, ready for a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import markdown as M
from examlake.functions import text as T

BLOCK = "struct<kind:string,level:int,text:string>"


def _block(kind: str, level: Column | None, text: Column | None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (none if level is None else level).cast("int").alias("level"), (none if text is None else text).cast("string").alias("text"))


def item_body(as_text: Column, text: Column, has_crop: Column) -> Column:
    """B1: text when asked for and there is some, else the image; a text that points at a figure has the image, too."""
    image, body = F.array(_block("image", None, None)), F.array(_block("text", None, text))
    usable = as_text & (F.coalesce(T.stripped(text), F.lit("")) != "")
    return F.when(usable & T.needs_figure(text) & has_crop, F.concat(body, image)).when(usable, body).otherwise(image)


def solution_blocks(solution: Column) -> Column:
    """B2: a heading of level 3 and a body for each exported section; text without sections is one named after solutions."""
    found = M.sections(solution)
    plain = (F.size(found) == 1) & (F.try_element_at(found, F.lit(1))["title"] == M.PROBLEM) & ~F.coalesce(solution.rlike(M.HEADING), F.lit(False))
    named = F.when(plain, F.transform(found, lambda s: F.struct(F.lit(M.SOLUTION).alias("title"), s["body"].alias("body")))).otherwise(F.filter(found, lambda s: ~s["title"].isin(*M.NOT_EXPORTED)))
    blocks = F.flatten(F.transform(named, lambda s: F.array(_block("heading", F.lit(3), s["title"]), _block("text", None, s["body"]))))
    return F.when(F.coalesce(F.trim(solution), F.lit("")) == "", F.expr(f"cast(array() as array<{BLOCK}>)")).otherwise(blocks)


def assembled(items: DataFrame, title: Column) -> DataFrame:
    """Items (doc_id, item, heading, body, answer: arrays of blocks) to rows (doc_id, pos, kind, level, text).

    The title, then all items; answers of those that have some follow behind a page break and a heading of their own.
    Parts and items are sort keys, so a document is put in order once, by one window.
    """
    heads = items.groupBy("doc_id").agg(title.alias("title"))
    first = heads.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("item"), F.array(_block("heading", F.lit(1), F.col("title"))).alias("b"))
    own = items.select("doc_id", F.lit(1).alias("part"), "item", F.concat(F.array(_block("heading", F.lit(2), F.col("heading"))), "body").alias("b"))
    answered = items.filter(F.size("answer") > 0)
    turn = answered.select("doc_id").distinct().select("doc_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("item"), F.array(_block("page_break", None, None), _block("heading", F.lit(1), F.lit(M.ANSWERS))).alias("b"))
    last = answered.select("doc_id", F.lit(3).alias("part"), "item", F.concat(F.array(_block("heading", F.lit(2), F.col("heading"))), "answer").alias("b"))
    rows = first.unionAll(own).unionAll(turn).unionAll(last).select("doc_id", "part", "item", F.posexplode("b").alias("i", "x"))
    order = Window.partitionBy("doc_id").orderBy("part", "item", "i")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "x.kind", "x.level", "x.text")


def variant_items(variants: DataFrame) -> DataFrame:
    """Variants (doc_id, no, mode, text, label) as items for ``assembled``: a heading of number and kind, the problem's section in front, other exported sections as the answer; blank sections are left out."""
    found = F.filter(M.sections(F.col("text")), lambda s: (T.stripped(s["body"]) != "") & ~s["title"].isin(*M.NOT_EXPORTED))
    front = F.transform(F.filter(found, lambda s: s["title"] == M.PROBLEM), lambda s: _block("text", None, s["body"]))
    back = F.flatten(F.transform(F.filter(found, lambda s: s["title"] != M.PROBLEM), lambda s: F.array(_block("heading", F.lit(3), s["title"]), _block("text", None, s["body"]))))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in M.VARIANT_KINDS.items() for x in pair)), F.col("mode")), F.col("mode"))
    heading = F.concat(T.display_no(F.col("no"), F.col("label")), F.lit(" · "), kind)
    rank = F.array_position(F.array(*map(F.lit, M.VARIANT_KINDS)), F.col("mode"))
    item = F.col("no").cast("long") * 10 + F.when(rank > 0, rank).otherwise(9)
    return variants.select("doc_id", item.alias("item"), heading.alias("heading"), front.alias("body"), back.alias("answer"))


def note_document_items(items: DataFrame) -> DataFrame:
    """Note items (doc_id, item, source_name, no, label, as_text, transcript, has_crop, memo, solution) as items for ``assembled``: the snapshots that were taken, the memo behind the problem, the solution as the answer."""
    heading = F.concat_ws(" ", F.regexp_replace("source_name", r"(?i)\.pdf$", ""), T.display_no(F.col("no"), F.col("label")))
    memo = F.when(T.stripped(F.coalesce("memo", F.lit(""))) != "", F.array(_block("text", None, F.concat(F.lit(M.MEMO), T.stripped(F.col("memo")))))).otherwise(F.expr(f"cast(array() as array<{BLOCK}>)"))
    body = F.concat(item_body(F.col("as_text"), F.col("transcript"), F.col("has_crop")), memo)
    return items.select("doc_id", "item", heading.alias("heading"), body.alias("body"), solution_blocks(F.col("solution")).alias("answer"))


def item_spans(blocks: DataFrame) -> DataFrame:
    """item_no of each block: an item runs from a level-2 heading to the next heading of level 1 or 2, or page break; null outside items."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("kind") == "heading") & (F.col("level") == 2)
    ends = (F.col("kind") == "page_break") | ((F.col("kind") == "heading") & (F.col("level") <= 2))
    last = F.last(F.when(ends, F.coalesce(starts, F.lit(False))), ignorenulls=True).over(order)
    number = F.sum(F.when(starts, 1).otherwise(0)).over(order)
    return blocks.withColumn("item_no", F.when(F.coalesce(last, F.lit(False)), number))


def full_width(kind: Column, level: Column) -> Column:
    """W22."""
    return F.when(kind == "page_break", F.lit(None).cast("boolean")).otherwise(F.coalesce((kind == "heading") & (level == 1), F.lit(False)))


def export_notice(items: DataFrame) -> DataFrame:
    """By document, over problems shown as text: none: null; all by hand: manual; any by a model: restored_ai; else restored."""
    shown = items.groupBy("doc_id").agg(F.count(F.when(F.col("as_text"), 1)).alias("n"), F.min(F.when(F.col("as_text"), F.coalesce(F.col("source") == "manual", F.lit(False)))).alias("hand"), F.max(F.when(F.col("as_text"), F.coalesce(F.col("source") == "ai", F.lit(False)))).alias("ai"))
    return shown.select("doc_id", F.when(F.col("n") == 0, None).when(F.col("hand"), "manual").when(F.col("ai"), "restored_ai").otherwise("restored").alias("notice"))
