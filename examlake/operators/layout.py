"""Layout of pages: body, columns, alignment, regions and reading order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions.text import half_up
from examlake.operators.grouped import grouped

# Fixed values, in points or shares of the page.
RULE_WIDTH, RULE_HEIGHT, RULE_INSET, BODY_SHARE = 0.7, 2.0, 2.0, 0.5
MARGIN_SIDE, MARGIN_TOP, MARGIN_BOTTOM = 0.04, 0.03, 0.06
GUTTER, CLUSTER_GAP, CLUSTER_LEAST, INDENT = 6.0, 1.0, 5, 30.0
REGION_ABOVE, REGION_BELOW = 2.0, 3.0
ROW_Y, ROW_GAP, FULL_FROM, FULL_OVER, FULL_ROWS = 2.0, 12.0, 0.15, 0.10, 3
GLYPH_Y, GLYPH_GAP = 3.0, 6.0
CONFIDENCE, TEXT_PAD, SAMPLE_LEFT = 0.5, 2.0, 1.0
NUMBER_FONT, NUMBER_SIZE, FEW_ANCHORS = "DINCondensed", 15.0, 2
PAGE, COLUMN = ["doc_id", "page"], ["doc_id", "page", "col"]
#: Pages are cut into square cells of this many points; what lies further out than ``FAR`` is in the outermost ones.
CELL, FAR = 96.0, 19_200.0
CELLS = ["_cx", "_cy"]


def body_rects(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (doc_id, page, w, h) with the body: between the outer long rules if that is half the page, else margins."""
    long = rules.join(pages, PAGE).filter((F.col("x1") - F.col("x0") >= RULE_WIDTH * F.col("w")) & (F.col("y1") - F.col("y0") <= RULE_HEIGHT))
    ends = long.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min(F.struct("y0", "y1")).alias("a"), F.max(F.struct("y0", "y1")).alias("b"))
    top, bottom = F.col("a.y1") + RULE_INSET, F.col("b.y0") - RULE_INSET
    ruled = (F.col("n") >= 2) & (bottom - top >= BODY_SHARE * F.col("h"))
    j = pages.join(ends, PAGE, "left").withColumn("ruled", F.coalesce(ruled, F.lit(False)))
    return j.select(*pages.columns, "ruled", (F.col("w") * MARGIN_SIDE).alias("x0"), F.when(F.col("ruled"), top).otherwise(F.col("h") * MARGIN_TOP).alias("y0"), (F.col("w") * (1 - MARGIN_SIDE)).alias("x1"), F.when(F.col("ruled"), bottom).otherwise(F.col("h") * (1 - MARGIN_BOTTOM)).alias("y1"))


def column_of(x: Column, split: Column, single: Column) -> Column:
    """0 left, 1 right; a single column is all left."""
    return F.when(single | (x < split), 0).otherwise(1)


def column_bounds(col: Column, split: Column, single: Column, x0: Column, x1: Column) -> Column:
    left, right = F.struct(x0.alias("x0"), (split - GUTTER / 2).alias("x1")), F.struct((split + GUTTER / 2).alias("x0"), x1.alias("x1"))
    return F.when(single, F.struct(x0.alias("x0"), x1.alias("x1"))).when(col == 0, left).otherwise(right)


def sure_lines(ocr_lines: DataFrame) -> DataFrame:
    """Lines of text recognition that were read well enough. They serve as anchors and as samples alike."""
    return ocr_lines.filter(F.col("confidence") >= CONFIDENCE)


def ocr_rects(bodies: DataFrame, lines: DataFrame) -> DataFrame:
    """W2 for scans: bodies (PAGE, w, x0, y0, x1, y1) whose sides are those of the page's lines, a little wider, within the page; a page without lines keeps its own. split is the middle of them, which stands for the page's."""
    text = lines.groupBy(*PAGE).agg(F.min("x0").alias("_a"), F.max("x1").alias("_b"))
    a, b = F.greatest(F.lit(0.0), F.col("_a") - TEXT_PAD), F.least(F.col("w"), F.col("_b") + TEXT_PAD)
    j = bodies.join(text, PAGE, "left").withColumn("_ok", F.coalesce(b - a > 0, F.lit(False)))
    return j.withColumns({"split": F.when(F.col("_ok"), (a + b) / 2).otherwise(F.col("w") / 2), "x0": F.when(F.col("_ok"), a).otherwise(F.col("x0")), "x1": F.when(F.col("_ok"), b).otherwise(F.col("x1"))}).drop("_a", "_b", "_ok")


def in_band(y0: Column, y1: Column, body_y0: Column, body_y1: Column) -> Column:
    """An anchor's line is in the body if its centre is, so that a tall formula does not push it out."""
    return ((y0 + y1) / 2).between(body_y0, body_y1)


def is_sample(x0: Column, y0: Column, y1: Column, body_y0: Column, body_y1: Column, col_x0: Column, col_x1: Column) -> Column:
    """A line is a sample of the alignment if all of it is in the body and it begins in its column. Not the anchors' test, on purpose."""
    return (y0 >= body_y0) & (y1 <= body_y1) & x0.between(col_x0 - SAMPLE_LEFT, col_x1)


def alignment(samples: DataFrame, by: list[str]) -> DataFrame:
    """The leftmost cluster of x0 (new where a gap exceeds a point) of five samples or more, by ``by``; groups without one have no row."""
    w = Window.partitionBy(*by).orderBy("x0")
    island = samples.withColumn("gap", F.coalesce((F.col("x0") - F.lag("x0").over(w) > CLUSTER_GAP).cast("int"), F.lit(0)))
    island = island.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    big = island.groupBy(*by, "island").agg(F.count("*").alias("n"), F.min("x0").alias("x")).filter(F.col("n") >= CLUSTER_LEAST)
    return big.groupBy(*by).agg(F.min("x").alias("align_x0"))


def aligned(anchors: DataFrame, samples: DataFrame) -> DataFrame:
    """Anchors (COLUMN, x0, col_x0) that stand at their column's edge or alignment line; a page without a line takes its document's."""
    page = alignment(samples, COLUMN)
    whole = alignment(samples, ["doc_id", "col"]).withColumnRenamed("align_x0", "doc_x0")
    j = anchors.join(page, COLUMN, "left").join(whole, ["doc_id", "col"], "left").withColumn("align_x0", F.coalesce("align_x0", "doc_x0")).drop("doc_x0")
    return j.filter((F.col("x0") - F.col("col_x0") <= INDENT) | F.coalesce(F.col("x0") - F.col("align_x0") <= INDENT, F.lit(False)))


def reading_order(anchors: DataFrame) -> DataFrame:
    """Pos, from 1 in each document: page, left column first, then down."""
    return anchors.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "col", "y0", "x0", "no")))


def regions(anchors: DataFrame) -> DataFrame:
    """Anchors (COLUMN, y0, body_y0, body_y1) with r_y0 and r_y1: down to the next anchor strictly below, or the body's end."""
    following = F.expr("min(y0) over (partition by doc_id, page, col order by y0 range between 0.000001D following and unbounded following)") - REGION_BELOW
    return anchors.withColumn("r_y1", F.coalesce(following, F.col("body_y1"))).withColumn("r_y0", F.greatest(F.col("body_y0"), F.col("y0") - REGION_ABOVE))


def renumbered(problems: DataFrame, forced: Column | None = None) -> DataFrame:
    """Documents whose numbers repeat (or forced ones) count from 1 in reading order; label keeps the printed number."""
    doc = Window.partitionBy("doc_id")
    counts = problems.groupBy("doc_id").agg((F.count("no") != F.countDistinct("no")).alias("_again"))
    j = problems.join(counts, "doc_id").withColumn("label", F.coalesce(F.col("label"), F.col("no").cast("string")))
    again = F.col("_again") if forced is None else F.col("_again") | forced
    return j.withColumn("no", F.when(again, F.row_number().over(doc.orderBy("pos"))).otherwise(F.col("no")).cast("int")).drop("_again")


def cell(at: Column) -> Column:
    """The cell of a coordinate. It never falls where the coordinate rises, also far out and for NaN, which Spark puts above all numbers."""
    return F.floor(F.least(F.greatest(at, F.lit(-FAR)), F.lit(FAR)) / CELL)


def in_cells(boxes: DataFrame) -> DataFrame:
    """A row of each box (x0, y0, x1, y1) for each cell that it touches, as CELLS: a box over a whole page is on some sixty of them."""
    across = F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))
    return boxes.withColumn("_cx", across).withColumn("_cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))


def held(boxes: DataFrame, things: DataFrame) -> DataFrame:
    """Each box (PAGE, x0, y0, x1, y1) with each of ``things`` (PAGE, cx, cy) whose centre it holds, edges included; no other column names may be common.

    A centre lies in one cell, so it meets the boxes of that cell instead of those of its page, and each of them once.
    Both sides are dealt by cell: Spark takes boxes in cells to be as small as the table they are made of and would send them whole to the driver.
    """
    t = things.withColumn("_cx", cell(F.col("cx"))).withColumn("_cy", cell(F.col("cy")))
    hit = in_cells(boxes).hint("merge").join(t, [*PAGE, *CELLS])
    return hit.filter(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))).drop(*CELLS)


def touching(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each box (PAGE, x0, y0, x1, y1) with each shape (PAGE, s_x0, s_y0, s_x1, s_y1) that overlaps it by more than an edge.

    Both lie in several cells; a pair counts in the one that holds the upper left corner of what they share. Dealt by cell, as in ``held``.
    """
    s = shapes.withColumn("_cx", F.explode(F.sequence(cell(F.col("s_x0")), cell(F.col("s_x1"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("s_y0")), cell(F.col("s_y1")))))
    both = (F.col("s_x0") < F.col("x1")) & (F.col("s_x1") > F.col("x0")) & (F.col("s_y0") < F.col("y1")) & (F.col("s_y1") > F.col("y0"))
    once = (cell(F.greatest("x0", "s_x0")) == F.col("_cx")) & (cell(F.greatest("y0", "s_y0")) == F.col("_cy"))
    return in_cells(boxes).hint("merge").join(s, [*PAGE, *CELLS]).filter(both & once).drop(*CELLS)


def region_texts(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes (PAGE, no, x0, y0, x1, y1) with the text of the lines whose centre they hold, top down."""
    l = lines.select(*PAGE, "text", F.col("x0").alias("lx"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), half_up(F.col("y0"), 1).alias("ly"))
    hit = held(boxes.select(*PAGE, "no", "x0", "y0", "x1", "y1"), l)
    rows = hit.groupBy(*PAGE, "no").agg(F.sort_array(F.collect_list(F.struct("ly", "lx", "text"))).alias("l"))
    text = F.trim(F.array_join(F.transform("l", lambda x: F.rtrim(x["text"])), "\n"))
    return boxes.join(rows.select(*PAGE, "no", text.alias("text")), [*PAGE, "no"], "left")


def single_column_vote(pages: DataFrame) -> DataFrame:
    """By document: of pages with rows, three full-width rows in all, and one on half the pages at least."""
    some = pages.filter("total > 0").groupBy("doc_id").agg(F.sum("full").alias("full"), F.count("*").alias("pages"), F.count(F.when(F.col("full") > 0, 1)).alias("with_full"))
    return some.select("doc_id", ((F.col("full") >= FULL_ROWS) & (2 * F.col("with_full") >= F.col("pages"))).alias("single"))


def graphics_reasons(boxes: DataFrame, images: DataFrame, drawings: DataFrame, least: float = 3.0, most: int = 6) -> DataFrame:
    """Boxes with graphics_reason: image where one intersects, drawings where more than six larger ones do, else null."""
    def number(shapes: DataFrame, name: str) -> DataFrame:
        s = shapes.select(*PAGE, *(F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")))
        return touching(boxes.select(*PAGE, "no", "x0", "y0", "x1", "y1"), s).groupBy(*PAGE, "no").agg(F.count("*").alias(name))

    large = drawings.filter((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))
    j = boxes.join(number(images, "_i"), [*PAGE, "no"], "left").join(number(large, "_d"), [*PAGE, "no"], "left")
    return j.withColumn("graphics_reason", F.when(F.col("_i") > 0, "image").when(F.col("_d") > most, "drawings")).drop("_i", "_d")


def row_spans(x0, y0, x1, y1) -> list[list[tuple[float, float]]]:
    """Rows of boxes given in order of (y0, x0, x1), each as its spans; boxes of a row that nearly touch are one span. A row's first box decides who belongs to it."""
    rows: list[list[tuple[float, float]]] = []
    first = -np.inf
    for a, b, top, bottom in zip(x0, x1, y0, y1, strict=True):
        y = (top + bottom) / 2
        if y - first > ROW_Y:
            rows.append([])
            first = y
        rows[-1].append((a, b))
    out = []
    for row in rows:
        spans: list[tuple[float, float]] = []
        for a, b in sorted(row):
            if spans and a - spans[-1][1] <= ROW_GAP:
                spans[-1] = spans[-1][0], max(b, spans[-1][1])
            else:
                spans.append((a, b))
        out.append(spans)
    return out


def full_rows(words: DataFrame) -> DataFrame:
    """By page: rows of words, and those that begin at the left edge and pass the split. Words: PAGE, x0, y0, x1, y1, w (page width)."""

    def rows(x0, y0, x1, y1, w) -> list[tuple[int, int]]:
        found = row_spans(x0, y0, x1, y1)
        return [(sum(any(a <= FULL_FROM * w[0] and b > (0.5 + FULL_OVER) * w[0] for a, b in spans) for spans in found), len(found))]

    return grouped(words, PAGE, ("x0", "y0", "x1", "y1", "w"), rows, "full int, total int", (F.col("y0"), F.col("x0"), F.col("x1")))


def merged_glyphs(text, x0, y0, x1) -> list[tuple[int, float, float, float]]:
    """(no, x0, y0, x1) of glyphs given in order of (y0 in tenths, x0): those side by side are one number; digits only, one to three."""
    groups: list[list] = []
    for t, a, y, b in zip(text, x0, y0, x1, strict=True):
        if groups and abs(y - groups[-1][2]) <= GLYPH_Y and a - groups[-1][3] <= GLYPH_GAP:
            groups[-1][0] += t
            groups[-1][3] = b
        else:
            groups.append([t, a, y, b])
    digits = (("".join(c for c in t if c.isdecimal()), a, y, b) for t, a, y, b in groups)
    return [(int(d), float(a), float(y), float(b)) for d, a, y, b in digits if 1 <= len(d) <= 3]


def merged_numbers(glyphs: DataFrame) -> DataFrame:
    """Large glyphs (PAGE, text, x0, y0, x1) that stand side by side, read as one number of one to three digits."""
    return grouped(glyphs, PAGE, ("text", "x0", "y0", "x1"), merged_glyphs, "no int, x0 double, y0 double, x1 double", (half_up(F.col("y0"), 1), F.col("x0")))


def workbook_anchors(spans: DataFrame, bodies: DataFrame, single: bool = False) -> DataFrame:
    """Candidates (doc_id, pos, no, page, col, x0, y0) of a workbook's large printed numbers, in reading order: spans of the number font and size, merged, that begin in the body. bodies: PAGE, w, y0, y1. Their chain is W6's."""
    large = spans.filter(F.contains("font", F.lit(NUMBER_FONT)) & (F.col("size") >= NUMBER_SIZE)).select(*PAGE, "text", "x0", "y0", "x1")
    numbers = merged_numbers(large).join(bodies.select(*PAGE, "w", F.col("y0").alias("_a"), F.col("y1").alias("_b")), PAGE).filter(F.col("y0").between(F.col("_a"), F.col("_b")))
    return reading_order(numbers.withColumn("col", column_of(F.col("x0"), F.col("w") / 2, F.lit(single)))).select("doc_id", "pos", "no", "page", "col", "x0", "y0")


def with_fallback(anchors: DataFrame, workbook: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """(doc_id, no, page, col, x0, y0, is_workbook): the anchors of each document, or its workbook numbers where it has fewer than two anchors and more of those; then its mode is image. Documents of ``scanned`` (doc_id) have no fonts and keep their anchors."""
    n, k = anchors.groupBy("doc_id").agg(F.count("*").alias("_n")), workbook.groupBy("doc_id").agg(F.count("*").alias("_k"))
    better = k.join(n, "doc_id", "left").na.fill(0, ["_n"]).filter((F.col("_n") < FEW_ANCHORS) & (F.col("_k") > F.col("_n"))).select("doc_id")
    if scanned is not None:
        better = better.join(scanned.select("doc_id").distinct(), "doc_id", "left_anti")
    columns = ["doc_id", "no", "page", "col", "x0", "y0"]
    own = anchors.join(better, "doc_id", "left_anti").select(*columns, F.lit(False).alias("is_workbook"))
    return own.unionByName(workbook.join(better, "doc_id", "left_semi").select(*columns, F.lit(True).alias("is_workbook")))


def label_blocks(lines: DataFrame, first: str = "08 ", most_gap: float = 40.0) -> DataFrame:
    """Four label lines in a column, the first of the subject, close to each other, read as one type id. Found ones do not overlap."""
    label = lines.filter(F.col("text").rlike(r"^\d\d [가-힣]"))

    def blocks(text, y0, y1) -> list[tuple[str, float, float]]:
        return found_blocks(text, y0, y1, first, most_gap)

    return grouped(label, COLUMN, ("text", "y0", "y1"), blocks, "type_id string, y0 double, y1 double", (F.col("y0"), F.col("x0")))


def found_blocks(text, y0, y1, first: str, most_gap: float) -> list[tuple[str, float, float]]:
    """W17 within one column, whose label lines are given in order."""
    at, out = 0, []
    while at + 4 <= len(text):
        if text[at].startswith(first) and all(y0[k + 1] - y0[k] <= most_gap for k in range(at, at + 3)):
            out.append((".".join(t[:2] for t in text[at : at + 4]), float(y0[at]), float(y1[at + 3])))
            at += 4
        else:
            at += 1
    return out
