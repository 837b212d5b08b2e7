"""Connected components of an edge table, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b). Only minima are aggregated; neighbours are never gathered in a list."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that stands in an edge (a, b); component is the smallest id reachable.

    Null ends and loops are no links. The steps are repeated until the edges stay the same; each result is a
    written table, so a lost executor costs one step. No rows: no rows.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # every edge of the result is (id, smallest id): then both steps change nothing
        now_mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now_mark == mark or not now_mark[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        mark, before = now_mark, now
        now = written(_star(_star(before, large=True), large=False))
        dropped(before)
