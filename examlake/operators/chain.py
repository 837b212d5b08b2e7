"""Chains of problem numbers: which anchors of a document are real."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.operators.grouped import grouped


def longest_increasing(numbers) -> list[int]:
    """Positions of the longest strictly increasing subsequence; at ties the first best end, and before each member the first best predecessor. n log n.

    For each length, the first position that reaches it with the smallest end is known by bisection; the first best
    predecessor of a member is the first position of the length before it whose value is smaller.
    """
    ends: list = []
    at: list[list[int]] = []  # positions by the length they end, in order; their values do not increase
    for i, x in enumerate(numbers):
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            at.append([])
        else:
            ends[k] = x
        at[k].append(i)
    if not at:
        return []
    chain = [at[-1][0]]
    for own in reversed(at[:-1]):
        last = chain[-1]
        # own's values do not increase: the first that is smaller
        lo = bisect_left(own, True, key=lambda i: bool(numbers[i] < numbers[last]))
        chain.append(own[lo])
    return chain[::-1]


def reset_chain(anchors: DataFrame, by: list[str]) -> DataFrame:
    """Kept: the first, whatever exceeds the last kept, and every 1, which begins a section. By windows: within a section the kept are the strict running maxima."""
    w = Window.partitionBy(*by).orderBy("pos")
    sections = anchors.withColumn("_s", F.sum(F.when(F.col("no") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.max("no").over(Window.partitionBy(*by, "_s").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return sections.withColumn("_top", top).filter(F.col("_top").isNull() | (F.col("no") > F.col("_top")) | (F.col("no") == 1)).drop("_s", "_top")


def _reset(numbers) -> list[int]:
    kept: list[int] = []
    for i, x in enumerate(numbers):
        if not kept or x > numbers[kept[-1]] or x == 1:
            kept.append(i)
    return kept


def best_chain(numbers) -> list[int]:
    """The longer of the two; with resets at ties."""
    a, b = _reset(numbers), longest_increasing(numbers)
    return b if len(b) > len(a) else a


def _numbers(no) -> list:
    return [float("nan") if x is None else x for x in no]


def _kept(anchors: DataFrame) -> str:
    return ", ".join(f"{c} {anchors.schema[c].dataType.simpleString()}" for c in ("pos", "no"))


def chains(anchors: DataFrame, how=best_chain) -> DataFrame:
    """W6, W8 by document: the anchors (doc_id, pos, no) kept. A document's candidates are in memory at a time."""

    def pick(pos, no) -> list[tuple]:
        return [(pos[i], no[i]) for i in how(_numbers(no))]

    return grouped(anchors, ["doc_id"], ("pos", "no"), pick, _kept(anchors))


def _choice(no, delimiter, series) -> list[int]:
    at = range(len(no))
    by = {x: [i for i in at if series[i] is None and delimiter[i] == x] for x in (".", ")")}
    length = {x: len(longest_increasing([no[i] for i in by[x]])) for x in by}
    dominant = by[")" if length[")"] > length["."] else "."]
    of = lambda own: [own[j] for j in best_chain([no[i] for i in own])]
    plain = of(dominant)
    book = sorted(i for name in {s for s in series if s is not None} for i in of([i for i in at if series[i] == name]))
    return book if len(book) > len(plain) else plain


def chosen(anchors: DataFrame) -> DataFrame:
    """(doc_id, pos, no): plain anchors of the dominant delimiter, or the book's series if their chains together are strictly longer.

    anchors: doc_id, pos, no, delimiter (of plain ones) and series (of book ones). ")" dominates only with a longer increasing chain.
    """

    def pick(pos, no, delimiter, series) -> list[tuple]:
        return [(pos[i], no[i]) for i in _choice(_numbers(no), delimiter, series)]

    return grouped(anchors, ["doc_id"], ("pos", "no", "delimiter", "series"), pick, _kept(anchors))


def chain_lengths(anchors: DataFrame) -> DataFrame:
    """Lengths of the two chains of each document."""

    def lengths(pos, no) -> list[tuple[int, int, int]]:
        n = _numbers(no)
        return [(len(n), len(longest_increasing(n)), len(_reset(n)))]

    return grouped(anchors, ["doc_id"], ("pos", "no"), lengths, "anchors long, increasing long, resets long")
