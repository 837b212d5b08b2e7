"""Removal of word passages that an earlier document has too, with prefix-partitioned suffix trees.

1. Every window of ``window`` words has an anchor: the smallest hash of the 2/5-window grams in it. Equal windows have
   equal anchors, so a window can only repeat if its anchor stands in documents of different word sequences. One scan
   gives the distinct anchors of each document and the hash of its whole sequence; a document whose whole sequence an
   earlier one has is a copy and goes at once.
2. Windows whose anchor repeats are the suffixes that matter. Neighbours of one anchor travel together: a unit is a run of
   starts and the word hashes from its first start to the end of its last window.
3. Units are dealt by prefix, of two lengths: by their anchor gram, put together in bins of about ``BIN`` suffixes; and by the
   whole window where more than ``GROUP`` suffixes share an anchor. A bin ranks its suffixes by their words (doubling), sorts
   them, which is the leaf order of its suffix tree, and takes the longest common prefixes of neighbours in words. Neighbours
   of ``window`` words or more are the leaves of one deep inner node; leaves in documents after its first go. A prefix of
   a whole window is a node by itself, whose first document is an aggregate.
4. Neighbouring starts that go are one maximal repeat; the covered words are cut from the text.

Defined results: null text has no words; texts shorter than a window stay whole; windows repeated only within one
document stay; ties cannot occur (the smallest id keeps the passage, all rows of that id do); repeated rows give
repeated rows; a null id is compared with nothing and stays whole; other columns are kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.shared import slices, text_of, written
from examlake.llm.words import Words, mixed, sequence_hash, window_hashes, words

#: Most suffixes of one prefix before it is made longer, suffixes of one bin, and starts of one unit.
GROUP, BIN, UNIT = 20_000, 40_000, 512
#: Into how many keys a window of many documents is dealt where it is joined with its first document.
SALT = 16


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window within a text, and the index of the window's first word."""
    gram = max(1, window * 2 // 5)
    if len(w.hash) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, width, wide = window_hashes(w.hash, gram), 1, window - gram + 1
    while width < wide:  # minima of runs, doubling
        step = min(width, wide - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    inside = w.place() + window <= np.repeat(w.count, w.count)
    at = np.flatnonzero(inside)
    return low[at], at


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """(row, id, whole, anchor): one row with a null anchor for each document of a window or more, and one for each of its distinct anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = words(text_of(batch, "text"))
            long = np.flatnonzero(w.count >= window)
            whole = np.zeros(batch.num_rows, np.uint64)
            for i in long:
                whole[i] = sequence_hash(w.hash[w.first[i] : w.first[i + 1]])
            low, at = _anchors(w, window)
            text = w.text()[at]
            order = np.lexsort((low, text))
            low, text = low[order], text[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
            low, text = low[new], text[new]
            of = np.concatenate([long, text])
            anchor = pa.array(np.concatenate([np.zeros(len(long), np.uint64), low]).view(np.int64), mask=np.arange(len(of)) < len(long))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(whole[of].view(np.int64)), anchor], ["row", "id", "whole", "anchor"])

    return docs.filter(F.col("id").isNotNull()).select("row", "id", "text").mapInArrow(scan, "row long, id long, whole long, anchor long")


def _binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """A binary column of the bytes of count[0], count[1], ... values."""
    offsets = np.concatenate([[0], np.cumsum(count)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _units(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(anchor, row, id, pos, n, words): runs of n starts from pos on, whose windows have one anchor that is among their document's (row, anchors)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = words(text_of(batch, "text"))
            low, at = _anchors(w, window)
            text = w.text()
            own = batch.column(3)
            number = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            repeated = np.asarray(own.flatten()).view(np.uint64)
            tie = lambda h, i: h ^ mixed(i.astype(np.uint64) + np.uint64(1))
            some = np.isin(tie(low, text[at]), tie(repeated, number))
            low, at = low[some], at[some]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (text[at[1:]] != text[at[:-1]])
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(at)))
            pieces = -(-length // UNIT)
            begin = np.repeat(begin, pieces) + UNIT * _spread(np.zeros(len(pieces), np.int64), pieces)
            length = np.diff(np.append(begin, len(at)))
            start = at[begin]
            of = pa.array(text[start])
            count = length + window - 1
            place = (start - w.first[text[start]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(low[begin].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(place), pa.array(length.astype(np.int32)), _binary(w.hash[_spread(start, count)], count)], ["anchor", "row", "id", "pos", "n", "words"])

    joined = docs.hint("shuffle_hash").join(anchors.hint("shuffle_hash"), "row").select("row", "id", "text", "anchors")
    return joined.mapInArrow(scan, "anchor long, row long, id long, pos int, n int, words binary")


class SuffixTree:
    """Leaves and deep inner nodes of the suffixes of several word sequences, given one after the other."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray, depth: int):
        ends = np.cumsum(count)
        self.left = np.repeat(ends, count) - np.arange(len(hashes))  # words to the end of the sequence
        self.depth = depth
        rank, k = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1, 1
        self.levels = [rank]  # of the first 1, 2, 4, ... words; 0 where there are fewer
        while 2 * k <= depth:
            live = np.flatnonzero(self.left >= 2 * k)
            wider = np.zeros(len(hashes), np.int64)
            wider[live] = np.unique(rank[live] * (len(hashes) + 1) + rank[live + k], return_inverse=True)[1] + 1
            rank, k = wider, 2 * k
            self.levels.append(rank)
        self.widest = k

    def leaves(self, starts: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The order of the suffixes at ``starts`` (each of ``depth`` words at least) by their first ``depth`` words, then by ``ties``."""
        top = self.levels[-1]
        return np.lexsort((ties, top[starts + self.depth - self.widest], top[starts]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b begin with in common."""
        n, most = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        for level in range(len(self.levels) - 1, -1, -1):
            k, live = 1 << level, np.arange(len(a))
            while len(live := live[n[live] + k <= most[live]]):
                live = live[self.levels[level][a[live] + n[live]] == self.levels[level][b[live] + n[live]]]
                n[live] += k
        return n


def deep_nodes(tree: SuffixTree, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes as deep as the tree's depth: the leaves in order, the node of each, and the depth in words of each node."""
    order = tree.leaves(starts, ids)
    lcp = tree.common(starts[order[:-1]], starts[order[1:]])
    node = np.concatenate([[0], np.cumsum(lcp < tree.depth)]).astype(np.int64)[: len(order)]
    depth = tree.left[starts[order[np.searchsorted(node, np.arange(node[-1] + 1))]]] if len(order) else np.zeros(0, np.int64)
    inside = lcp >= tree.depth
    np.minimum.at(depth, node[1:][inside], lcp[inside])
    return order, node, depth


def _runs(flag: np.ndarray, unit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of flagged starts of one unit with one first document."""
    at = np.flatnonzero(flag)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (unit[at[1:]] != unit[at[:-1]]) | (first[at[1:]] != first[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at)))


def _tree(window: int):
    """The suffix tree of one bin: runs (row, pos, n, first) of starts whose windows are leaves of a deep node after its first document."""

    def nodes(units: pa.Table) -> pa.Table:
        n, own = units.column("n").to_numpy().astype(np.int64), units.column("id").to_numpy()
        raw = units.column("words").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        hashes = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        count = n + window - 1
        unit = np.repeat(np.arange(len(n)), n)
        starts = _spread(np.cumsum(count) - count, n)
        ids = own[unit]
        order, node, _ = deep_nodes(SuffixTree(hashes, count, window), starts, ids)
        first = np.empty(len(order), np.int64)
        first[order] = ids[order][np.searchsorted(node, node)]
        begin, length = _runs(ids > first, unit, first)
        of = unit[begin]
        place = units.column("pos").to_numpy()[of] + begin - (np.cumsum(n) - n)[of]
        return pa.table({"row": pa.array(units.column("row").to_numpy()[of]), "pos": pa.array(place.astype(np.int32)), "n": pa.array(length.astype(np.int32)), "first": pa.array(first[begin])})

    return nodes


def _windows(units: DataFrame, window: int) -> DataFrame:
    """(a, b, row, id, pos): every window of the units by two hashes of its words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = part.column(3).to_numpy().astype(np.int64)
                hashes = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint64)
                starts = _spread(np.cumsum(n + window - 1) - n - window + 1, n)
                keys = [window_hashes(h, window)[starts].view(np.int64) if len(n) else np.zeros(0, np.int64) for h in (hashes, mixed(hashes ^ np.uint64(5)))]
                of = pa.array(np.repeat(np.arange(len(n)), n))
                place = _spread(part.column(2).to_numpy().astype(np.int64), n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), part.column(0).take(of), part.column(1).take(of), pa.array(place)], ["a", "b", "row", "id", "pos"])

    return units.select("row", "id", "pos", "n", "words").mapInArrow(scan, "a long, b long, row long, id long, pos int")


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(row, pos, n, first): the n windows of a document from pos on start in documents of smaller ids, the smallest of which is ``first``; pos and n are null for a whole copy. ``docs`` has row, id and text."""
    scan = written(_scan(docs, window))
    wholes = scan.filter(F.col("anchor").isNull()).select("row", "id", "whole")
    copies = written(wholes.join(wholes.groupBy("whole").agg(F.min("id").alias("first")), "whole").filter(F.col("id") > F.col("first")).select("row", "first"))
    anchors = scan.filter(F.col("anchor").isNotNull())
    shared = anchors.groupBy("anchor").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).filter(F.col("a") != F.col("b")).select("anchor")
    own = anchors.join(shared, "anchor").select("row", "anchor").distinct().groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
    own = own.join(copies, "row", "left_anti")
    units = written(_units(docs, own, window))
    sums = units.groupBy("anchor").agg(F.sum("n").alias("n"))
    full = written(sums.filter(F.col("n") > GROUP).select("anchor", F.lit(True).alias("full")))
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = units.join(full, "anchor", "left")

    bins = max(1, -(-total // BIN))
    cold = dealt.filter(F.col("full").isNull()).select("row", "id", "pos", "n", "words", F.pmod(F.xxhash64("anchor"), F.lit(bins)).alias("bin"))
    out = cold.groupBy("bin").applyInArrow(_tree(window), "row long, pos int, n int, first long")
    if not full.isEmpty():
        hot = written(_windows(dealt.filter(F.col("full").isNotNull()), window))
        one = hot.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter(F.col("first") < F.col("last")).select("a", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        again = hot.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALT)).cast("int")).join(one, ["a", "b", "salt"]).filter(F.col("id") > F.col("first"))
        out = out.unionAll(again.select("row", "pos", F.lit(1).alias("n"), "first"))
    none = F.lit(None).cast("int")
    return out.unionAll(copies.select("row", none.alias("pos"), none.alias("n"), "first"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(``id_col``, first, start, end): stretches of words, as long as can be, all of whose windows start in ``first`` before; a whole copy has null places."""
    docs = _keyed(docs, id_col, text_col)
    found = written(repeats(docs, window).distinct())
    order = Window.partitionBy("row", "first").orderBy("pos", "n")
    reach = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = found.withColumn("new", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1)))
    pieces = pieces.withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = pieces.groupBy("row", "first", "piece").agg(F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("n")) + window - 1).alias("end"))
    return docs.select("row", "id").join(spans, "row").select(F.col("id").alias(id_col), "first", "start", "end")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("id", "text"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_removed, kept (the kept words, joined by one space) and removed (spans of word places, end exclusive)."""
    docs = _keyed(docs, id_col, text_col)
    runs = written(repeats(docs, window).select("row", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("n", F.lit(0)).alias("n")).distinct())
    starts = runs.groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_words, n_removed, spans = [], [], [], []
            for text, starts in zip(text_of(batch, "text"), batch.column(2), strict=True):
                w = text.as_py().encode().split()
                n_words.append(len(w))
                if not starts.is_valid:
                    kept.append(b" ".join(w)), n_removed.append(0), spans.append([])
                    continue
                at, n = (starts.values.field(k).to_numpy() for k in (0, 1))
                depth = np.zeros(len(w) + 1, np.int32)
                if (at < 0).any():
                    depth[0] = 1
                else:
                    depth += np.bincount(at, minlength=len(w) + 1).astype(np.int32)
                    depth -= np.bincount(at + n + window - 1, minlength=len(w) + 1).astype(np.int32)
                gone = np.cumsum(depth)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "n_words", "n_removed", "kept", "removed"])

    joined = docs.hint("shuffle_hash").join(starts.hint("shuffle_hash"), "row", "left").select("id", "text", "starts")
    out = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)
