"""Importance resampling towards a target: hashed n-gram counts of both sides, a weight for each text, and a draw by noisy scores.

1. Words are cut from Arrow's bytes; an n-gram is its words joined by one space. Some ten thousand n-grams at a time are interned in
   an open-addressed table in NumPy: the xxhash64 of the bytes is the key, the bytes themselves are compared before two n-grams are
   taken for one, and a slot holds the n-gram's bucket (crc32 modulo ``buckets``) and its count. So crc32 is computed once for each
   different n-gram of a batch, and every occurrence only knows its slot.
2. Counts by bucket are added up by task, then over tasks: S and s of the corpus, T and t of the target. The driver holds
   ``buckets`` pairs and makes a gain of each: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).
3. In a second pass occurrences gather the gains of their slots; a text's weight is the floored mean, its score the weight plus a
   Gumbel number made from the hash of its id, so that the highest scores are a draw without replacement.
4. Scores are whole numbers in a range that depends on the logarithms of the counts (some ten thousand values), so their
   histogram, on the driver, gives the score that the draw ends at. Rows from there on are sorted over range partitions and
   numbered by task; the other rows are not sorted at all.

Defined results: null and blank texts have no features and weight 0; a text without an id has a weight but no score, and is not
among those that are drawn from; repeated rows are texts of their own, those of one score and id stand side by side in any order; an empty corpus or
target counts as zeros; columns other than id and text do not matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import slices, text_of, written
from examlake.llm.words import ALNUM, cuts

#: Occurrences that are interned together, and rows of a partition of drawn texts.
TOGETHER, PART = 1 << 17, 1 << 18

# The primes of xxHash's 64-bit form.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(padded: np.ndarray, width: int) -> np.ndarray:
    """The unsigned number of ``width`` bytes that begins at each byte."""
    return np.ndarray(len(padded) - width + 1, f"<u{width}", padded, strides=(1,))


def xxh64(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of spans of bytes, all at once for those under 32 bytes. ``padded``: the bytes and eight more."""
    eight, four = _lanes(padded, 8), _lanes(padded, 4)
    h = length.astype(np.uint64) + np.uint64(_P5)
    at, left = start.copy(), np.where(length < 32, length, 0)
    while True:
        on = np.flatnonzero(left >= 8)
        if not on.size:
            break
        lane = _turned(eight[at[on]] * np.uint64(_P2), 31) * np.uint64(_P1)
        h[on] = _turned(h[on] ^ lane, 27) * np.uint64(_P1) + np.uint64(_P4)
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _turned(h[on] ^ (four[at[on]].astype(np.uint64) * np.uint64(_P1)), 23) * np.uint64(_P2) + np.uint64(_P3)
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        h[on] = _turned(h[on] ^ (padded[at[on]].astype(np.uint64) * np.uint64(_P5)), 11) * np.uint64(_P1)
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
    h ^= h >> np.uint64(32)
    view = memoryview(padded)
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(view[int(start[i]) : int(start[i] + length[i])])
    return h


def _same_bytes(padded: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from a and from b are the same."""
    eight, same, done = _lanes(padded, 8), np.ones(len(a), bool), 0
    while True:
        on = np.flatnonzero(same & (length > done))
        if not on.size:
            return same
        spare = np.uint64(8) * np.maximum(0, 8 - (length[on] - done)).astype(np.uint64)
        same[on] = ((eight[a[on] + done] ^ eight[b[on] + done]) << spare) == 0
        done += 8


class Interned:
    """The n-grams of a batch: ``slot`` for each occurrence, ``bucket`` and ``count`` for each slot (count 0: an empty one).

    ``key``: the hash of each occurrence, by which it enters the table.
    """

    def __init__(self, padded: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray, buckets: int):
        size = 1 << max(4, (2 * len(start) - 1).bit_length())  # at most half full
        owner = np.full(size, -1, np.int64)  # the occurrence whose bytes stand for the slot
        self.slot = (key & np.uint64(size - 1)).astype(np.int64)
        open_ = np.arange(len(start))
        while open_.size:
            at = self.slot[open_]
            free = owner[at] < 0
            owner[at[free]] = open_[free]  # of several, one stays, and the others are compared with it
            own = owner[at]
            same = (key[own] == key[open_]) & (length[own] == length[open_])
            which = np.flatnonzero(same)
            same[which] = _same_bytes(padded, start[own[which]], start[open_[which]], length[open_[which]])
            open_ = open_[~same]
            self.slot[open_] = (self.slot[open_] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        view = memoryview(padded)
        for s in np.flatnonzero(owner >= 0).tolist():
            i = owner[s]
            self.bucket[s] = zlib.crc32(view[start[i] : start[i] + length[i]]) % buckets


def ngrams(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with eight more, starts, lengths, text numbers) of the runs of 1, then 2, ... ``most`` words, joined by one space; A-Z are lower-cased."""
    data, start, end, first = cuts(texts, ALNUM, lower=True)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    if most > 1:  # one byte between words is enough: a blank
        size = end - start
        to = np.cumsum(size + 1) - size - 1
        own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        joined[np.repeat(to, size) + own] = data[np.repeat(start, size) + own]
        data, start, end = joined, to, to + size
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(1, most + 1):
        n = len(start) - k + 1
        if n <= 0:
            return
        inside = text[:n] == text[k - 1 :]
        yield padded, start[:n][inside], (end[k - 1 :] - start[:n])[inside], text[:n][inside]


def _interned(texts: pa.Array, most: int, buckets: int) -> Iterator[tuple[Interned, np.ndarray]]:
    for padded, start, length, text in ngrams(texts, most):
        for at in range(0, len(start), TOGETHER):
            s, n = start[at : at + TOGETHER], length[at : at + TOGETHER]
            yield Interned(padded, s, n, xxh64(padded, s, n), buckets), text[at : at + TOGETHER]


def bucket_counts(df: DataFrame, text_col: str = "text", most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of all texts are in each bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            for met, _ in _interned(text_of(batch, "text"), most, buckets):
                np.add.at(counts, met.bucket, met.count)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "bucket int, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from both sides' counts."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighted(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of every text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            features, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            texts = text_of(batch, "text")
            for met, text in _interned(texts, most, len(gain)):
                features += np.bincount(text, minlength=n)
                first = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[first]] += np.add.reduceat(gain[met.bucket][met.slot], first)
            words = np.diff(cuts(texts, ALNUM, lower=True)[3]) if most > 1 else features
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))], ["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g that the hash of ``seed:id`` gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int, among: Column) -> DataFrame:
    """``scored`` (id, score, ...) with rank: the highest scores of the rows for which ``among`` holds, so many in a hundred, get 1, 2, ...; ties by id."""
    able = F.coalesce(among & F.col("score").isNotNull(), F.lit(False))
    counts = scored.filter(able).groupBy("score").count().collect()  # a row for each different score
    wanted = percent * sum(r["count"] for r in counts) // 100
    taken, cut = 0, None
    for r in sorted(counts, key=lambda r: -r["score"]):
        if taken >= wanted:
            break
        taken, cut = taken + r["count"], r["score"]
    columns = scored.columns
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("id").asc()]
    parts = scored.filter(near).repartitionByRange(max(1, -(-taken // PART)), *order).sortWithinPartitions(*order)
    # numbered as they come; ``written`` fixes the numbers before the parts are counted
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, TaskContext.get().partitionId()), pa.int32()), pa.array(np.arange(n, n + b.num_rows))], [*columns, "part", "number"])
            n += b.num_rows

    numbered = written(parts.mapInArrow(number, f"{fields}, part int, number long"))
    before, offsets = 0, []
    for r in sorted(numbered.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    rank = F.col("before") + F.col("number") + 1
    top = numbered.join(F.broadcast(scored.sparkSession.createDataFrame(offsets, "part int, before long")), "part")
    top = top.select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return top.unionByName(scored.filter(~near | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every text's (``id_col``, n_features, weight, score, rank). ``most``: words of the longest n-gram; ``rank`` is null for what is not drawn."""
    gain = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_text_col, most, buckets))
    scored = written(weighted(docs, gain, id_col, text_col, most).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    return drawn(scored, percent, F.col("n_words") >= least_words).select("id", "n_features", "weight", "score", "rank").withColumnRenamed("id", id_col)
