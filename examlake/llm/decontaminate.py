"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every shard (a batch of whole documents) builds a suffix array over its words: the starts of all suffixes that begin
with some test bigram (no other can match two words), sorted by their words to ``depth``. Every suffix of every test
item is binary-searched in it; the range of equal suffixes gives all places of the window of ``window`` words.
For the longest verbatim match of each document it is the other way round: the item suffixes are sorted by all their words,
and each suffix of the shard is binary-searched among them, whose neighbours then hold the longest match of that place.
The items are broadcast in blocks of about ``BLOCK_BYTES`` of text at most, one after the other: what a block found is written
before the next one is read, so driver and tasks hold one block at a time. Documents are never shuffled.

Defined results: a null text or item has no words; an item of fewer words than a window is one window; an item
without words matches nothing; equal item ids count once; an item of a null id hits words, but is not listed in items;
repeated rows give repeated rows; an empty benchmark contaminates nothing; columns that have a result's name (n_words,
n_hit, spans, items, longest) are replaced, other columns stay. The longest match may be of one word; of equal lengths the earliest in the
document counts, then the least item id as a string (null last) and the earliest place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import dropped, fresh, slices, text_of, with_results, written
from examlake.llm.words import ALNUM, mixed, words

#: Bytes of item texts that one broadcast holds, and items that one collect returns.
BLOCK_BYTES = 32 << 20
MATCH = "struct<item_id:string,length:int,item_start:int,doc_start:int>"
FOUND = f"struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>,longest:{MATCH}>"


class _Items:
    """Test suffixes of one block of items: word hashes, and for each start the item and the words that a window takes (0: none starts here)."""

    def __init__(self, ids: list, texts: list, window: int):
        w = words(pa.array([t or "" for t in texts], pa.large_string()), ALNUM, lower=True)
        self.ids, self.hash, self.item = [None if x is None else str(x) for x in ids], w.hash, w.text()
        place, count = w.place(), np.repeat(w.count, w.count)
        self.left = count - place  # words to the item's end
        self.place = place
        self.takes = np.where(count < window, np.where(place == 0, count, 0), np.where(self.left >= window, window, 0))
        self.depth = max(window, 2)
        self._sort()

    def _sort(self) -> None:
        """All suffixes in order of all their words (``sa``), by doubling; ``key`` is the item, by its name, and the place of each."""
        n, k = len(self.hash), 1
        self.alphabet, rank = np.unique(self.hash, return_inverse=True)
        rank, most = rank.astype(np.int64) + 1, int(self.left.max(initial=0))
        while k < most:  # ranks of the first k words; what ends earlier goes first
            follow = np.zeros(n, np.int64)
            live = np.flatnonzero(self.left > k)
            follow[live] = rank[live + k]
            rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64) + 1
            k *= 2
        self.sa = np.argsort(rank, kind="stable")
        self.names = sorted(set(self.ids), key=lambda x: (x is None, x or ""))
        number = {x: i for i, x in enumerate(self.names)}
        self.key = ((np.array([number[x] for x in self.ids], np.int64)[self.item] << 32) + self.place)[self.sa]

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.alphabet[np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)] == h

    def symbols(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Words of the suffixes at ``at``, padded with 0 beyond the item's end."""
        out = np.zeros((depth, len(at)), np.uint64)
        for d in range(depth):
            live = self.left[at] > d
            out[d, live] = self.hash[at[live] + d]
        return out


def _pairs(h: np.ndarray, left: np.ndarray) -> np.ndarray:
    follow = np.zeros(len(h), np.uint64)
    follow[:-1] = h[1:]
    return mixed(h ^ mixed(np.where(left > 1, follow, np.uint64(0)) + np.uint64(1)))


class _SuffixArray:
    def __init__(self, w, items: _Items):
        self.w, depth = w, items.depth
        n = len(w.hash)
        self.left = np.repeat(w.count, w.count) - w.place()
        short = items.hash[(items.left == 1) & (items.place == 0)]  # items of one word match without a second
        starts = np.flatnonzero(np.isin(_pairs(w.hash, self.left), _pairs(items.hash, items.left)) | np.isin(w.hash, short)) if n else np.zeros(0, np.int64)
        keys = np.zeros((depth, len(starts)), np.uint64)
        for d in range(depth):
            live = self.left[starts] > d
            keys[d, live] = w.hash[starts[live] + d]
        order = np.lexsort(keys[::-1]) if len(starts) else np.zeros(0, np.int64)
        self.sa, self.keys = starts[order], keys[:, order]

    def search(self, want: np.ndarray, takes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and place after the last of suffixes that begin with the first ``takes`` words of each column of ``want``."""
        n, m = len(self.sa), want.shape[1]

        def bound(right: bool) -> np.ndarray:
            lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                less, tied = np.zeros(m, bool), open_.copy()
                for d in range(len(want)):
                    live = np.flatnonzero(tied & (takes > d))
                    if not len(live):
                        break
                    have, need = self.keys[d, mid[live]], want[d, live]
                    less[live[have < need]] = True
                    tied[live[have != need]] = False
                go = open_ & (less | (tied & right))
                lo = np.where(go, mid + 1, lo)
                hi = np.where(open_ & ~go, mid, hi)
            return lo

        return bound(False), bound(True)


def _matched(h: np.ndarray, at: np.ndarray, cap: np.ndarray, items: _Items, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the first ``cap`` words from each place ``at`` belong among all item suffixes (before or behind those that begin with them), and how many of them the longest match takes."""
    lo, hi = np.full(len(at), -1), np.full(len(at), len(items.sa))
    of_lo, of_hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    while len(open_ := np.flatnonzero(hi - lo > 1)):
        mid = (lo[open_] + hi[open_]) >> 1
        there, here, most = items.sa[mid], at[open_], cap[open_]
        most_there = items.left[there]
        n = np.minimum(of_lo[open_], of_hi[open_])  # what both neighbours share is shared by all between them
        live = np.arange(len(open_))
        while len(live):
            live = live[(n[live] < most[live]) & (n[live] < most_there[live])]
            live = live[items.hash[there[live] + n[live]] == h[here[live] + n[live]]]
            n[live] += 1
        before = np.where(n == most, right, n == most_there)
        differ = np.flatnonzero((n < most) & (n < most_there))
        before[differ] = items.hash[there[differ] + n[differ]] < h[here[differ] + n[differ]]
        for side, best, ok in ((lo, of_lo, before), (hi, of_hi, ~before)):
            side[open_[ok]], best[open_[ok]] = mid[ok], n[ok]
    return lo + 1, np.maximum(of_lo, of_hi)


def _longest(sa: _SuffixArray, items: _Items) -> dict[int, tuple[int, str | None, int, int]]:
    """By text, its longest match of any item suffix: (length, item, place in the item, place in the text). Of equal lengths the earliest in the text counts, then the least item and place in it."""
    w, text = sa.w, sa.w.text()
    if not len(w.hash) or not len(items.sa):
        return {}
    starts = np.sort(sa.sa)
    _, length = _matched(w.hash, starts, sa.left[starts], items, True)
    order = np.lexsort((starts, -length, text[starts]))
    order = order[np.diff(text[starts[order]], prepend=-1) != 0]
    order = order[length[order] > 1]
    at, length = starts[order], length[order]
    # texts that share no pair of words: the first word that stands in an item
    rest = np.ones(len(w.first) - 1, bool)
    rest[text[at]] = False
    single = np.flatnonzero(rest[text])
    single = single[items.has(w.hash[single])]
    single = single[np.diff(text[single], prepend=-1) != 0]
    at, length = np.concatenate([at, single]), np.concatenate([length, np.ones(len(single), np.int64)])
    ranges = np.stack([_matched(w.hash, at, length, items, right)[0] for right in (False, True)], axis=1)
    ranges, of = np.unique(ranges, axis=0, return_inverse=True)
    least = np.array([items.key[a:b].min() for a, b in ranges], np.int64)[of.reshape(-1)]
    place = w.place()[at]
    return {int(t): (int(n), items.names[k >> 32], int(k & 0xFFFFFFFF), int(p)) for t, n, k, p in zip(text[at], length, least, place, strict=True)}


def _better(match: dict) -> tuple:
    """Of the matches of several blocks the least by this is the longest one; ties as in ``_longest``."""
    return -match["length"], match["doc_start"], match["item_id"] is None, match["item_id"] or "", match["item_start"]


def _block(docs: DataFrame, text_col: str, block) -> DataFrame:
    """Adds the findings for one block of items to those in the last column."""
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = block.value
        at = np.arange(len(items.hash))
        want = items.symbols(at, items.depth)
        for batch in slices(batches, text_col, 8 << 20):
            w = words(text_of(batch, text_col), ALNUM, lower=True)
            sa = _SuffixArray(w, items)
            lo, hi = sa.search(want, np.where(items.takes > 0, items.takes, items.depth))
            hits = np.flatnonzero((items.takes > 0) & (hi > lo))
            n = (hi - lo)[hits]
            suffix = sa.sa[np.repeat(lo[hits] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            of = np.repeat(hits, n)
            text = w.text()
            doc = text[suffix] if len(suffix) else np.zeros(0, np.int64)
            longest = _longest(sa, items)
            by_doc = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[by_doc], np.arange(batch.num_rows + 1))
            rows = []
            for i, before in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                mine = by_doc[cut[i] : cut[i + 1]]
                spans = {(int(s - w.first[i]), int(s - w.first[i] + items.takes[t])) for s, t in zip(suffix[mine], of[mine], strict=True)}
                ids = {items.ids[items.item[t]] for t in of[mine]}
                best = longest.get(i)
                match = None if best is None else dict(zip(("length", "item_id", "item_start", "doc_start"), best, strict=True))
                if before is not None:
                    spans |= {(x["start"], x["end"]) for x in before["spans"]}
                    ids |= set(before["items"])
                    match = min((x for x in (before["longest"], match) if x), key=_better, default=None)
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                rows.append({"n_words": int(w.count[i]), "spans": [{"start": a, "end": b} for a, b in merged], "items": sorted(x for x in ids if x is not None), "longest": match})
            kinds = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("longest", pa.struct([("item_id", pa.string()), ("length", pa.int32()), ("item_start", pa.int32()), ("doc_start", pa.int32())]))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kinds)], names)

    return docs.mapInArrow(scan, docs.schema)


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (of hit words), items (ids with a window in the text, sorted as strings) and longest (the longest verbatim match of any test suffix)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs, _ = with_results(docs, f"n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>, longest {MATCH}")
    column = fresh(docs, "found")
    out = docs.withColumn(column, F.lit(None).cast(FOUND))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id").collect()
        sent = spark.sparkContext.broadcast(_Items([r["id"] for r in rows], [r["text"] for r in rows], window))
        before, out = out, _block(out, text_col, sent)
        if k + 1 < blocks:
            out = written(out)
            sent.destroy()
            if k:
                dropped(before)
    of = lambda name: F.col(f"{column}.{name}").alias(name)
    hit = F.aggregate(F.col(f"{column}.spans"), F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(*docs.columns, of("n_words"), hit.alias("n_hit"), of("spans"), of("items"), of("longest"))


def contaminated(n_hit, n_words):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
