"""Best-fit packing of tokenised documents into sequences of a fixed length, large items matched first.

1. Every document becomes token ids and an end token, cut in pieces of at most ``limit`` tokens. A task numbers its own pieces of
   each length as they come and writes them, so these numbers stay as they are whatever is lost later.
2. Pieces of one length are alike for the packing, so it needs only how many there are of each: at most ``limit`` counts, whatever
   the input. Lengths above a third of the limit go at most two to a sequence: the longest is matched with the longest large one
   that still fits, which needs as few sequences as these can do with. Then the shorter lengths, longest first, each go to the
   smallest gap that takes them (best fit), and to a new sequence only where none does. All sequences of one filling are treated at
   once, as a range of numbers. The result is a list of runs: "pieces number a to b of this length lie q to a sequence from
   sequence s on, at this offset".
3. A piece's number among all of its length (its number in the task plus the counts of the tasks before) gives its run, and the
   run its sequence and offset. No piece is shuffled but to learn its task's count, and no key holds more than one task's pieces.

Defined results: null is the empty text, which has an end token only; strings of special tokens in texts count as one each, as the
library takes them by default; repeated rows are documents of their own; a longer document alone is cut, in pieces whose last may be shorter;
an empty table gives an empty one. Columns other than id and text do not matter, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.shared import slices, text_of, written

#: Words of these characters only are split here: every version of Unicode agrees about them, none combines with another and none is white space.
_PLAIN = re.compile("[\x21-\x7e\u00a1-\u024f]*").fullmatch
#: Words, and pieces of words, whose ids a worker keeps at once, and the length in bytes of the longest kept; words encoded in one call.
CACHE, LONGEST, CALL = 800_000, 64, 4096


class TokenIds:
    """Ids of whole texts (little-endian unsigned 32-bit) by a vocabulary file of the tokenizers library.

    White space (20, 09-0D) always ends a token, so texts are taken word by word and the ids of words met are kept. The library
    encodes what is new, many words in a call; where the file's splitting rule is one pattern, words of Latin letters and signs are
    split by it first, as their parts recur more often than they do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in file["added_tokens"]) or b"(?!)")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        rules, cut = _steps(file.get("normalizer"), "normalizers"), _steps(file.get("pre_tokenizer"), "pretokenizers")
        plain = [s["type"] for s in cut] == ["Split", "ByteLevel"] and "Regex" in cut[0]["pattern"] and cut[0]["invert"] and cut[0]["behavior"] == "Removed" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        known = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"}) for s in rules)
        self.split = regex.compile(cut[0]["pattern"]["Regex"]).findall if plain and known else None
        self.lower = any(s["type"] == "Lowercase" for s in rules)
        suffix, vocabulary = file["model"].get("end_of_word_suffix"), self.library.get_vocab()
        self.last = None
        if suffix:  # ids of tokens that end a part
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), CALL):
            for e in self.library.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _encoded_parts(self, parts: list[str]) -> Iterator[bytes]:
        """The same for parts of words. Where the vocabulary marks the last token of a part, many go as one text, which takes half the time."""
        for at in range(0, len(parts), CALL):
            some = parts[at : at + CALL]
            if self.last is not None:
                ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                to = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(to) == len(some):
                    raw = ids.tobytes()
                    yield from (raw[a:b] for a, b in zip([0, *to], to))
                    continue
            yield from self._encoded(some)

    def _learned(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known."""
        out: dict[bytes, bytes] = {}
        cut, whole = [], []
        for w in new:
            text = w.decode()
            if self.split and _PLAIN(text) and not self.special.search(w):
                cut.append((w, self.split(text.lower() if self.lower else text)))
            else:
                whole.append(w)
        needed = set().union(*(own for _, own in cut))
        parts = {p: self.parts.get(p) for p in needed}
        missing = [p for p, ids in parts.items() if ids is None]
        parts.update(zip(missing, self._encoded_parts(missing)))
        _kept(self.parts, parts, missing)
        of = parts.__getitem__
        for w, own in cut:
            out[w] = b"".join(map(of, own))
        out.update(zip(whole, self._encoded([w.decode() for w in whole])))
        return out

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, in order."""
        words = [t.split() for t in texts]
        known = {w: self.words.get(w) for w in set().union(*words)}
        new = [w for w, ids in known.items() if ids is None]
        known.update(self._learned(new))
        _kept(self.words, known, new)
        of = known.__getitem__
        return [b"".join(map(of, w)) for w in words]


def _kept(cache: dict, found: dict, new: list) -> None:
    """Keeps what is new and short; forgets all before there would be too much."""
    new = [k for k in new if len(k) <= LONGEST]
    if len(cache) + len(new) > CACHE:
        cache.clear()
    if len(new) <= CACHE:
        cache.update((k, found[k]) for k in new)


def _steps(rule: dict | None, inner: str) -> list[dict]:
    return [] if rule is None else rule[inner] if rule["type"] == "Sequence" else [rule]


@cache
def token_ids(path: str) -> TokenIds:
    """Read once by each Python worker."""
    return TokenIds(path)


def pieces(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, number), with the ids themselves if asked for; a written table."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids array<long>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, task, met, last = token_ids(path), TaskContext.get().partitionId(), [0] * (limit + 1), np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            row, cut = [], []
            for i, ids in enumerate(library.of(text_of(batch, "text").cast(pa.binary()).to_pylist())):
                ids = memoryview(ids + last)
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    n = len(part) // 4
                    row.append(i)
                    cut.append((k, at // 4, n, zlib.crc32(part), task, met[n], *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
                    met[n] += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, t in zip(zip(*cut), types)], names)

    return written(rows.mapInArrow(scan, schema))


@dataclass
class Plan:
    """Runs, in order of length and number: pieces from ``number`` on of a ``length`` lie ``each`` to a sequence from ``sequence`` on, from ``offset`` on."""

    length: np.ndarray
    number: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 48) + self.number, length * (1 << 48) + number, "right") - 1
        k = number - self.number[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


class _Gaps:
    """Ranges of sequences (first, how many) by what is still free in each."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.ranges:
                self.ranges[gap] = []
                bisect.insort(self.sizes, gap)
            self.ranges[gap].append((first, n))

    def smallest(self, need: int) -> tuple[int, int, int] | None:
        """A range of the smallest gap that takes ``need``, taken out."""
        at = bisect.bisect_left(self.sizes, need)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, n = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.sizes[at]
        return gap, first, n


def plan(counts: dict[int, int], limit: int = 2048) -> Plan:
    """How pieces are packed, from how many there are of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps, sequences = _Gaps(), 0

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], first, each, offset))
        used[length] += n
        left[length] -= n

    # the large: the longest with the longest that fits beside it
    large = sorted(n for n in left if 3 * n > limit)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, limit - a) - 1
        if at < 0:
            n, gap = left[a], limit - a
            place(a, n, sequences, 1, 0)
        elif large[at] == a:
            n, gap = left[a] // 2, limit - 2 * a
            if n:
                place(a, 2 * n, sequences, 2, 0)
            if left[a]:  # one is left over, for the next shorter one
                gaps.put(gap, sequences, n)
                sequences += n
                at, n, gap = at - 1, 1, limit - a
                place(a, 1, sequences, 1, 0)
                if at >= 0:
                    b = large[at]
                    place(b, 1, sequences, 1, a)
                    gap -= b
        else:
            b = large[at]
            n, gap = min(left[a], left[b]), limit - a - b
            place(a, n, sequences, 1, 0)
            place(b, n, sequences, 1, a)
        gaps.put(gap, sequences, n)
        sequences += n
        large = [x for x in large if left[x]]

    # the others: each to the smallest gap
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            gap, first, n = gaps.smallest(length) or (limit, sequences, -(-left[length] // (limit // length)))
            if first == sequences:
                sequences += n
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                place(length, full * each, first, each, limit - gap)
                gaps.put(gap - each * length, first, full)
            else:
                full, some = 1, left[length]
                place(length, some, first, some, limit - gap)
                gaps.put(gap - some * length, first, 1)
            gaps.put(gap, first + full, n - full)
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def packed(cut: DataFrame, limit: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset, without task and number."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    found = plan(counts, limit)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = cut.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    rows = cut.join(tasks, ["length", "task"]).withColumn("number", F.col("number") + F.col("before")).drop("task", "before")
    rows = rows.select("id", "piece", "start", "length", "ids_crc32", *(c for c in ("ids",) if c in cut.columns), "number")
    kept = rows.columns[:-1]
    runs = cut.sparkSession.sparkContext.broadcast(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            sequence, offset = runs.value.places(of("length").to_numpy(), of("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*map(of, kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: (``id_col``, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    return packed(pieces(docs, path, limit, end, id_col, text_col, with_ids), limit).withColumnRenamed("id", id_col)
