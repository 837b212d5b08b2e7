"""Token counts of whole texts by byte-pair merging with a heap over a linked list.

The vocabulary file (a parameter) names the normaliser and the splitting rule, which its library applies to a word;
merging is done here. White space (20, 09-0D) always ends a piece, so texts are taken word by word and each task keeps
the counts of the words it met, up to ``CACHE`` of them, none longer than ``LONGEST``: some 100 MB at any input.

Defined results: null is the empty text, which has no tokens; strings of special tokens count as one each, as the
library takes them by default; nothing is truncated or padded; repeated rows give repeated rows; columns named n_bytes
and n_tokens are replaced, other columns stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from examlake.llm.shared import slices, text_of, with_results

#: Words, and pieces of words, whose counts a task keeps at once, and the length of the longest kept (bytes of words, characters of pieces).
CACHE, LONGEST = 400_000, 64


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The symbols left: as many as there were, less the merges. The adjacent pair of the lowest rank, the leftmost at ties, merges first."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    left = n
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heappush(heap, (r, h, symbols[h], a + b))
    return left


class _Counts(dict):
    """Counts by key, computed when missing, forgotten when there are too many; those of long keys are not kept."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, key):
        n = self.count(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[key] = n
        return n


class Vocabulary:
    """A BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.known, self.end = set(model["vocab"]), model.get("end_of_word_suffix") or ""
        rules = Tokenizer.from_file(path)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        special = sorted((t["content"] for t in file["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)).encode()) if special else None
        self.pieces, self.words = _Counts(self._piece), _Counts(self._word)

    def _piece(self, piece: str) -> int:
        symbols = [*piece[:-1], piece[-1] + self.end]
        return merged([s for s in symbols if s in self.known], self.ranks)

    def _word(self, word: bytes) -> int:
        text = self.normalizer.normalize_str(word.decode()) if self.normalizer else word.decode()
        return sum(self.pieces[p] for p, _ in self.splitter.pre_tokenize_str(text))

    def count(self, text: bytes) -> int:
        if self.special and self.special.search(text):
            return sum(self.count(part) for part in self.special.split(text)) + len(self.special.findall(text))
        return sum(map(self.words.__getitem__, text.split()))


@cache
def vocabulary(path: str) -> Vocabulary:
    """Read once by each Python worker."""
    return Vocabulary(path)


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes and n_tokens. ``path``: the vocabulary file, which every executor has."""
    rows, schema = with_results(docs, "n_bytes long, n_tokens long", without=text_col)
    keep = schema.names[:-2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in slices(batches, text_col):
            texts = text_of(batch, text_col).cast(pa.binary())
            counts = [vocab.count(t.as_py()) for t in texts]
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), size, pa.array(counts, pa.int64())], schema.names)

    return rows.mapInArrow(scan, schema)
