"""Quality by ordinal cumulative-link (proportional odds) regression on graded ratings.

Grades: 0 poor, 1 readable but toxic, 2 good (from labels: quality 0; quality 1 and toxic; the rest). With one weight
vector w over hashed text features and ordered thresholds t1 < t2, P(grade >= k) = 1 / (1 + exp(t_k - w x)); the expected
grade is the sum of these. A text is kept when P(grade >= 2) reaches ``KEEP``.

Features are hashed: words in lower case, their beginnings (six bytes), their shapes (letters a or A, digits 0, runs shortened)
and repeated neighbours. Each family is the square root of its relative counts, so long and short texts weigh alike.
The model is fitted on at most ``SAMPLE`` labelled texts, chosen by a hash of their id, none of more than ``LONGEST`` words and
no more than ``MOST_WORDS`` words together, documented bounds of the one task that fits it; all texts are scored, whole.
Training is deterministic.

Defined results: a null or empty text has no features and is rejected; repeated rows give repeated rows; labels with
a null count as missing; without any label there is no model and everything with words is kept; columns named
expected_grade and p_good are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.shared import slices, smallest, text_of, with_results, written
from examlake.llm.words import NON_SPACE, _span_hashes, mixed, words

SAMPLE, BITS, STEPS, KEEP = 12_000, 18, 300, 0.8
#: Bytes of text whose features are made at once, and features of one piece of a sum.
SLICE, _PIECE = 2 << 20, 1 << 20
#: Words of the longest text that is learned from, and of all.
LONGEST, MOST_WORDS = 100_000, 10_000_000
#: Texts that a feature must stand in to get a weight, and how the weights are fitted.
LEAST, RIDGE, RATE = 4, 1e-5, 2.0
#: What a word's beginning takes, in bytes.
HEAD = 6
#: Bytes by shape: lower case and beyond ASCII a, upper case A, digits 0, others themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_LETTER = (_SHAPE == ord("a")) | (_SHAPE == ord("A")) | (_SHAPE == ord("0"))


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape, runs shortened to one byte."""
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[start] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return _span_hashes(shape[keep], upto[start], upto[end])


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts, by text."""
    w = words(texts, NON_SPACE, lower=True)
    raw = words(texts, NON_SPACE)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text = w.text()
    # without what stands around the letters
    letter = _LETTER[w.data]
    first, last = np.zeros(len(w.start), np.int64), np.zeros(len(w.start), np.int64)
    at = np.flatnonzero(letter)
    if len(at):
        first = np.minimum(at[np.minimum(np.searchsorted(at, w.start), len(at) - 1)], w.end)
        last = np.maximum(at[np.maximum(np.searchsorted(at, w.end) - 1, 0)] + 1, w.start)
    ok = (first >= w.start) & (last <= w.end) & (first < last)
    first, last = np.where(ok, first, w.start), np.where(ok, last, w.end)
    plain = _span_hashes(w.data, first, last)
    head = _span_hashes(w.data, first, np.minimum(first + HEAD, last))
    same = np.zeros(len(plain), bool)
    same[1:] = (plain[1:] == plain[:-1]) & (text[1:] == text[:-1])
    out_t, out_f, out_v = [], [], []
    for family, h in enumerate((plain, head, _shapes(raw.data, raw.start, raw.end), same.astype(np.uint64))):
        f = (mixed(h + np.uint64(family * 0x9E3779B9 + 1)) >> np.uint64(64 - bits)).astype(np.int64)
        cell, n = np.unique(text * (1 << bits) + f, return_counts=True)
        t = cell >> bits
        out_t.append(t), out_f.append(cell & ((1 << bits) - 1)), out_v.append(np.sqrt(n / w.count[t]))
    t, f, v = map(np.concatenate, (out_t, out_f, out_v))
    order = np.argsort(t, kind="stable")
    return t[order], f[order], v[order]


def likelihood(x: np.ndarray, theta: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean weighted loss -log(P(>= grade) - P(> grade)) with its ridge, and its gradients by weights ``x`` and by ``theta``: the first threshold and the log of the gap to the second, so they stay in order."""
    n, at = len(grade), np.arange(len(grade))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    parts = [slice(a, a + _PIECE) for a in range(0, len(row), _PIECE)]  # what is made of a feature is made of a few at once
    eta = np.zeros(n)
    for s in parts:
        eta += np.bincount(row[s], x[column[s]] * value[s], n)
    cut = np.array([theta[0], theta[0] + np.exp(theta[1])])
    above = np.stack([np.ones(n), sigmoid(eta - cut[0]), sigmoid(eta - cut[1]), np.zeros(n)])
    slope = above * (1 - above)
    p = np.maximum(above[grade, at] - above[grade + 1, at], 1e-9)
    d_eta = weight * (slope[grade + 1, at] - slope[grade, at]) / p / n
    d_cut = np.array([np.sum(weight * (np.where(grade == j, slope[j, at], 0) - np.where(grade == j - 1, slope[j, at], 0)) / p) / n for j in (1, 2)])
    loss = -np.sum(weight * np.log(p)) / n + ridge / 2 * np.sum(x**2)
    g = ridge * x
    for s in parts:
        g += np.bincount(column[s], d_eta[row[s]] * value[s], len(x))
    return loss, g, np.array([d_cut.sum(), d_cut[1] * np.exp(theta[1])])


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, bits: int = BITS, steps: int = STEPS, ridge: float = RIDGE, rate: float = RATE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient descent on all rows, which learns what many texts share before what few do; grades are weighted alike."""
    k = 2
    n, w = len(grade), np.zeros(1 << bits)
    theta = np.array([-1.0, np.log(2.0)])
    # a feature of few texts says nothing about others
    used = np.flatnonzero(np.bincount(feature, minlength=1 << bits) >= max(least, 1))
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    column = place[feature]
    some = column >= 0
    row, column, value = row[some], column[some], value[some]
    x = np.zeros(len(used))
    x_before, theta_before = x, theta
    share = np.bincount(grade, minlength=k + 1)
    weight = (n / (np.count_nonzero(share) * np.maximum(share, 1)))[grade] ** 0.5
    for step in range(1, steps + 1):
        ahead = (step - 1) / (step + 2)
        y, z = x + ahead * (x - x_before), theta + ahead * (theta - theta_before)
        _, g, gt = likelihood(y, z, row, column, value, grade, weight, ridge)
        x_before, theta_before = x, theta
        x, theta = y - rate * g, np.array([z[0] - 0.05 * rate * gt[0], max(z[1] - 0.05 * rate * gt[1], -1.0)])
    w[used] = x
    return w, np.array([theta[0], theta[0] + np.exp(theta[1])])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (2**bits floats, whatever the input) and thresholds. Features are made by all tasks, only those of the sample are gathered."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    rated = smallest(rated.groupBy(F.col(id_col).alias("id")).agg(F.min(grade).alias("grade")).withColumn("at", F.xxhash64("id")), "at", sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rated), "id")  # at most `sample` rows of three numbers
    texts = written(texts)
    # at most `sample` ids: their sizes are put in order in one task
    sized = texts.groupBy("id", "at").agg(F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).filter(F.col("words") <= LONGEST)
    so_far = F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("at", "id"))
    few = sized.withColumn("so_far", so_far).filter(F.col("so_far") <= MOST_WORDS).select("id")
    texts = texts.join(F.broadcast(few), "id", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            t, f, v = features(text_of(batch, "text"), bits)
            ends = np.searchsorted(t, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (f.astype(np.int32), v.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["id", "grade", "f", "v"])

    def fitted(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.diff(ids[order], prepend=ids[order[:1]] - 1) != 0]  # one text of each id
        rows = rows.take(pa.array(order)).combine_chunks()
        f, v = (rows.column(c).chunk(0) for c in ("f", "v"))
        n = np.diff(f.offsets.to_numpy())
        w, cut = fit(np.repeat(np.arange(len(n), dtype=np.int32), n), f.flatten().to_numpy(), v.flatten().to_numpy(), rows.column("grade").to_numpy().astype(np.int64), bits)
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "cut": pa.array([cut.astype(np.float64).tobytes()], pa.binary())})

    model = texts.select("id", "text", "grade").mapInArrow(hashed, "id long, grade int, f array<int>, v array<float>").groupBy().applyInArrow(fitted, "w binary, cut binary").collect()
    return (np.frombuffer(bytes(model[0]["w"]), np.float32), np.frombuffer(bytes(model[0]["cut"]), np.float64)) if model else None


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with expected_grade and p_good (null for a text without words, or without a model)."""
    docs, schema = with_results(docs, "expected_grade double, p_good double")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "p_good": F.lit(None).cast("double")})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cut = sent.value
        for batch in slices(batches, text_col, SLICE):
            t, f, v = features(text_of(batch, text_col), bits)
            eta = np.bincount(t, w[f] * v, batch.num_rows)
            some = np.bincount(t, minlength=batch.num_rows) > 0
            p1, p2 = (1 / (1 + np.exp(np.clip(c - eta, -40, 40))) for c in cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p1 + p2, mask=~some), pa.array(p2, mask=~some)], names)

    return docs.mapInArrow(scan, schema)


def keeps(p_good, text=None, model=True, threshold: float = KEEP):
    """The decision: a tail probability of the threshold or more; without a model (None) every ``text`` that has words."""
    if model is None:
        return F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return F.coalesce(p_good >= threshold, F.lit(False))
