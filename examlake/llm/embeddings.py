"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

1. Equal vectors of a label are one class. A class is stored once as its code: its unit vector o is rotated at random and kept
   as its signs, c = <signs / sqrt(D), o>, and the rotated vector itself in steps of 1 / 127 of its largest part, with the
   length of what that leaves out. <signs / sqrt(D), q> / c estimates <o, q> without bias, with an error of about
   sqrt((1 - c^2) / c^2 / (D - 1)); ``SIGMAS`` such errors, and what the steps leave out, bound it from above.
2. Codes, some 100 bytes at 64 dimensions, are compared in tasks of two blocks each. Every label is compared whole, whatever
   its size: no pair depends on how many others there are. The cost grows with the square of the label, a task's memory does
   not. Only a caller that names ``whole`` has labels of more classes compared by hash tables over the signs of further
   rotations: two classes are compared where they agree on all ``bits`` signs of a table; bits grow with the logarithm of the
   largest label, tables as many as make a pair at the threshold meet with probability ``MEET``, so some pairs are lost.
3. Only classes of which some pair's bound reaches the threshold in a task have their vectors joined to it; there the bound
   decides which pairs are computed exactly, in doubles. A pair is counted in the first table where it meets. Tasks return
   sums and a spanning forest, never pairs.

Defined results: vectors that are null, of zero length, hold null or non-finite components, or have a null label, link with
nothing; vectors of other lengths are not compared; repeated rows are vectors of their own; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.graph import components
from examlake.llm.shared import written

MEET, SIGMAS = 0.985, 4.0
#: Classes of one block, classes of a label up to which hash tables are not worth it, and rows of one task of small buckets.
BLOCK, WHOLE, BIN = 4096, 32_768, 20_000
#: Rows of a block compared at once.
_STRIP = 512


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """The same for every task: from the numbers only."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _plan(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(30, max(6, ceil(log2(max(largest, 2)))))
    agree = 1 - float(np.arccos(threshold)) / pi
    return bits, ceil(log(1 - MEET) / log(1 - agree**bits))


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each vector and table, the signs as an integer."""
    dim = unit.shape[1]
    need = bits * tables
    signs = np.concatenate([unit @ rotation(dim, 1 + i).T >= 0 for i in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits)).astype(np.int64)


class Codes:
    """Signs (packed), factor, steps (int8), scale and rest (the length that the steps leave out) of vectors of one dimension."""

    FIELDS = "signs binary, factor float, steps binary, scale float, rest float"

    def __init__(self, signs: np.ndarray, factor: np.ndarray, steps: np.ndarray, scale: np.ndarray, rest: np.ndarray):
        self.signs, self.factor, self.steps, self.scale, self.rest = signs, factor, steps, scale, rest

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1], 0).T
        positive = turned >= 0
        factor = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
        scale = np.abs(turned).max(axis=1) / 127
        steps = np.rint(turned / scale[:, None]).astype(np.int8)
        rest = np.linalg.norm(turned - steps * scale[:, None], axis=1)
        return cls(np.packbits(positive, axis=1), factor.astype(np.float32), steps, scale.astype(np.float32), np.nextafter(rest.astype(np.float32), np.float32(1)))

    @classmethod
    def read(cls, rows: pa.Table, at: np.ndarray, dim: int) -> Codes:
        pick = pa.array(at)
        column = lambda name: rows.column(name).combine_chunks().take(pick)
        raw = lambda name, kind, width: np.frombuffer(b"".join(column(name).to_pylist()), kind).reshape(len(at), width)
        number = lambda name: column(name).to_numpy(zero_copy_only=False)
        return cls(raw("signs", np.uint8, -(-dim // 8)), number("factor"), raw("steps", np.int8, dim), number("scale"), number("rest"))

    def candidates(self, threshold: float, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of which both upper bounds reach the threshold. sides: only pairs of different sides."""
        n, dim = self.steps.shape
        root = np.float32(np.sqrt(dim))
        code = np.where(np.unpackbits(self.signs, axis=1, count=dim), np.float32(1), np.float32(-1)) / root
        value = self.steps * self.scale[:, None]
        c = np.minimum(self.factor, np.float32(1))
        error = SIGMAS * np.sqrt((1 - c**2) / c**2 / max(dim - 1, 1))
        out_i, out_j = [], []
        for a in range(0, n, _STRIP):
            b = min(a + _STRIP, n)
            # the strip's codes against all values from its first on, and the reverse
            upper = (code[a:b] @ value[a:].T + self.rest[a:]) / c[a:b, None] + error[a:b, None]
            other = (value[a:b] @ code[a:].T + self.rest[a:b, None]) / c[a:] + error[a:]
            hit = np.minimum(upper, other) >= threshold - 1e-5
            i, j = np.nonzero(hit)
            later = j > i
            if sides is not None:
                later &= sides[a + i] != sides[a + j]
            out_i.append(a + i[later]), out_j.append(a + j[later])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return join(out_i), join(out_j)


def linked_pairs(x: np.ndarray, codes: Codes, threshold: float, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) with i < j and cosine of threshold or more, and how many pairs were computed exactly."""
    norm = np.linalg.norm(x, axis=1)
    i, j = codes.candidates(threshold, sides)
    exact = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        exact[b] = np.einsum("ij,ij->i", x[i[b]], x[j[b]]) / (norm[i[b]] * norm[j[b]])
    near = exact >= threshold
    return i[near], j[near], len(exact)


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, label, dim, code fields, keys): what is stored of each class. keys is empty without tables."""

    def scan(batches):
        for batch in batches:
            vectors, ids, labels = batch.column(2).to_pylist(), batch.column(0), batch.column(1)
            for dim in sorted({len(v) for v in vectors}):
                own = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[i] for i in own], np.float64)
                codes = Codes.of(x)
                keys = _keys(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables) if tables else np.zeros((len(own), 0), np.int64)
                pick = pa.array(own)
                columns = [ids.take(pick), labels.take(pick), pa.array(np.full(len(own), dim, np.int32))]
                columns += [pa.array([r.tobytes() for r in codes.signs], pa.binary()), pa.array(codes.factor), pa.array([r.tobytes() for r in codes.steps], pa.binary()), pa.array(codes.scale), pa.array(codes.rest)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(keys), pa.list_(pa.int32()))], names)

    names = ["id", "label", "dim", "signs", "factor", "steps", "scale", "rest", "keys"]
    return classes.select("id", "label", "v").mapInArrow(scan, f"id long, label {classes.schema['label'].dataType.simpleString()}, dim int, {Codes.FIELDS}, keys array<int>")


def _units(rows: pa.Table):
    """Rows of one comparison each: (their places, dim, sides or None)."""
    number, side, dim = (rows.column(c).to_numpy() for c in ("number", "side", "dim"))
    order = np.argsort(number, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        if len(own) > 1:
            yield own, int(dim[own[0]]), (side[own] if side[own[0]] >= 0 else None)


def _looked_at(threshold: float):
    """Codes only: which rows of a comparison stand in a pair that the bound does not exclude."""

    def compare(rows: pa.Table) -> pa.Table:
        some = [np.zeros(0, np.int64)]
        for own, dim, sides in _units(rows):
            some.append(own[np.unique(np.concatenate(Codes.read(rows, own, dim).candidates(threshold, sides)))])
        at = pa.array(np.concatenate(some))
        return pa.table({c: rows.column(c).combine_chunks().take(at) for c in ("id", "number", "side", "table")})

    return compare


def _computed(threshold: float):
    """Codes and vectors of those rows: sums of links and a spanning forest."""

    def compare(rows: pa.Table) -> pa.Table:
        ids, copies, table = (rows.column(c).to_numpy() for c in ("id", "copies", "table"))
        vectors, keys = rows.column("v").combine_chunks(), rows.column("keys").combine_chunks()
        a, links, to = [], [], []
        for own, dim, sides in _units(rows):
            pick = pa.array(own)
            x = np.asarray(vectors.take(pick).flatten(), np.float64).reshape(len(own), dim)
            i, j, _ = linked_pairs(x, Codes.read(rows, own, dim), threshold, sides)
            if not len(i):
                continue
            if (t := int(table[own[0]])) > 0:
                k = np.asarray(keys.take(pick).flatten()).reshape(len(own), -1)[:, :t]
                first = ~(k[i] == k[j]).any(axis=1)
                i, j = i[first], j[first]
            sums = np.bincount(i, copies[own][j], len(own)) + np.bincount(j, copies[own][i], len(own))
            root = np.arange(len(own))
            while len(i):  # the smallest position reachable, by pointer jumping
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(sums)
            a.append(ids[own][some]), links.append(sums[some].astype(np.int64)), to.append(ids[own][root[some]])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"id": join(a), "links": join(links), "near": join(to)})

    return compare


def _compared(rows: DataFrame, coded: DataFrame, classes: DataFrame, bucket: list[str], table, threshold: float) -> DataFrame:
    """(id, links, near) of all comparisons: ``rows`` of ``coded`` classes that agree in ``bucket``, by pairs of blocks."""
    code = [f.split()[0] for f in Codes.FIELDS.split(", ")]
    size = written(rows.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"))
    copied = size.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]
    bins = max(1, -(-copied // BIN))
    dealt = rows.select("id", *code, *bucket).join(size, bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    dealt = dealt.withColumn("p", F.explode(pairs))
    number = F.xxhash64(*bucket, "p")
    side = F.when(F.col("p.x") == F.col("p.y"), -1).otherwise(F.col("block"))
    # two full blocks are a task of their own, small buckets are put together
    task = F.when(F.col("blocks") > 1, number).otherwise(F.pmod(number, F.lit(bins)))
    dealt = dealt.select("id", "dim", *code, table.cast("int").alias("table"), number.alias("number"), side.alias("side"), task.alias("task"))
    looked = written(dealt.groupBy("task").applyInArrow(_looked_at(threshold), "id long, number long, side int, table int"))
    tasks = max(1, -(-looked.count() // BIN))
    own = classes.select("id", "copies", "v").join(coded.select("id", "dim", "keys", *code), "id")
    sure = looked.join(own, "id").withColumn("task", F.pmod("number", F.lit(tasks)))
    return sure.groupBy("task").applyInArrow(_computed(threshold), "id long, links long, near long")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, whole: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links, component_id and kept. ``whole``: classes of a label up to which it is compared whole; None: always."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("class", F.when(usable, F.xxhash64("v"))).withColumn("class2", F.when(usable, F.hash("v")))
    keys = ["label", "class", "class2"]
    classes = written(rows.filter("class is not null").groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    sizes = classes.groupBy("label", F.size("v").alias("dim")).count()
    large = written(sizes.filter(F.lit(False) if whole is None else F.col("count") > whole).select("label", "dim", "count"))
    largest = large.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables = _plan(largest, threshold) if largest else (0, 0)
    coded = written(_coded(classes, bits, tables))
    if largest:
        in_tables = coded.join(large, ["label", "dim"], "left_semi").withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
        in_tables = in_tables.withColumn("key", F.get("keys", F.col("table")))
        coded_whole = coded.join(large, ["label", "dim"], "left_anti")
        found = _compared(in_tables, coded, classes, ["label", "dim", "table", "key"], F.col("table"), threshold).unionAll(_compared(coded_whole, coded, classes, ["label", "dim"], F.lit(-1), threshold))
    else:
        found = _compared(coded, coded, classes, ["label", "dim"], F.lit(-1), threshold)
    found = written(found)

    groups = components(found.select(F.col("id").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.select(*keys, "id", "copies").join(links, "id", "left").join(groups, "id", "left")
    of = of.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", *keys).join(of, keys, "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
