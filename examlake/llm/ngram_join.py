"""Jaccard join of word n-gram sets, size-aware: small sets by enumerated subsets, large sets by inverted lists.

1. One scan gives every text's set size and set digest, and a fixed-size table of shingle counts (a sketch).
   Texts with equal sets are one class, of which the smallest id stands for all. Copies of classes that hold more than
   1 / ``HEAVY`` of all texts emit nothing below (there are fewer than ``HEAVY`` such classes); other classes are small.
2. Two sets of n and m shingles link when they share c(n, m) = ceil(t (n + m) / (1 + t)) of them. Sets of up to
   ``boundary`` shingles emit all their subsets of each size c that some partner can ask for: two sets link exactly
   if they share a subset of size c(n, m). In each list the set of the smallest size links with all that link at all.
3. Larger sets stand in inverted lists of their prefix, the n - ceil(t n) + l(n) shingles that come first in one order
   (shingles that the sketch finds frequent come last), where l(n) = 1 + n / 16. Sets that link share l of the smaller
   one's lists at least, so they share l / 2 short lists (up to ``SHORT`` sets) or l / 2 long ones. Short lists give their
   pairs, which are counted; a long list joins the sets in it that stand in l / 2 long lists at all, by runs of sizes.
   Lists of shingles that the sketch finds in very many texts are long ones without being counted; what long lists and
   subsets need of a list are minima by size, aggregated before the shuffle and joined back over ``SALT`` keys.
   Sets joined in one of these ways form a cluster; clusters are cut in blocks by size and hash, and each pair of blocks
   whose sizes fit is one task that scans the inverted lists of its shingles and counts overlaps exactly.
4. The boundary is where rows enumerated and rows scanned cost least, from the counts of sets by size.
5. Links (only as many as connect what a task found) become connected components.

Defined results: a text of fewer than k words has its whole sequence as its one shingle; a text without words (or a
null) has an empty set, links with nothing and is its own component; repeated rows give repeated rows; a null id
links with nothing and has a null component; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.graph import components
from examlake.llm.shared import slices, text_of, written
from examlake.llm.words import NON_SPACE, mixed, sequence_hash, words

#: Slots of the sketch of shingle counts, and slots of one row of it.
SLOTS, ROW = 1 << 20, 1 << 12
#: Sets and shingles of one block of a cluster.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_500_000
#: Sizes from which on no subsets are enumerated, whatever they cost.
LARGEST_SMALL = 16
#: Sets of a list whose pairs are counted.
SHORT = 16
#: The largest number of classes whose copies are told apart, what a slot must hold beyond twice the mean to be no list in one task, and keys of one joined list.
HEAVY, HOT, SALT = 65_536, 20_000, 16


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each text, the text of each, and each text's set size."""
    w = words(texts, NON_SPACE, lower=True)
    h, at = w.windows(k)
    text = w.text()[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        h = np.concatenate([h, np.array([sequence_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)])
        text = np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, text, np.bincount(text, minlength=len(texts))


def _digest(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's whole set."""
    ends = np.cumsum(n)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
    return [(s[ends] - s[ends - n]).view(np.int64) for s in sums]


def _digests(docs: DataFrame, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, "text"):
            h, text, n = shingle_sets(text_of(batch, "text"), k)
            counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            d1, d2 = _digest(h, n)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        full = [i for i in range(SLOTS // ROW) if counts[i * ROW : (i + 1) * ROW].any()]
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(full, pa.int32()), pa.array([counts[i * ROW : (i + 1) * ROW].tobytes() for i in full], pa.binary())], names)

    names = ["id", "n", "d1", "d2", "slots", "counts"]
    return docs.mapInArrow(scan, "id long, n long, d1 long, d2 long, slots int, counts binary")


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of the sketch, whether it holds clearly more than a mean slot, and whether very much more: twice SLOTS bits at any input size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slots", "counts"])

    counts = np.zeros(SLOTS, np.int64)
    rows = scan.filter(F.col("slots").isNotNull()).select("slots", "counts").repartition("slots").mapInArrow(added, "slots int, counts binary")
    for at, part in rows.collect():  # SLOTS / ROW rows of 32 KB: the sketch, 8 MB
        counts[at * ROW : (at + 1) * ROW] = np.frombuffer(bytes(part), np.int64)
    mean = counts.mean()
    return np.packbits(counts > mean + 8 * np.sqrt(mean) + 8), np.packbits(counts > 2 * mean + HOT)


def _heavy(classes: DataFrame) -> tuple[np.ndarray, ...]:
    """n, both digests and the representative of classes of more than 1 / HEAVY of all texts, by the first digest."""
    texts = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = classes.filter(F.col("copies") > max(1, texts / HEAVY)).select("d1", "d2", "n", "rep").collect()  # fewer than HEAVY
    d1, d2, n, rep = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    order = np.argsort(d1, kind="stable")
    return d1[order], d2[order], n[order], rep[order]


def _is_copy(h: np.ndarray, n: np.ndarray, ids: np.ndarray, heavy: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which texts have a heavy class's set and are not its representative."""
    out = np.zeros(len(n), bool)
    if len(heavy[0]):
        d1, d2 = _digest(h, n)
        at = np.searchsorted(heavy[0], d1)
        for step in range(2):  # digests that agree by half stand side by side; three do not occur
            k = np.minimum(at + step, len(heavy[0]) - 1)
            out |= (heavy[0][k] == d1) & (heavy[1][k] == d2) & (heavy[2][k] == n) & (heavy[3][k] != ids)
    return out


class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, total: int) -> int:
        """Shingles that two sets of ``total`` shingles together must share."""
        return -(-self.num * total // (self.num + self.den))

    def least(self, n: int) -> int:
        """The smallest partner of a set of n, and the smallest overlap with any partner."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1 + n // 16

    def half_shared(self, n: Column) -> Column:
        """Half of the lists that a set of n shares with a partner no smaller, rounded up."""
        return F.floor((F.floor(n / 16) + 2) / 2)

    def boundary(self, sizes: dict[int, int]) -> int:
        """The largest small size: enumerating costs a row for each subset, scanning one for each prefix shingle and the set itself."""
        subsets = lambda n: sum(comb(n, c) for c in range(self.least(n), n + 1))
        cost = lambda b: sum(k * subsets(n) for n, k in sizes.items() if n <= b) + sum(k * (self.prefix(n) + n) for n, k in sizes.items() if n >= self.least(b + 1))
        return min(range(LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


def _lists(docs: DataFrame, k: int, t: Threshold, small: int, frequent, heavy) -> DataFrame:
    """Rows (size, key, id, n, hot): subsets of ``size`` shingles of small sets; with size 0, prefix shingles of large ones (and of small ones that a large one may link with)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, very = (np.unpackbits(x).astype(bool) for x in frequent.value)
        for batch in slices(batches, "text"):
            h, text, n = shingle_sets(text_of(batch, "text"), k)
            copy = _is_copy(h, n, batch.column(0).to_numpy(), heavy.value)
            h, text, n = h[~copy[text]], text[~copy[text]], np.where(copy, 0, n)
            order = np.lexsort((h, late[(h >> np.uint64(44)).astype(np.int64)], text))
            h, text = h[order], text[order]
            first = np.cumsum(n) - n
            place = np.arange(len(h)) - first[text]
            least = -(-t.num * n // t.den)
            taken = (place < (n - least + 1 + n // 16)[text]) & (n >= t.least(small + 1))[text]
            size, key, of = [np.zeros(int(taken.sum()), np.int32)], [h[taken]], [text[taken]]
            hot = very[(h[taken] >> np.uint64(44)).astype(np.int64)]
            for i in np.flatnonzero((n > 0) & (n <= small)):
                own = [int(x) for x in mixed(h[first[i] : first[i] + n[i]])]
                for c in range(int(least[i]), int(n[i]) + 1):
                    keys = np.array([sum(x) % 2**64 for x in combinations(own, c)], np.uint64)
                    size.append(np.full(len(keys), c, np.int32)), key.append(keys), of.append(np.full(len(keys), i))
            of = np.concatenate(of)
            ids = batch.column(0).take(pa.array(of))
            hot = np.concatenate([hot, np.zeros(len(of) - len(hot), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(size)), pa.array(np.concatenate(key).view(np.int64)), ids, pa.array(n[of].astype(np.int64)), pa.array(hot)], ["size", "key", "id", "n", "hot"])

    return docs.filter(F.col("id").isNotNull()).mapInArrow(scan, "size int, key long, id long, n long, hot boolean")


def _short(lists: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of sets whose sizes fit and that share enough short lists. Each list has ``SHORT`` sets at most, so gathering it is bounded."""
    members = lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("m"))
    pairs = members.select("m", F.posexplode("m").alias("at", "x")).select("x", F.explode(F.slice("m", F.col("at") + 2, F.lit(SHORT))).alias("y"))
    pairs = pairs.filter((t.den * F.col("x.n") >= t.num * F.col("y.n")) & (F.col("x.id") != F.col("y.id")))
    counted = pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n")).count()
    return counted.filter(F.col("count") >= t.half_shared(F.col("n"))).select("a", "b")


def _salted(rows: DataFrame, least: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``least``, which has one row for each ``by``, so that many rows of one ``by`` are several keys."""
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(copies, [*by, "salt"]).drop("salt")


def _long(lists: DataFrame, t: Threshold) -> DataFrame:
    """Edges that join the sets of a long list, in order of size up to the first that is too large for the one before. Only the sizes of a list are put in order."""
    least = F.ceil(F.col("n") * t.num / t.den)
    enough = lists.groupBy("id", "n").count().filter(F.col("count") >= t.half_shared(least)).select("id")
    runs = written(lists.join(enough, "id", "left_semi").select("key", "id", "n"))
    sizes = runs.groupBy("key", "n").agg(F.min("id").alias("least"))
    by_size = Window.partitionBy("key").orderBy("n")
    begins = F.coalesce(t.den * F.lag("n").over(by_size) < t.num * F.col("n"), F.lit(True))
    hub = F.last(F.when(F.col("begins"), F.col("least")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    hubs = sizes.withColumn("begins", begins).select("key", "n", hub.alias("b"))
    return _salted(runs, hubs, ["key", "n"]).select(F.col("id").alias("a"), "b").filter(F.col("a") != F.col("b")).distinct()


def _linked(t: Threshold, k: int):
    """The task of one pair of blocks: scan the inverted lists of its sets, count overlaps, return edges that connect all that link."""

    def scan(block: pa.Table) -> pa.Table:
        texts = text_of(block.combine_chunks().to_batches()[0], "text")
        ids = block.column("id").to_numpy()
        h, text, n = shingle_sets(texts, k)
        _, token, df = np.unique(h, return_inverse=True, return_counts=True)
        shared = df[token] > 1
        token, text = token[shared], text[shared]
        order = np.argsort(token, kind="stable")
        lists, ends = text[order], np.cumsum(np.bincount(token, minlength=len(df)))
        begin = ends - np.bincount(token, minlength=len(df))
        own_end = np.cumsum(np.bincount(text, minlength=len(ids)))
        root = np.arange(len(ids))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i in range(len(ids)):
            own = token[(own_end[i - 1] if i else 0) : own_end[i]]
            if not len(own):
                continue
            length = ends[own] - begin[own]
            at = np.repeat(begin[own] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            overlap = np.bincount(lists[at], minlength=len(ids))
            for j in np.flatnonzero((overlap * (t.num + t.den) >= t.num * (n + n[i])) & (overlap > 0)):
                if j > i and (x := top(i)) != (y := top(int(j))):
                    root[max(x, y)] = min(x, y)
                    a.append(ids[i]), b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return scan


def _verified(docs: DataFrame, clusters: DataFrame, t: Threshold, k: int) -> DataFrame:
    """Edges between sets of one cluster (id, n, cluster) that link."""
    of = written(clusters.withColumn("size", F.floor(F.log("n") / log(1.005 * t.den / t.num)).cast("int")))
    count = of.groupBy("cluster", "size").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    # how many blocks each (cluster, size) has, and the next smaller and larger size; a cluster that fits in one block is one
    whole = count.groupBy("cluster").agg(F.sum("sets").alias("all_sets"), F.sum("shingles").alias("all_shingles"))
    count = count.withColumn("blocks", blocks)
    beside = [count.select("cluster", (F.col("size") + d).alias("size"), F.col("blocks").alias(c)) for d, c in ((1, "below"), (-1, "above"))]
    plan = count.join(whole, "cluster").join(beside[0], ["cluster", "size"], "left").join(beside[1], ["cluster", "size"], "left")
    plan = plan.select("cluster", "size", "blocks", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("above", F.lit(0)).alias("above"), ((F.col("all_sets") <= BLOCK_SETS) & (F.col("all_shingles") <= BLOCK_SHINGLES)).alias("one"))
    of = of.join(plan, ["cluster", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    to = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())
    pair = lambda low, high, x, y: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    size, block = F.col("size"), F.col("block")
    within = to(F.col("blocks"), lambda j: pair(size, size, F.least(block, j), F.greatest(block, j)))
    up = to(F.col("above"), lambda j: pair(size, size + 1, block, j))
    down = to(F.col("below"), lambda j: pair(size - 1, size, j, block))
    tasks = F.when(F.col("one"), F.array(pair(F.lit(-1), F.lit(-1), F.lit(0), F.lit(0)))).otherwise(F.concat(within, up, down))
    dealt = of.select("id", "cluster", tasks.alias("tasks"))
    dealt = docs.hint("shuffle_hash").join(dealt.hint("shuffle_hash"), "id").select("id", "text", "cluster", F.explode("tasks").alias("task"))
    return dealt.groupBy("cluster", "task").applyInArrow(_linked(t, k), "a long, b long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id (the smallest id reachable by links of Jaccard num / den or more)."""
    spark, t = docs.sparkSession, Threshold(num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = written(_digests(docs, k))
    sets = scan.filter(F.col("slots").isNull()).select("id", "n", "d1", "d2")
    classes = written(sets.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    sizes = {r["n"]: r["k"] for r in classes.groupBy(F.least("n", F.lit(2 * LARGEST_SMALL)).alias("n")).agg(F.count("*").alias("k")).collect()}
    small = t.boundary(sizes)

    postings = _lists(docs, k, t, small, spark.sparkContext.broadcast(_frequent(scan)), spark.sparkContext.broadcast(_heavy(classes)))
    sets_of = F.when(F.col("hot"), SHORT + 1).otherwise(F.count("*").over(Window.partitionBy("size", "key", F.when(F.col("hot"), F.col("id")))))
    lists = written(postings.withColumn("sets", sets_of).filter("sets > 1").drop("hot"))

    subsets = lists.filter("size > 0")
    hubs = subsets.groupBy("size", "key").agg(F.min(F.struct("n", "id")).alias("hub"))
    joined = _salted(subsets, hubs, ["size", "key"])
    of_small = joined.filter((F.col("hub.id") != F.col("id")) & ((num + den) * F.col("size") >= num * (F.col("n") + F.col("hub.n")))).select(F.col("id").alias("a"), F.col("hub.id").alias("b"))

    near = written(_short(lists.filter((F.col("size") == 0) & (F.col("sets") <= SHORT)), t).unionAll(_long(lists.filter((F.col("size") == 0) & (F.col("sets") > SHORT)), t)))
    reps = classes.select(F.col("rep").alias("id"), "n")
    clusters = components(near).withColumnRenamed("component", "cluster").join(reps, "id")
    of_large = written(_verified(docs, clusters, t, k))

    found = components(of_small.unionAll(of_large)).select(F.col("id").alias("rep"), "component")
    labelled = classes.join(found, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = sets.join(labelled, ["n", "d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
