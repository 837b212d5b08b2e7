"""Centroid clustering in exact integers, each vector's nearest centroid found by Orchard's search.

Components become floor(scale * x). For every centroid the other centroids are listed by their distance from it. A vector
begins at some centroid and goes along that one's list; a closer centroid (or one as close with a smaller number) becomes
the current one, and its list is taken from the start. Centroids whose distance is known are marked and not computed again.
The list ends strictly beyond twice the current distance: what comes there is farther off, by the triangle inequality, and
what is as near as the current one is not cut off. A batch of vectors takes these steps side by side in NumPy.

The vectors are written once as integers. In a round each task adds up its own vectors by cluster, so a round moves k sums a
task and the driver holds k centroids (k times the number of components, whatever the input). Vectors are never gathered.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; those without an
id are clustered but never seed, unless there are too few others (their hash counts as the last); repeated rows are vectors of their own, and of
rows of one hash the smaller vector seeds first; fewer vectors than k give as many centroids; integers beyond 2**27 in size
count as that bound, so that distances fit a long (a sum of distances that does not is null); an empty table gives an empty one.
Columns of the input other than id and vector do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import written

#: Largest size of an integer component, and the one up to which 32-bit differences and their squares can be used (times 64 components).
LARGEST, SMALL = 1 << 27, 1 << 11
#: Vectors that take their steps together.
BATCH = 8192


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int = 64, scale: int = 256) -> DataFrame:
    """(id, v array<long>): the usable vectors in integers."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale))).cast("long")
    return df.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") == dims) & finite).select("id", F.transform("v", whole).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors whose id has the smallest hash, in that order. Only hashes below a bound, about k of them, are put in order."""
    hashed = vectors.withColumn("sha", F.coalesce(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), F.lit("g")))
    n = hashed.count()
    share = (k + 8 * k**0.5 + 64) / max(n, 1)
    low = hashed
    while share < 1:
        low = hashed.filter(F.col("sha") < f"{int(share * 2**60):015x}")
        if low.count() >= k:
            break
        low, share = hashed, share * 16
    rows = low.orderBy("sha", "v").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


@dataclass
class Orchard:
    """Centroids (k x dims), and for each one the numbers of the others by distance and those squared distances."""

    centroids: np.ndarray
    near: np.ndarray
    gap: np.ndarray
    axis: int

    @classmethod
    def of(cls, c: np.ndarray) -> Orchard:
        k = len(c)
        d = np.stack([_squared(c, row[None, :]) for row in c])
        d[np.arange(k), np.arange(k)] = -1  # each stands first in its own list, and is left out
        near = np.argsort(d, axis=1, kind="stable")[:, 1:]
        return cls(c, near, np.take_along_axis(d, near, 1), int(np.argmax(c.max(0) - c.min(0))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; the smaller number at ties."""
        c, k, n = self.centroids, len(self.centroids), len(x)
        if max(abs(int(x.max())), abs(int(x.min())), int(np.abs(c).max())) <= SMALL and x.shape[1] <= 64:
            x, c = x.astype(np.int32), c.astype(np.int32)
        # the search may begin anywhere: here, at the centroid that is nearest on the axis where they differ most
        order = np.argsort(self.centroids[:, self.axis], kind="stable")
        at = order[np.minimum(np.searchsorted(self.centroids[order, self.axis], x[:, self.axis]), k - 1)]
        best = _squared(x, c[at])
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), at] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n if k > 1 else 0)
        while live.size:
            a, j = at[live], place[live]
            within = self.gap[a, j] <= 4 * best[live]  # squares: the distance is at most twice the current one
            live, p = live[within], self.near[a[within], j[within]]
            place[live] += 1
            new = ~seen[live, p]
            rows, p = live[new], p[new]
            seen[rows, p] = True
            d = _squared(x[rows], c[p])
            closer = (d < best[rows]) | ((d == best[rows]) & (p < at[rows]))
            rows = rows[closer]
            at[rows], best[rows], place[rows] = p[closer], d[closer], 0
            live = live[place[live] < k - 1]
        return at, best


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid with vectors becomes the floor of their mean."""
    k, dims = centroids.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Orchard.of(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _matrices(batches, dims):
            own, _ = search.nearest(x)
            order = np.argsort(own, kind="stable")
            some, first = np.unique(own[order], return_index=True)
            sums[some] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(own, minlength=k)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(scan, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        out[r["cluster"], r["place"]] = int(r["part"]) // int(r["n"])
    return out


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """Rows (``id_col``, cluster, distance) of all usable vectors, and the final centroids. ``distance`` is squared."""
    found = written(integer_vectors(vectors, id_col, vector_col, dims, scale))
    centroids = seeds(found, k, salt)
    schema = f"id {found.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return found.selectExpr("id", "0 as cluster", "0L as distance").to(found.sparkSession.createDataFrame([], schema).schema).withColumnRenamed("id", id_col), centroids
    for _ in range(rounds):
        before, centroids = centroids, _moved(found, centroids)
        if (before == centroids).all():
            break  # further rounds would change nothing

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard.of(centroids)
        for ids, x in _matrices(batches, dims):
            own, distance = search.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return written(found.mapInArrow(scan, schema)).withColumnRenamed("id", id_col), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` of ``clustered`` with cluster_inertia, inertia and centroid_sha256. One small row a cluster goes over the driver."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(total("distance").alias("s")).collect()}
    fits = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, fits(s), fits(sum(sums.values())), sha[c]) for c, s in sorted(sums.items())]
    clusters = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(clusters), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")
