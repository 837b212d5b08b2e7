"""Centroid clustering, best-fit packing and importance resampling against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from examlake.llm import centroids, packing, queries, resampling

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path(queries.VOCABULARY)
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (4, "one two"), (5, "ONE two" + " one" * 40), (6, "ß é 日本 x" * 30), (7, "w" * 100_000 + " " + "x y " * 20_000), (None, "null id " * 30), (8, "a<|endoftext|>b <|STARTOFTEXT|> it's 12   x́")]


@pytest.fixture(scope="module")
def odd(spark):
    names = "id v cluster distance inertia n length piece start task number Offset sequence_id weight score rank n_words n_features part before bucket sha"
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(names.split())})


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-centroids.LARGEST, min(centroids.LARGEST, x)) for x in v]) for i, v in kept]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "g", r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def vectors(seed, n, dims, spread):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1.0, 0.0, 0.5]) + rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims, spread, k", [(64, 0.1, 40), (3, 0.0, 40), (4, 2.0, 7), (2, 0.3, 1)])
def test_clusters(spark, dims, spread, k):
    """Also with more ties than distinct vectors, and with one centroid."""
    rows = vectors(dims, 300, dims, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, c = centroids.clustered(df, k=k, dims=dims)
    want, w = brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()], k, 5, dims)
    assert sorted(map(tuple, got.collect())) == sorted(want) and c.tolist() == w
    out = centroids.with_inertia(got, c).collect()
    assert {r["inertia"] for r in out} == {sum(x[2] for x in want)}
    for r in out:
        assert r["cluster_inertia"] == sum(x[2] for x in want if x[1] == r["cluster"]) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, w[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (None, [1.0, -1.0]), (8, [1e300, -1e300]), (9, [0.3, -0.001]), (10, [1e-320, -1e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "cluster": F.lit("x"), "sha": F.lit(2), "V": F.lit(3)})
    for k in (2, 40):
        got, c = centroids.clustered(df, k=k, dims=2)
        want, w = brute_clusters(rows, k, 5, 2)
        key = lambda r: (r[0] or -1, *r[1:])
        assert sorted(map(key, got.collect())) == sorted(map(key, want)) and c.tolist() == w
    empty, c = centroids.clustered(df.filter("false"))
    assert empty.columns == ["vec_id", "cluster", "distance"] and centroids.with_inertia(empty, c).count() == 0 and len(c) == 0


def test_few_hashes_seed(spark):
    """One id on most rows does not keep others from seeding, and the bound on hashes is widened when too few lie below it."""
    rows = [(0, [0.0, 0.0])] * 3000 + [(i, [float(i), 1.0]) for i in range(1, 6)]
    found = centroids.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 2)
    order = sorted(range(6), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    want = [v for i in order for v in ([[0, 0]] * 3000 if i == 0 else [[256 * i, 256]])]
    assert centroids.seeds(found, 4).tolist() == want[:4]


def brute_pieces(rows, limit):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    out = []
    for i, text in rows:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            out.append((-1 if i is None else i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)))
    return sorted(out)


def gapless(rows, limit):
    """The sequences of rows (sequence, offset, length), after a look at their offsets."""
    of = {}
    for s, o, n in rows:
        of.setdefault(s, []).append((o, n))
    for parts in of.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(of)


@pytest.mark.parametrize("limit", [2048, 16])
def test_packing(spark, odd, limit, monkeypatch):
    if limit == 16:
        monkeypatch.setattr(packing, "LONGEST", 5)
    packing.token_ids.cache_clear()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (odd.repartition(3), docs):
        got = packing.packed_documents(df, VOCABULARY, limit, with_ids=True).collect()
        want = brute_pieces([(r["doc_id"], r["text"]) for r in df.collect()], limit)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
        n = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], limit)
        assert n <= math.ceil(sum(r["length"] for r in got) / limit * 1.02) + 1
    assert packing.packed_documents(odd.filter("false"), VOCABULARY).count() == 0


def brute_fewest(lengths, limit):
    """The fewest sequences, by search."""
    best = [len(lengths)]

    def go(i, free):
        if len(free) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(free))
            return
        for j in {f: j for j, f in enumerate(free) if f >= lengths[i]}.values():
            go(i + 1, [f - lengths[i] if k == j else f for k, f in enumerate(free)])
        go(i + 1, [*free, limit - lengths[i]])

    go(0, [])
    return best[0]


def test_plan():
    rng = random.Random(4)
    for trial in range(300):
        limit = rng.choice([7, 12, 30])
        low = limit // 3 + 1 if trial % 3 == 0 else 1
        lengths = sorted((rng.randint(low, limit) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.plan(counts, limit)
        rows = []
        for n, c in counts.items():
            s, o = plan.places(np.full(c, n), np.arange(c))
            rows += zip(s.tolist(), o.tolist(), [n] * c)
        assert gapless(rows, limit) == plan.sequences == len({s for s, _, _ in rows})
        fewest = brute_fewest(lengths, limit)
        # large ones alone are matched as well as can be
        assert plan.sequences == fewest if low > 1 else plan.sequences <= fewest + 1


def test_plan_of_many():
    """The work depends on the lengths, not on how many pieces there are."""
    rng = random.Random(5)
    counts = {n: rng.randrange(10**9) for n in range(1, 2049)}
    plan = packing.plan(counts)
    assert len(plan.length) < 100_000 and plan.sequences >= sum(n * c for n, c in counts.items()) / 2048
    for n, c in counts.items():
        s, o = plan.places(np.full(2, n), np.array([0, max(c - 1, 0)]))
        assert (s < plan.sequences).all() and (o + n <= 2048).all() and (o >= 0).all()


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    ids = packing.TokenIds(VOCABULARY)
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice(["Don't", "a.b", "été", "x" * 99, "12,5", "they'll!!", "<|endoftext|>"]) + str(rng.randrange(50)) for _ in range(rng.randrange(30))) for _ in range(3)]
        assert [np.frombuffer(b, "<u4").tolist() for b in ids.of([t.encode() for t in texts])] == [known.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(ids.words) <= 20 and len(ids.parts) <= 20 and all(len(w) <= packing.LONGEST for w in ids.words)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [b" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)


def brute_resampled(docs, target, percent, least, most, buckets):
    count = lambda texts: np.bincount([zlib.crc32(g) % buckets for t in texts for g in features(t, most)[0]], minlength=buckets).tolist()
    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + float(buckets)) / ((a + 1.0) * (sum(t) + float(buckets))))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        g, n = features(text, most)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(g), weight, score, None, n])
    able = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(-1 if x is None else x for x in r[:5]) for r in rows))


@pytest.mark.parametrize("most, buckets, percent, least", [(1, 10_000, 10, 20), (3, 97, 50, 1), (2, 10_000, 100, 0), (1, 5, 0, 0)])
def test_resampling(spark, odd, monkeypatch, most, buckets, percent, least):
    monkeypatch.setattr(resampling, "PART", 7)
    monkeypatch.setattr(resampling, "TOGETHER", 5000)
    target = spark.createDataFrame([("one two and ONE",), (None,), ("x y",)], "text string")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, to in ((odd, target), (spark.read.parquet(f"{SF}/documents.parquet"), bench), (odd, target.filter("false"))):
        got = resampling.resampled(df, to, percent, least, most, buckets)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        want = brute_resampled([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in to.collect()], percent, least, most, buckets)
        assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == want
    assert resampling.resampled(odd.filter("false"), target).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 5 if i % 2 else 7) for i in range(100)], "id long, score long")
    got = {r["id"]: r["rank"] for r in resampling.drawn(rows, 70, F.col("id") < 90).collect()}
    order = sorted(range(90), key=lambda i: (5 if i % 2 else 7) * -1000 + i)
    assert got == {i: (order.index(i) + 1 if i < 90 and order.index(i) < 63 else None) for i in range(100)}


def test_hash_and_interning():
    rng = random.Random(2)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 4, 7, 8, 9, 15, 16, 23, 31, 32, 33, 100]))) for _ in range(500)] + [b"same"] * 50
    data = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    length = np.array([len(s) for s in spans])
    start = np.cumsum(length) - length
    key = resampling.xxh64(data, start, length)
    assert key.tolist() == [xxhash.xxh64_intdigest(s) for s in spans]
    for k in (key, np.zeros_like(key), key & np.uint64(3)):  # also when all hashes are the same
        met = resampling.Interned(data, start, length, k, 10_000)
        assert [int(met.bucket[s]) for s in met.slot] == [zlib.crc32(s) % 10_000 for s in spans]
        assert [int(met.count[s]) for s in met.slot] == [spans.count(s) for s in spans]
    assert not list(resampling.ngrams(pa.array(["", " "]), 2))
