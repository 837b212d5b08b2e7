"""Trees by interval labels against brute force, with cycles, orphans and long chains, in one piece and in many."""

import random

import pytest
from pyspark.sql import functions as F

from examlake.operators import tree


def brute(rows):
    """Ancestors (itself included) and depth of every node."""
    up = dict(rows)
    up = {n: (p if p in up and p != n else None) for n, p in rows}
    above, depth = {}, {}
    for n in up:
        way, at = [n], up[n]
        while at is not None and at not in way:
            way.append(at)
            at = up[at]
        above[n] = set(way)
    loop = {n for n in up if up[n] is not None and n in above[up[n]]}
    for n in up:
        at, depth[n] = n, 0
        while at not in loop and up[at] is not None:
            at, depth[n] = up[at], depth[n] + 1
    return above, depth


def nodes(seed, n=45):
    rng = random.Random(seed)
    far = lambda i: f"n{rng.randrange(n)}" if seed % 2 else f"n{max(i - 1, 0)}"
    return [(f"n{i}", rng.choice([None, "gone", f"n{rng.randrange(max(i, 1))}", far(i), far(i)]), rng.choice(["folder", "file"]), f"name {i}") for i in range(n)]


@pytest.mark.parametrize("seed, pieces", [(1, False), (3, True), (4, True)])
def test_labels(spark, monkeypatch, seed, pieces):
    if pieces:  # ranked by rulers, running sums over ranges
        monkeypatch.setattr(tree, "AT_ONCE", 20)
        monkeypatch.setattr(tree, "PART", 15)
    rows = nodes(seed)
    df = spark.createDataFrame(rows, "node_id string, parent_id string, type string, name string")
    above, depth = brute([r[:2] for r in rows])
    labelled = tree.labels(df)
    of = {r["node_id"]: r for r in labelled.collect()}
    assert {n: r["depth"] for n, r in of.items()} == depth and len({(r["root_id"], r["pre"]) for r in of.values()}) == len(rows)
    for a in of:
        for b in of:
            assert (of[a]["root_id"] == of[b]["root_id"] and of[b]["low"] <= of[a]["pre"] < of[b]["high"]) == (b in above[a]), (a, b)
    picked = {"n3", "n7", "n40"}
    assert sorted(r[0] for r in tree.closure(df, df.filter(F.col("node_id").isin(*picked)), labelled).collect()) == sorted(n for n in above if above[n] & picked)
    kind = {r[0]: r[2] for r in rows}
    for r in tree.descendant_counts(df, labelled).collect():
        below = [kind[n] for n in above if r["node_id"] in above[n] and n != r["node_id"]]
        assert (r["folders"], r["files"]) == (below.count("folder"), below.count("file"))
    hits = {r[0] for r in rows if "me 1" in r[3]}
    want = {a for n in hits for a in above[n]} | {n for n in above if any(kind[h] == "folder" for h in above[n] & hits)}
    assert sorted(r[0] for r in tree.found(df, "ME 1", labelled).collect()) == sorted(want)


def test_empty_and_single_trees(spark):
    df = spark.createDataFrame([("a", None, "file", "x")], "node_id string, parent_id string, type string, name string")
    assert [tuple(r) for r in tree.labels(df).collect()] == [("a", "a", 0, 0, 0, 1)]
    none = df.filter("false")
    assert tree.labels(none).count() == tree.closure(none, none).count() == tree.descendant_counts(none).count() == tree.paths(none).count() == 0


def test_long_chain_and_cycle(spark, monkeypatch):
    monkeypatch.setattr(tree, "AT_ONCE", 500)
    n = 3000
    chain = spark.range(n).select(F.format_string("%05d", "id").alias("node_id"), F.when(F.col("id") > 0, F.format_string("%05d", F.col("id") - 1)).alias("parent_id"))
    assert tuple(tree.labels(chain).agg(F.min(F.col("pre") == F.col("node_id").cast("int")), F.sum("depth"), F.min("high")).first()) == (True, n * (n - 1) // 2, n)
    ring = spark.range(40).select(F.format_string("%05d", "id").alias("node_id"), F.format_string("%05d", (F.col("id") + 1) % 40).alias("parent_id"))
    out = tree.labels(ring.unionAll(spark.createDataFrame([("x", "00007"), ("y", "x")], ring.schema))).collect()
    assert {(r["low"], r["high"]) for r in out if r["node_id"] < "x"} == {(0, 42)} and {r["node_id"]: r["depth"] for r in out if r["depth"]} == {"x": 1, "y": 2}


def test_move_targets(spark):
    rows = [("a", None, "folder", "나", "exam"), ("b", None, "folder", "Beta 10", "exam"), ("c", None, "folder", "beta 9", None), ("d", "a", "folder", "x", "exam"), ("e", "d", "folder", "y", "exam"), ("f", "d", "file", "f", "exam"), ("n", "a", "folder", "note", "note"), ("o", "n", "folder", "orphan", "exam"), ("z", None, "file", "z", "exam")]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, type string, name string, section string")
    go = lambda *ids: [(r["node_id"], r["depth"], r["reason"]) for r in tree.move_targets(df, df.filter(F.col("node_id").isin(*ids)).select("node_id"), "exam").orderBy("place").collect()]
    assert go("d") == [(None, 0, None), ("a", 0, "current"), ("d", 1, "self"), ("e", 2, "descendant"), ("c", 0, None), ("b", 0, None), ("o", 0, None)]
    assert [x[2] for x in go("z", "a")] == ["current", "self", "descendant", "descendant", None, None, "descendant"]  # below a by way of a note folder, too
    assert [x[2] for x in go("f", "z")] == [None] * 7  # of several parents none is current
    assert [x[2] for x in go("nobody")] == [None] * 7


def test_korean_natural_order(spark, monkeypatch):
    names = ["_", "10", "가 2", "가 ２", "가 10", "각", "나", "漢", "a 00009", "A 9", "á 9", "a 10", "a " + "9" * 30, "a 1" + "0" * 30, "b"]
    for part in (1 << 18, 4):
        monkeypatch.setattr(tree, "PART", part)
        df = spark.createDataFrame([(f"{i:02}", "file", n) for i, n in enumerate(reversed(names))] + [("f", "folder", "zz")], "node_id string, type string, name string").withColumn("parent_id", F.lit(None).cast("string"))
        got = [r["name"] for r in tree.tree_order(df, ["parent_id"]).orderBy("place").collect()]
        assert got == ["zz", "_", "10", "가 2", "가 ２", "가 10", "각", "나", "漢", "A 9", "a 00009", "á 9", "a 10", "a " + "9" * 30, "a 1" + "0" * 30, "b"]
