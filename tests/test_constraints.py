"""Loads with constraints by brute force; boxes and shapes by cells against all pairs; reasons of a decode."""

import json
import random

from pyspark.sql import functions as F

from examlake.operators import glyphs, layout
from examlake.sources import constraints


def test_every_row_is_good_or_rejected_once(spark, tmp_path):
    rng = random.Random(5)
    ids = lambda n: rng.choice([None, *(f"i{k}" for k in range(n))])
    rows = [{"id": ids(30), "content_hash": ids(30), "raw_text": rng.choice(["a", "b", None]), "origin": "seed", "visibility": "shared", "source_label": "x", "extra": 1} for _ in range(200)]
    lines = [json.dumps({k: v for k, v in r.items() if v is not None}) for r in rows]
    lines[::40] = ['{"id": "i1", "raw', "no json", '{"id": "i2" "b"}', "[1", '{"id": ']
    (tmp_path / "bank").write_text("\n".join([*lines, "", "  "]), "utf-8")
    good, rejects = constraints.load(spark, "bank_problems", str(tmp_path / "bank"), "json")
    whole = [r for i, r in enumerate(rows) if i % 40 and all(r[c] is not None for c in ("id", "raw_text", "content_hash"))]
    row = lambda r: tuple((r[c] is not None, r[c] or "") for c in good.columns)
    full = [{c: r.get(c) for c in good.columns} for r in whole]
    by_id = {k: min((r for r in full if r["id"] == k), key=row) for k in {r["id"] for r in full}}
    by_hash = {h: min((r for r in by_id.values() if r["content_hash"] == h), key=row) for h in {r["content_hash"] for r in by_id.values()}}
    assert sorted(map(row, (r.asDict() for r in good.collect()))) == sorted(map(row, by_hash.values()))
    n = {(r["reason"], r["detail"]): r["n"] for r in rejects.groupBy("reason", "detail").agg(F.sum("copies").alias("n")).collect()}
    assert n[("repeated_key", "id")] == len(full) - len(by_id) and n[("repeated_key", "content_hash")] == len(by_id) - len(by_hash)
    assert n[("unreadable", "")] == 5 and sum(n.values()) + len(by_hash) == 200
    assert "no json" in {r["row"] for r in rejects.filter("reason = 'unreadable'").collect()}


def test_references_defaults_and_clashing_columns(spark):
    schema = "id string, conversation_id string, role string, content string, created_at string, _parent string, _first int"
    rows = [("a", "c1", "user", "x", "1", "p", 1), ("a", "c9", "user", "w", "1", "p", 1), ("b", "c9", "user", "x", "1", "p", 1), ("c", "c1", None, None, "1", "p", 1), ("d", "c1", "user", "x", "1", None, None), ("d", "c1", "user", "x", "1", None, None)]
    parents = spark.createDataFrame([("c1",), ("c1",), (None,)], "id string")
    good, rejects = constraints.checked(spark.createDataFrame(rows, schema), "conversation_messages", {"conversations": parents})
    assert sorted(r["id"] for r in good.collect()) == ["a", "d"]
    got = sorted((r["reason"], r["detail"], json.loads(r["row"])["id"], r["copies"]) for r in rejects.collect())
    assert got == [("missing", "role content", "c", 1), ("no_parent", "conversation_id", "a", 1), ("no_parent", "conversation_id", "b", 1), ("repeated_key", "id", "d", 1)]
    good, rejects = constraints.checked(spark.createDataFrame([("c1", None, "t", "t")], "id string, title string, created_at string, updated_at string"), "conversations")
    assert good.first()["title"] == "새 대화" and rejects.count() == 0
    for name in constraints.KEYS:
        good, rejects = constraints.checked(spark.createDataFrame([], constraints.SCHEMAS[name]), name)
        assert good.isEmpty() and rejects.isEmpty()
    notes = spark.createDataFrame([("1", "n", None, 1, "x", "t"), ("2", "n", None, 1, "x", "t"), ("3", "n", "s", 1, "x", "t"), ("4", "n", "s", 1, "x", "t")], "id string, note_id string, source_node_id string, no int, name string, created_at string")
    assert sorted(r["id"] for r in constraints.checked(notes, "note_items").good.collect()) == ["1", "2", "3"]


def _boxes(rng, n):
    far = lambda: rng.choice([rng.uniform(-50, 700), rng.choice([0.0, 96.0, 192.0, -96.0]), rng.uniform(-40_000, 40_000), float("inf"), -float("inf"), float("nan")] if rng.random() < 0.2 else [rng.uniform(0, 400)])
    return [(1, rng.randrange(2), i, *(far() for _ in range(4))) for i in range(n)]


def test_cells_give_the_pairs_of_whole_pages(spark):
    rng = random.Random(9)
    kind = "doc_id long, page int, no int, x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([*_boxes(rng, 60), (1, 0, 99, None, 0.0, 5.0, 5.0)], kind)
    shapes = spark.createDataFrame(_boxes(rng, 60), "doc_id long, page int, s long, s_x0 double, s_y0 double, s_x1 double, s_y1 double")
    points = shapes.selectExpr("doc_id", "page", "s", "s_x0 as cx", "s_y1 as cy")
    key = lambda df: sorted((r["no"], r["s"]) for r in df.collect())
    got = key(layout.held(boxes, points))
    assert got and got == key(boxes.join(points, ["doc_id", "page"]).filter("cx between x0 and x1 and cy between y0 and y1"))
    got = key(layout.touching(boxes, shapes))
    assert got and got == key(boxes.join(shapes, ["doc_id", "page"]).filter("s_x0 < x1 and s_x1 > x0 and s_y0 < y1 and s_y1 > y0"))


def test_all_reasons_in_order_and_the_empty_cases_apart(spark):
    g = [(1, "?", 7, 100.0), (1, "?", 8, 100.0), (1, "(", glyphs.OPEN, 100.0), (1, "-", glyphs.BAR, 100.0), (2, " ", None, 100.0), (3, "x", 8, 100.0), (4, "x", 9, 100.0)]
    rows = [(1, no, c, 10.0, 10.0 * i, 10.0 * i + 5, y, k) for i, (no, c, k, y) in enumerate(g)]
    x = spark.createDataFrame(rows, "doc_id long, no int, char string, size double, x0 double, x1 double, baseline double, offset int")
    m = glyphs.mapped(x, spark.createDataFrame([(8, "u", False), (9, "v", True), (glyphs.OPEN, "(", True)], "offset int, latex string, certain boolean"))
    boxes = spark.createDataFrame([(1, no, "image" if no == 1 else None) for no in (1, 2, 3, 4, 5)], "doc_id long, no int, graphics_reason string")
    got = {r["no"]: (r["reasons"], r["latex"], r["ok"]) for r in glyphs.decoded(m.join(glyphs.body_sizes(m), glyphs.REGION, "left"), boxes).collect()}
    assert got[1][0] == ["uncertain", "unknown", "structure", "image", "pairs"] and not got[1][2]
    assert got[2] == (["no_body"], None, False) and got[5] == (["no_glyphs"], None, False)
    assert got[3] == (["uncertain"], "u", False) and got[4] == ([], "v", True)
