"""Operators on small tables of our own."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from examlake.functions import markdown as M
from examlake.functions import text as T
from examlake.operators import chain, corpus, glyphs, layout, merge, planning, tree, usage
from examlake.sources import tables



def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, no, delimiter", [("1. a", 1, "."), (" 22. a", 22, "."), ("137) a", 137, ")"), ("2026. a", None, None), ("유 제 1 − 12 a", 1012, None), ("기본 문제 3-4 b", 3004, None), ("a 1.", None, None)])
def test_anchor(spark, text, no, delimiter):
    got = one(spark, T.anchor(F.col("t")), t=text)
    assert (got and (got["no"], got["delimiter"])) == (no and (no, delimiter))


def test_hash_ignores_numbers_and_space(spark):
    h = lambda t: one(spark, T.content_hash(F.col("t")), t=t)
    assert h("12.\n12) a b") == h("3.\n3)ab") != h("7. 3의 ab")
    assert h("  ") is None and h(None) is None


def test_text_functions(spark):
    assert one(spark, T.cleaned(F.col("t")), t="3. ab\r c \n  d") == "a b c\nd"
    assert one(spark, T.cleaned(F.col("t")), t=" ") is None
    assert one(spark, T.usable(F.col("t")), t="1. ab​cd") is False and one(spark, T.usable(F.col("t")), t="1) abcde") is True
    assert one(spark, T.mentions(F.col("t"), F.sequence(F.lit(1), F.lit(22))), t="6번 5번 6번, 3단계 [3점] 2.7번 #9 문제 30 2번째 줄") == [6, 5, 9]
    assert one(spark, T.without_followups(F.col("t")), t="a\n---\n\nFOLLOW-UP QUESTION: x") == "a"
    assert one(spark, T.pua_ratio(F.col("t")), t="a 　") == 0.5 and one(spark, T.pua_ratio(F.col("t")), t=" ") == 0.0
    assert str(one(spark, T.instant(F.col("t")), t="2026-01-02T09:00:00")) == "2026-01-02 00:00:00" and one(spark, T.instant(F.col("t")), t="soon") is None


def test_solve_input(spark):
    row = lambda **v: one(spark, T.solve_input(*(F.col(c) for c in ("mode", "text", "tr", "src", "crop"))), **v)["reason"]
    base = {"mode": "text", "text": "1. abcdef", "tr": "ghijkl", "src": "ai", "crop": True}
    assert row(**base) == "original" and row(**base | {"src": "manual"}) == "manual" and row(**base | {"tr": "다음 그림 abc"}) == "figure"
    assert row(**base | {"text": "1."}) == "transcript" and row(**base | {"text": "1.", "tr": ""}) == "crop" and row(**base | {"text": "1.", "tr": "", "crop": False}) == "none"


def test_sections_and_plain_text(spark):
    s = lambda t: [tuple(x) for x in one(spark, M.sections(F.col("t")), t=t)]
    assert s("pre\n## 가\n1\n### x\n## 나\n\n  ## 가 \n2") == [("가", "1\n### x\n\n2"), ("나", "")]
    assert s("abc") == [("문제", "abc")] and s("  ") == []
    assert one(spark, M.plain(F.col("t")), t=r"$x^2$ $x^{pq}$ **b** \$1") == "x² x^(pq) b $1"
    for t in (r"a $\frac{1}{2}$ b", "$$ $$", "plain", r"\(a_1 \le 2\)"):
        assert "".join(x["text"] for x in one(spark, M.plain_segments(F.col("t")), t=t)) == "".join(x for x, _ in M.segments(t))


def test_increasing_chain_against_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        n = [rng.randint(1, 6) for _ in range(rng.randint(0, 8))]
        ups = [c for k in range(len(n) + 1) for c in itertools.combinations(range(len(n)), k) if all(n[a] < n[b] for a, b in itertools.pairwise(c))]
        got = chain.longest_increasing(n)
        assert len(got) == max(map(len, ups)) and tuple(got) in ups


def test_reset_chain(spark):
    rows = lambda ns: spark.createDataFrame([(1, i, x) for i, x in enumerate(ns)], "doc_id long, pos int, no int")
    kept = lambda ns: [r["pos"] for r in chain.reset_chain(rows(ns), ["doc_id"]).orderBy("pos").collect()]
    assert kept([1, 2, 3, 1, 2]) == [0, 1, 2, 3, 4] and kept([1, 2, 9, 3, 4]) == [0, 1, 2]
    assert [r["pos"] for r in chain.chains(rows([1, 2, 9, 3, 4])).orderBy("pos").collect()] == [0, 1, 3, 4]


def test_alignment(spark):
    rows = lambda xs: spark.createDataFrame([(1, 1, 0, float(x)) for x in xs], "doc_id long, page int, col int, x0 double")
    line = lambda xs: [r["align_x0"] for r in layout.alignment(rows(xs), layout.COLUMN).collect()]
    assert line([100] * 4) == [] and line([100] * 5) == [100.0] and line([30, 31.5, 84.9, 85, 85, 85.1, 85.2, 85.3, 85.4]) == [84.9] and line([200] * 20 + [120] * 5) == [120.0]


def test_usage(spark):
    tokens = lambda t: one(spark, usage.usage_tokens(F.col("t")), t=t)
    assert [tokens(t) for t in ('{"total_tokens": 7}', '{"total_tokens": "7.9"}', '{"input_tokens": 3, "output_tokens": "4", "total_tokens": true}', "{}", "[1]", "x", "", None)] == [7, 7, 7, 0, None, None, None, None]


def test_tree_with_cycle_and_orphan(spark):
    n = spark.createDataFrame([("a", "folder", None, "A", "exam"), ("b", "folder", "a", "B", "exam"), ("c", "file", "b", "C", "exam"), ("x", "folder", "y", "X", "exam"), ("y", "folder", "x", "Y", "exam"), ("o", "file", "gone", "O", "exam")], "node_id string, type string, parent_id string, name string, section string")
    assert {r["node_id"]: r["depth"] for r in tree.with_depth(n).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 0, "o": 0}
    assert sorted(r["node_id"] for r in tree.closure(n, n.filter("node_id in ('b', 'x')")).collect()) == ["b", "c", "x", "y"]
    assert {r["node_id"]: r["path"] for r in tree.paths(n).collect()}["c"] == ["A", "B", "C"]
    below = n.unionAll(spark.createDataFrame([("z", "file", "x", "Z", "exam"), ("zz", "file", "z", "ZZ", "exam")], n.schema))
    long = spark.createDataFrame([(str(i), "folder", str(i - 1) if i else None, "n", "exam") for i in range(50)], n.schema)
    assert {r["node_id"]: r["depth"] for r in tree.with_depth(below).collect()}["zz"] == 2
    assert {int(r["node_id"]): r["depth"] for r in tree.with_depth(long).collect()} == {i: i for i in range(50)}


def test_tree_order(spark):
    names = ["a1234567890123", "a123456789012", "a2", "a10", "A002", "b", "나", "가12", "가2"]
    rows = [(str(i), "file", x) for i, x in enumerate(names)] + [("f", "folder", "z")]
    got = tree.tree_order(spark.createDataFrame(rows, "node_id string, type string, name string").withColumn("parent_id", F.lit("p")), ["parent_id"]).orderBy("place").collect()
    assert [r["name"] for r in got] == ["z", "가2", "가12", "나", "A002", "a2", "a10", "a123456789012", "a1234567890123", "b"]


def test_labels_and_dedup(spark):
    p = spark.createDataFrame([(1, 1, 0, 1, 100.0), (1, 1, 0, 2, 200.0), (1, 1, 1, 3, 50.0)], "doc_id long, page int, col int, no int, top double")
    b = spark.createDataFrame([(1, 1, 0, 10.0, "08.01"), (1, 1, 1, 60.0, "08.02")], "doc_id long, page int, col int, y1 double, type_id string")
    assert {r["no"]: (r["type_id"], r["reason"]) for r in corpus.labels_matched(b, p).collect()} == {1: ("08.01", None), 2: ("08.01", None), 3: (None, "label_below")}
    rows = spark.createDataFrame([(1, "1. a"), (2, "2) a"), (3, " ")], "seq long, raw_text string")
    good, bad = corpus.hashed(rows)
    assert [r["is_stored"] for r in corpus.deduplicated(good, ["seq"]).orderBy("seq").collect()] == [True, False] and bad.count() == 1
    none = good.withColumn("seq", F.lit(None).cast("long"))
    assert [r["is_stored"] for r in corpus.deduplicated(none, ["seq"]).collect()] == [True, True]


def test_label_blocks_and_rows(spark):
    at = lambda t, y: (1, 1, 0, t, 77.2, y, y + 10.0)
    lines = spark.createDataFrame([at("12 잡", 5.0), at("08 가", 100.0), at("06 나", 120.0), at("01 다", 140.0), at("01 라", 160.0), at("08 마", 400.0), at("08 마", 700.0)], "doc_id long, page int, col int, text string, x0 double, y0 double, y1 double")
    assert [r["type_id"] for r in layout.label_blocks(lines).collect()] == ["08.06.01.01"]
    words = spark.createDataFrame([(1, 1, 85.0, 100.0, 300.0, 110.0, 595.0), (1, 1, 308.0, 100.5, 509.9, 110.5, 595.0), (1, 1, 85.0, 140.0, 200.0, 150.0, 595.0), (1, 1, 353.0, 140.0, 500.0, 150.0, 595.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, w double")
    assert [(r["full"], r["total"]) for r in layout.full_rows(words).collect()] == [(1, 2)]


def test_jobs_and_merge(spark):
    jobs = spark.createDataFrame([(1, 1, "solve", "running", [1, 2], None, 1), (2, 1, "solve", "done", [3], None, 2)], "job_id long, node_id long, kind string, status string, targets array<int>, modes array<string>, created_at long")
    req = spark.createDataFrame([(1, 1, "solve", [2], None), (2, 1, "solve", [3], None), (3, 1, "solve", None, None)], "request_id long, node_id long, kind string, targets array<int>, modes array<string>")
    assert {r["request_id"]: r["job_id"] for r in planning.overlapping_job(req, jobs).collect()} == {1: 1, 2: None, 3: 1}
    old = spark.createDataFrame([(1, 1, "a", 1)], "node_id long, no int, text string, seq long")
    new = spark.createDataFrame([(1, 1, "b", 0), (1, 1, "c", 2)], "node_id long, no int, text string, seq long")
    assert [r["text"] for r in merge.upserted(old, new, ["node_id", "no"]).collect()] == ["c"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"unit": 1, "types": [{"id": "08.01.01.01", "statement": "s", "includes": "i", "excludes": "e"}]}')
    assert [(r["id"], r["file"]) for r in tables.type_definitions(spark, str(tmp_path)).collect()] == [("08.01.01.01", "a.json")]
    assert tables.type_definitions(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        tables.write(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
