"""Chains, rows, labels and glyph structures against brute force and by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from examlake.operators import chain, glyphs, layout
from examlake.operators.glyphs import BAR, CLOSE, HEAD, HOOK, OPEN, Atom


def char(x, base, text, offset=1, size=10.0, width=5.0):
    return Atom(x, x + width, base, size, offset, text)


def bar(x0, x1, base, size=20.0):
    return Atom(x0, x1, base, size, BAR, "-")


STRUCTURES = [
    ("fraction", [char(12, 92, "1"), bar(10, 19, 100), char(12, 104, "2")], r"\\frac{1}{2}", None),
    ("numerator of two and a script", [char(11, 92, "a"), char(16, 88, "2", size=6), bar(10, 23, 100), char(13, 104, "b")], r"\\frac{a^{2}}{b}", None),
    ("fraction among others", [char(0, 96.7, "y"), char(5, 96.7, "="), char(12, 92, "1"), bar(10, 19, 100), char(12, 104, "x"), char(22, 96.7, "+"), char(28, 96.7, "c")], r"y=\\frac{1}{x}+c", None),
    ("nested fractions", [char(14, 80, "1"), bar(12, 21, 86), char(14, 90, "2"), bar(10, 23, 99), char(14, 104, "3")], r"\\frac{\\frac{1}{2}}{3}", None),
    ("root", [char(2, 104, "", HOOK, width=8), bar(10, 22, 98), char(12, 104, "x")], r"\\sqrt{x}", None),
    ("root of a power", [char(2, 104, "", HOOK, width=8), bar(10, 24, 98), char(12, 104, "x"), char(17, 99.5, "2", size=6)], r"\\sqrt{x^{2}}", None),
    ("vector", [bar(10, 22, 98), char(18, 98, "", HEAD), char(11, 104, "A"), char(16, 104, "B")], r"\\vec{AB}", None),
    ("line above", [bar(10, 21, 98), char(11, 104, "A"), char(16, 104, "G")], r"\\overline{AG}", None),
    ("line above, a digit of another line beside the middle", [char(17, 90, "2"), bar(10, 21, 98), char(11, 104, "A"), char(15, 104, "G")], "2\n" + r"\\overline{AG}", None),
    ("far numerator is another line", [char(13, 78, "7"), bar(10, 21, 98), char(11, 104, "A"), char(16, 104, "G")], "7\n" + r"\\overline{AG}", None),
    ("bar alone", [char(0, 100, "a"), bar(10, 21, 98)], None, "structure"),
    ("hook alone", [char(0, 100, "a"), char(8, 100, "", HOOK)], r"a\\sqrt{}", "structure"),
    ("hook far from its bar", [char(0, 104, "", HOOK, width=4), bar(12, 24, 98), char(14, 104, "x")], None, "structure"),
    ("subscripts", [char(0, 100, "a"), char(5, 103, "1", size=6), char(9, 100, "+"), char(14, 97, "2", size=6)], "a_{1}+^{2}", None),
    ("brackets", [char(0, 100, "(", OPEN), char(5, 100, "x"), char(10, 100, ")", CLOSE)], r"\\left(x\\right)", None),
    ("a bracket alone", [char(0, 100, "(", OPEN), char(5, 100, "x")], "(x", None),
    ("two lines", [char(0, 100, "a"), char(0, 114, "b"), char(5, 95.5, "2", size=6)], "a^{2}\nb", None),
    ("text of other fonts", [char(0, 100, "가", None), char(5, 100, "x")], "가x", None),
    ("nothing", [char(0, 100, " ", None)], "", "empty"),
]


@pytest.mark.parametrize(("atoms", "latex", "why"), [s[1:] for s in STRUCTURES], ids=[s[0] for s in STRUCTURES])
def test_structures(atoms, latex, why):
    for order in itertools.islice(itertools.permutations(atoms), 40):
        got = glyphs.decoded_region(list(order), 10.0)
        assert got[1] == why and (latex is None or got[0] == latex.replace("\\\\", "\\"))


def test_decoded_regions_as_a_table(spark):
    of = {1: STRUCTURES[0][1], 2: STRUCTURES[5][1], 3: [char(0, 100, "?", 7)], 4: STRUCTURES[-4][1], 5: STRUCTURES[10][1]}
    rows = [(1, no, a.latex or " ", float(a.size), float(a.x0), float(a.x1), float(a.base), a.offset) for no, atoms in of.items() for a in atoms]
    g = spark.createDataFrame(rows, "doc_id long, no int, char string, size double, x0 double, x1 double, baseline double, offset int")
    table = spark.createDataFrame([(1, "x", True), (OPEN, "(", True)], "offset int, latex string, certain boolean")
    m = glyphs.mapped(g, table)
    out = glyphs.decoded(m.join(glyphs.body_sizes(m), glyphs.REGION, "left"), spark.createDataFrame([(1, 2, "image")], "doc_id long, no int, graphics_reason string"))
    got = {r["no"]: (r["latex"], r["reason"], r["ok"]) for r in out.collect()}
    assert got[1] == (r"\frac{x}{x}", None, True) and got[2] == (r"\sqrt{x^{x}}", "image", False)
    assert got[3][1:] == ("unknown", False) and got[4][1:] == ("pairs", False) and got[5][1:] == ("structure", False)
    routes = glyphs.routed(out.withColumn("has_crop", F.col("no") != 3)).collect()
    assert {r["no"]: r["route"] for r in routes} == {1: "pua", 2: "ai", 3: "crop_missing", 4: "ai", 5: "ai"}


def test_body_size_ignores_structure(spark):
    g = spark.createDataFrame([(1, 1, "a", 8.9, 1), (1, 1, "b", 8.9, 2), *[(1, 1, "-", 44.0, k) for k in (BAR, HEAD, HOOK)], (1, 1, " ", 30.0, None)], "doc_id long, no int, char string, size double, offset int")
    assert glyphs.body_sizes(g).first()["body"] == 8.9


def brute_rows(boxes, width):
    boxes, rows = sorted(boxes, key=lambda b: (b[1], b[0], b[2])), []
    for b in boxes:
        y = (b[1] + b[3]) / 2
        if rows and y - rows[-1][0] <= 2.0:
            rows[-1][1].append(b)
        else:
            rows.append((y, [b]))
    full = 0
    for _, row in rows:
        spans = [[b[0], b[2]] for b in row]
        while pair := next(((i, j) for i, j in itertools.combinations(range(len(spans)), 2) if max(spans[i][0], spans[j][0]) - min(spans[i][1], spans[j][1]) <= 12.0), None):
            i, j = pair
            spans[i] = [min(spans[i][0], spans[j][0]), max(spans[i][1], spans[j][1])]
            del spans[j]
        full += any(a <= 0.15 * width and b > 0.6 * width for a, b in spans)
    return full, len(rows)


def test_full_rows_against_brute_force(spark):
    rng = random.Random(1)
    pages = {p: [(x := rng.randrange(0, 500), float(y := rng.randrange(0, 60)), x + rng.randrange(5, 300), y + 10.0) for _ in range(rng.randrange(1, 25))] for p in range(30)}
    rows = [(1, p, float(a), b, float(c), d, 600.0) for p, boxes in pages.items() for a, b, c, d in boxes]
    got = layout.full_rows(spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, w double")).collect()
    assert {r["page"]: (r["full"], r["total"]) for r in got} == {p: brute_rows(b, 600.0) for p, b in pages.items()}


def test_numbers_of_glyphs_side_by_side(spark):
    g = [(1, "00", 40.0, 100.0, 52.0), (1, "1", 53.0, 100.04, 58.0), (1, "014", 300.0, 100.0, 318.0), (2, "1234", 10.0, 5.0, 30.0), (2, "유형 7.", 10.0, 50.0, 40.0), (2, "x", 10.0, 80.0, 15.0), (2, "9", 13.0, 80.0, 18.0)]
    rows = [(1, *x) for x in g]
    got = layout.merged_numbers(spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, y0 double, x1 double")).collect()
    assert sorted((r["page"], r["no"], r["x0"], r["y0"], r["x1"]) for r in got) == [(1, 1, 40.0, 100.0, 58.0), (1, 14, 300.0, 100.0, 318.0), (2, 7, 10.0, 50.0, 40.0), (2, 9, 10.0, 80.0, 18.0)]


def test_workbook_numbers_stand_in_for_missing_anchors(spark):
    span = lambda doc, page, text, x0, y0, font="DINCondensed-Bold", size=20.0: (doc, page, font, size, text, float(x0), float(y0), float(x0 + 10), float(y0 + 20))
    rows = [span(d, 0, t, x, y) for d in (1, 2, 3) for t, x, y in (("001", 40, 100), ("003", 330, 90), ("002", 42, 300))]
    rows += [span(1, 1, "9", 40, 5), span(1, 1, "4", 40, 100), span(1, 1, "2", 40, 200, size=9.0), span(1, 1, "5", 40, 300, "Serif"), span(1, 1, "2", 40, 400)]
    spans = spark.createDataFrame(rows, "doc_id long, page int, font string, size double, text string, x0 double, y0 double, x1 double, y1 double")
    bodies = spark.createDataFrame([(d, p, 600.0, 20.0, 780.0) for d in (1, 2, 3) for p in (0, 1)], "doc_id long, page int, w double, y0 double, y1 double")
    numbers = layout.workbook_anchors(spans, bodies)
    assert [(r["page"], r["no"]) for r in numbers.filter("doc_id = 1").orderBy("pos").collect()] == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 2)]
    kept = numbers.join(chain.chains(numbers.select("doc_id", "pos", "no"), chain.longest_increasing).select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")
    plain = spark.createDataFrame([(2, 7, 0, 0, 1.0, 2.0), (2, 8, 0, 0, 1.0, 3.0)], "doc_id long, no int, page int, col int, x0 double, y0 double")
    out = layout.with_fallback(plain, kept, spark.createDataFrame([(3,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], r["no"], r["is_workbook"]) for r in out) == [(1, 1, True), (1, 2, True), (1, 3, True), (1, 4, True), (2, 7, False), (2, 8, False)]


def brute_labels(lines):
    lines, out, at = sorted(lines, key=lambda x: (x[1], x[0])), [], 0
    while at + 4 <= len(lines):
        four = lines[at : at + 4]
        if four[0][2].startswith("08 ") and all(b[1] - a[1] <= 40 for a, b in itertools.pairwise(four)):
            out.append((".".join(x[2][:2] for x in four), four[0][1]))
            at += 4
        else:
            at += 1
    return out


def test_label_blocks_against_brute_force(spark):
    rng = random.Random(2)
    columns = {c: [(float(rng.randrange(3)), float(rng.randrange(900)), f"{rng.choice(['08', '01', '8', '12'])} {rng.choice(['가나', 'x'])}") for _ in range(60)] for c in range(12)}
    rows = [(1, 1, c, t, x, y, y + 9) for c, own in columns.items() for x, y, t in own]
    got = layout.label_blocks(spark.createDataFrame(rows, "doc_id long, page int, col int, text string, x0 double, y0 double, y1 double")).collect()
    found = {}
    for r in got:
        found.setdefault(r["col"], []).append((r["type_id"], r["y0"]))
    want = {c: brute_labels([x for x in own if x[2][:2].isdigit() and x[2][2] == " " and x[2].endswith("가나")]) for c, own in columns.items()}
    assert {c: sorted(v) for c, v in found.items()} == {c: sorted(v) for c, v in want.items() if v} and found


def brute_best(numbers):
    """Resets by the loop, the longest increasing chain by trying all."""
    kept = []
    for i, n in enumerate(numbers):
        if not kept or n > numbers[kept[-1]] or n == 1:
            kept.append(i)
    ups = max((len(c) for k in range(len(numbers) + 1) for c in itertools.combinations(range(len(numbers)), k) if all(numbers[a] < numbers[b] for a, b in itertools.pairwise(c))), default=0)
    return (ups, None) if ups > len(kept) else (len(kept), kept)


def test_best_and_chosen_chains_against_brute_force(spark):
    rng = random.Random(3)
    docs = {d: [(rng.randint(1, 7), rng.choice(".)"), rng.choice([None, None, "유제", "기본문제"])) for _ in range(rng.randrange(1, 10))] for d in range(60)}
    rows = [(d, i, n, None if s else m, s) for d, own in docs.items() for i, (n, m, s) in enumerate(own)]
    a = spark.createDataFrame(rows, "doc_id long, pos int, no int, delimiter string, series string")
    best, chosen = {}, {}
    for r in chain.chains(a.select("doc_id", "pos", "no")).collect():
        best.setdefault(r["doc_id"], []).append(r["pos"])
    for r in chain.chosen(a).collect():
        chosen.setdefault(r["doc_id"], []).append(r["pos"])
    longest = lambda n: max((len(c) for k in range(len(n) + 1) for c in itertools.combinations(n, k) if all(x < y for x, y in itertools.pairwise(c))), default=0)
    for d, own in docs.items():
        size, exact = brute_best([n for n, _, _ in own])
        assert len(best[d]) == size and (exact is None or sorted(best[d]) == exact)
        plain = {m: [i for i, (_, x, s) in enumerate(own) if s is None and x == m] for m in ".)"}
        mark = ")" if longest([own[i][0] for i in plain[")"]]) > longest([own[i][0] for i in plain["."]]) else "."
        n_plain = brute_best([own[i][0] for i in plain[mark]])[0]
        series = {s: [i for i, x in enumerate(own) if x[2] == s] for s in ("유제", "기본문제")}
        n_book = sum(brute_best([own[i][0] for i in at])[0] for at in series.values())
        got = chosen.get(d, [])
        assert len(got) == max(n_plain, n_book)
        assert all((own[i][2] is not None) == (n_book > n_plain) for i in got) and all(own[i][1] == mark for i in got if own[i][2] is None)


def test_boxes_in_cells_are_not_sent_whole(spark):
    """Boxes made of a small table were broadcast, however many they were in cells; results against brute force."""
    boxes = spark.range(40).selectExpr("id as doc_id", "explode(array(1, 2)) as page", "1 as no", "10D + id as x0", "90D as y0", "250D as x1", "200D + 2 * id as y1")
    things = spark.range(2000).selectExpr("id % 40 as doc_id", "cast(id % 3 as int) as page", "id", "cast(id * 7 % 300 as double) as cx", "cast(id * 11 % 310 as double) as cy")
    shapes = things.selectExpr("doc_id", "page", "id", "cx - 20 as s_x0", "cy - 30 as s_y0", "cx as s_x1", "cy as s_y1")
    held, touching = layout.held(boxes, things), layout.touching(boxes, shapes)
    b, t = boxes.collect(), things.collect()
    pairs = [(x, y) for x in b for y in t if (x.doc_id, x.page) == (y.doc_id, y.page)]
    assert sorted((r.doc_id, r.page, r.id) for r in held.collect()) == sorted((x.doc_id, x.page, y.id) for x, y in pairs if x.x0 <= y.cx <= x.x1 and x.y0 <= y.cy <= x.y1)
    assert sorted((r.doc_id, r.page, r.id) for r in touching.collect()) == sorted((x.doc_id, x.page, y.id) for x, y in pairs if y.cx - 20 < x.x1 and y.cx > x.x0 and y.cy - 30 < x.y1 and y.cy > x.y0)
    for found in (held, touching):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_groups_come_as_rows(spark):
    """Groups were gathered as arrays, up to 10,000 groups in one Arrow batch; now batches hold rows, over which groups may run."""
    rows = spark.range(25_000).selectExpr("id % 3 as doc_id", "id as pos", "cast(id * 7919 % 10007 as int) as no")
    for df in (chain.chains(rows), chain.chain_lengths(rows), chain.chosen(rows.selectExpr("*", "'.' as delimiter", "cast(null as string) as series"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "MapInArrow" in plan
    own = {d: [i * 7919 % 10007 for i in range(d, 25_000, 3)] for d in range(3)}
    got = {r["doc_id"]: (r["anchors"], r["increasing"], r["resets"]) for r in chain.chain_lengths(rows).collect()}
    assert got == {d: (len(n), len(chain.longest_increasing(n)), len(chain._reset(n))) for d, n in own.items()}
    lines = rows.selectExpr("doc_id", "1 as page", "0 as col", "if(pos % 12 < 3, '08 가나', '11 가나') as text", "0D as x0", "cast(pos as double) as y0", "cast(pos + 1 as double) as y1")
    found = layout.label_blocks(lines)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString() and {r["type_id"] for r in found.collect()} == {"08.11.11.11"}


def test_glyphs_are_put_in_order_once_and_read_as_rows(spark):
    """Line items were put in order twice, for the glyphs and for their body sizes, and glyphs came to Python as arrays."""
    from examlake.plans import catalog

    plan = catalog.queries()["g4_g5_g6_g7_latex"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_regions_without_a_body_size_take_their_own(spark):
    rng = random.Random(3)
    rows = [(d, 1, rng.choice([" ", "a", None, "\ue001", "\ue044", "\ue045", "\ue06d"]), rng.choice([8.96, 9.0, 10.0, 6.0]), float(rng.randrange(60)), float(rng.randrange(90, 110))) for d in range(60) for _ in range(1 + d % 9)]
    g = spark.createDataFrame(rows, "doc_id long, no int, char string, size double, x0 double, baseline double").withColumn("x1", F.col("x0") + 5).withColumn("offset", glyphs.offset(F.col("char")))
    m = glyphs.mapped(g, spark.createDataFrame([(1, "x", True), (OPEN, "(", True), (CLOSE, ")", False)], "offset int, latex string, certain boolean")).withColumn("latex", F.coalesce("latex", F.lit("")))
    boxes = m.select("doc_id", "no").distinct().withColumn("graphics_reason", F.lit(None).cast("string"))
    key = lambda df: sorted(map(str, df.collect()))
    got = glyphs.decoded(m, boxes)
    assert key(got) == key(glyphs.decoded(m.join(glyphs.body_sizes(m), glyphs.REGION, "left"), boxes)) and got.count() == 60


def test_offsets_of_characters(spark):
    chars = ["", None, "a", "\ue000", "\uf8ff", "\uf900", "\ud7ff", "\ue001\ue002", "\U000f0001", "가"]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select(glyphs.offset(F.col("c")).alias("k")).collect()
    assert [r["k"] for r in got] == [None, None, None, 0, 0xF8FF - 0xE000, None, None, None, None, None]


def test_nulls_of_grouped_rows(spark):
    from examlake.operators.grouped import grouped

    rows = [(1.0, None, True, "a", None, 0.5), (1.0, 2, None, None, [1], None), (None, 3, False, "", [], 1.5)]
    df = spark.createDataFrame(rows, "k double, i long, b boolean, s string, l array<int>, f double")  # a null key stays, a null fraction is NaN
    got = grouped(df, ["k"], ("i", "b", "s", "l", "f"), lambda *c: [(repr(c),)], "r string").collect()
    assert {r["k"]: r["r"] for r in got} == {None: repr(((3,), (False,), ("",), ([],), (1.5,))), 1.0: repr(((None, 2), (True, None), ("a", None), (None, [1]), (0.5, float("nan"))))}
