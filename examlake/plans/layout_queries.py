"""Layout and number chains over page lines derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.operators import chain, glyphs, layout
from examlake.plans import inputs as I
from examlake.plans.catalog import query


@query("""WITH p AS (SELECT o_orderkey AS doc_id, 1 AS page, 600.0::DOUBLE AS w, (800 + o_custkey % 50)::DOUBLE AS h FROM orders), r AS (SELECT l_orderkey AS doc_id, ((l_partkey % 9) * 100.0)::DOUBLE AS y0, (l_partkey % 9) * 100.0 + (l_suppkey % 4)::DOUBLE AS y1, (l_partkey % 7 * 100)::DOUBLE AS len FROM lineitem),
e AS (SELECT doc_id, count(*) AS n, arg_min(y1, (y0, y1)) AS a, max(y0) AS b FROM r JOIN p USING (doc_id) WHERE len >= 0.7 * w AND y1 - y0 <= 2 GROUP BY doc_id)
SELECT doc_id, coalesce(n >= 2 AND b - 2 - (a + 2) >= 0.5 * h, false) AS ruled, CASE WHEN coalesce(n >= 2 AND b - 2 - (a + 2) >= 0.5 * h, false) THEN a + 2 ELSE h * 0.03 END AS y0, CASE WHEN coalesce(n >= 2 AND b - 2 - (a + 2) >= 0.5 * h, false) THEN b - 2 ELSE h * (1 - 0.06) END AS y1 FROM p LEFT JOIN e USING (doc_id)""")
def w1_body_rects(spark, d):
    p = I.table(spark, d, "orders").selectExpr("o_orderkey as doc_id", "1 as page", "cast(600 as double) as w", "cast(800 + o_custkey % 50 as double) as h")
    r = I.table(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "1 as page", "cast(0 as double) as x0", "cast(l_partkey % 7 * 100 as double) as x1", "cast(l_partkey % 9 * 100 as double) as y0", "cast(l_partkey % 9 * 100 + l_suppkey % 4 as double) as y1")
    return layout.body_rects(p, r).select("doc_id", "ruled", "y0", "y1")


@query(f"""WITH {I.LINES_SQL} SELECT doc_id, no, text, CASE WHEN doc_id % 4 = 0 OR x0 < 300 THEN 0 ELSE 1 END::INT AS side, (CASE WHEN doc_id % 4 = 0 THEN 24.0 WHEN x0 < 300 THEN 24.0 ELSE 303.0 END)::DOUBLE AS c0, (CASE WHEN doc_id % 4 = 0 THEN 576.0 WHEN x0 < 300 THEN 297.0 ELSE 576.0 END)::DOUBLE AS c1 FROM lines""")
def w2_column_sides(spark, d):
    single = F.col("doc_id") % 4 == 0
    side = layout.column_of(F.col("x0"), F.lit(300.0), single)
    b = layout.column_bounds(side, F.lit(300.0), single, F.lit(24.0), F.lit(576.0))
    return I.lines(spark, d).select("doc_id", "no", "text", side.alias("side"), b["x0"].alias("c0"), b["x1"].alias("c1"))


_ALIGN = f"""WITH {I.LINES_SQL}, g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER w > 1.0 THEN 1 ELSE 0 END AS gap FROM lines WINDOW w AS (PARTITION BY doc_id, page, col ORDER BY x0)), i AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, page, col ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS island FROM g),
a AS (SELECT doc_id, page, col, min(x) AS align_x0 FROM (SELECT doc_id, page, col, island, min(x0) AS x FROM i GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL)"""


@query(_ALIGN + " SELECT doc_id, page, col, align_x0::DOUBLE AS align_x0 FROM a")
def w3_alignment_lines(spark, d):
    return layout.alignment(I.lines(spark, d), layout.COLUMN)


@query(_ALIGN + """, gd AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, col ORDER BY x0) > 1.0 THEN 1 ELSE 0 END AS gap2 FROM lines), id AS (SELECT *, sum(gap2) OVER (PARTITION BY doc_id, col ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS island FROM gd),
ad AS (SELECT doc_id, col, min(x) AS doc_x0 FROM (SELECT doc_id, col, island, min(x0) AS x FROM id GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL)
SELECT l.doc_id, l.page, l.col, count(*) AS anchors FROM lines l LEFT JOIN a USING (doc_id, page, col) LEFT JOIN ad ON ad.doc_id = l.doc_id AND ad.col = l.col WHERE l.x0 - (CASE WHEN l.col = 0 THEN 60 ELSE 340 END) <= 30 OR l.x0 - coalesce(align_x0, doc_x0) <= 30 GROUP BY ALL""")
def w4_w5_aligned_anchors(spark, d):
    x = I.lines(spark, d)
    kept = layout.aligned(x.withColumn("col_x0", F.when(F.col("col") == 0, 60.0).otherwise(340.0)), x)
    return kept.groupBy(*layout.COLUMN).agg(F.count("*").alias("anchors"))


@query(f"""WITH {I.ANCHORS_SQL}, s AS (SELECT *, sum((no = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM anchors), t AS (SELECT *, max(no) OVER (PARTITION BY doc_id, s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s) SELECT doc_id, pos, no FROM t WHERE top IS NULL OR no > top OR no = 1""")
def w7_reset_chains(spark, d):
    return chain.reset_chain(I.anchors(spark, d), ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "no")


#: The longest strictly increasing chain by counting: numbers are 1 to 7, so chains by their last number are seven values carried along.
@query(f"""WITH RECURSIVE {I.ANCHORS_SQL}, n AS (SELECT doc_id, max(pos) AS n FROM anchors GROUP BY doc_id), r AS (SELECT doc_id, 0::BIGINT AS pos, [0, 0, 0, 0, 0, 0, 0] AS best FROM n
UNION ALL SELECT r.doc_id, a.pos, list_transform(range(1, 8), lambda v: CASE WHEN v = a.no THEN greatest(r.best[v], 1 + coalesce(list_max(r.best[1:v-1]), 0)) ELSE r.best[v] END) FROM r JOIN anchors a ON a.doc_id = r.doc_id AND a.pos = r.pos + 1)
SELECT r.doc_id, n AS anchors, list_max(best)::BIGINT AS increasing FROM r JOIN n ON n.doc_id = r.doc_id AND r.pos = n.n""")
def w6_increasing_lengths(spark, d):
    return chain.chain_lengths(I.anchors(spark, d)).select("doc_id", "anchors", "increasing")


@query()
def w6_w8_best_chains(spark, d):
    return chain.chains(I.anchors(spark, d))


@query()
def w9_w10_chosen_chains(spark, d):
    a = I.anchors(spark, d).withColumn("series", F.expr("case when doc_id % 3 = 0 and pos % 2 = 0 then '유제' when doc_id % 3 = 0 and pos % 5 = 1 then '기본문제' end")).withColumn("delimiter", F.expr("case when series is null then if((doc_id + pos) % 3 = 0, ')', '.') end"))
    return chain.chosen(a)


@query(f"WITH {I.LINES_SQL} SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page, col, y0, x0, no, text)::BIGINT AS pos FROM lines")
def w11_reading_order(spark, d):
    x = I.lines(spark, d).withColumn("no", F.struct("no", "text"))
    return layout.reading_order(x).select("doc_id", "text", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {I.LINES_SQL} SELECT doc_id, page, col, text, greatest(20.0, y0 - 2)::DOUBLE AS r_y0, coalesce((SELECT min(b.y0) FROM lines b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.col = a.col AND b.y0 > a.y0) - 3, 820.0)::DOUBLE AS r_y1 FROM lines a""")
def w12_problem_regions(spark, d):
    x = I.lines(spark, d).withColumns({"body_y0": F.lit(20.0), "body_y1": F.lit(820.0)})
    return layout.regions(x).select(*layout.COLUMN, "text", "r_y0", "r_y1")


@query(f"WITH {I.ANCHORS_SQL}, c AS (SELECT doc_id, count(*) <> count(DISTINCT no) AS again FROM anchors GROUP BY doc_id) SELECT doc_id, pos, CASE WHEN again THEN row_number() OVER (PARTITION BY doc_id ORDER BY pos) ELSE no END::INT AS no, no::VARCHAR AS label FROM anchors JOIN c USING (doc_id)")
def w13_renumbered(spark, d):
    x = I.anchors(spark, d).withColumn("label", F.lit(None).cast("string"))
    return layout.renumbered(x).select("doc_id", F.col("pos").cast("long").alias("pos"), "no", "label")


_BOXES = "boxes AS (SELECT s_suppkey AS doc_id, (p.x + 1)::INT AS page, (n.x + 1)::INT AS no, (80 + 200 * (n.x % 2))::DOUBLE AS bx0, (100.0 * n.x)::DOUBLE AS by0, (260 + 200 * (n.x % 2))::DOUBLE AS bx1, (100.0 * n.x + 150)::DOUBLE AS by1 FROM supplier, range(3) p(x), range(7) n(x))"


def _boxes(spark, d):
    s = I.table(spark, d, "supplier").selectExpr("s_suppkey as doc_id", "explode(sequence(1, 3)) as page").selectExpr("*", "explode(sequence(0, 6)) as n")
    return s.selectExpr("doc_id", "page", "n + 1 as no", "cast(80 + 200 * (n % 2) as double) as x0", "cast(100 * n as double) as y0", "cast(260 + 200 * (n % 2) as double) as x1", "cast(100 * n + 150 as double) as y1")


@query(f"""WITH {I.LINES_SQL}, {_BOXES}, h AS (SELECT b.doc_id, b.page, b.no, string_agg(l.text, chr(10) ORDER BY floor(l.y0 * 10 + 0.5), l.x0, l.text) AS t FROM boxes b JOIN lines l ON l.doc_id = b.doc_id AND l.page = b.page AND l.x0 + 50 BETWEEN bx0 AND bx1 AND l.y0 + 6 BETWEEN by0 AND by1 GROUP BY ALL)
SELECT doc_id, page, no, sha256(t) AS text_sha FROM boxes LEFT JOIN h USING (doc_id, page, no)""")
def j3_region_texts(spark, d):
    x = I.lines(spark, d).withColumns({"x1": F.col("x0") + 100, "y1": F.col("y0") + 12})
    return layout.region_texts(x, _boxes(spark, d)).select("doc_id", "page", "no", F.sha2("text", 256).alias("text_sha"))


@query(f"""WITH {I.LINES_SQL}, {_BOXES}, i AS (SELECT b.doc_id, b.page, b.no, count(*) FILTER (l.no = 7) AS im, count(*) FILTER (l.no < 7) AS dr FROM boxes b JOIN lines l ON l.doc_id = b.doc_id AND l.page = b.page AND l.x0 < bx1 AND l.x0 + 10 > bx0 AND l.y0 < by1 AND l.y0 + 10 > by0 GROUP BY ALL)
SELECT doc_id, page, no, CASE WHEN im > 0 THEN 'image' WHEN dr > 6 THEN 'drawings' END AS graphics_reason FROM boxes LEFT JOIN i USING (doc_id, page, no)""")
def a17_graphics_reasons(spark, d):
    x = I.lines(spark, d).withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10})
    return layout.graphics_reasons(_boxes(spark, d), x.filter("no = 7"), x.filter("no < 7")).select("doc_id", "page", "no", "graphics_reason")


@query("""WITH p AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, sum(CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END) AS t FROM lineitem GROUP BY ALL) SELECT doc_id, sum(f) >= 3 AND 2 * count(*) FILTER (f > 0) >= count(*) AS single FROM p WHERE t > 0 GROUP BY doc_id""")
def a20_single_column_votes(spark, d):
    p = I.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.sum(F.expr("if(l_partkey % 29 = 0, 1, 0)")).alias("full"), F.sum(F.expr("if(l_linenumber = 7, 0, 1)")).alias("total"))
    return layout.single_column_vote(p)


@query()
def w16_full_rows(spark, d):
    w = I.lines(spark, d).selectExpr("doc_id", "page", "x0", "y0", "x0 + 20 + no * 45 as x1", "y0 + 10 as y1", "cast(600 as double) as w")
    return layout.full_rows(w)


@query()
def w14_w15_merged_numbers(spark, d):
    g = I.lines(spark, d).selectExpr("doc_id", "page", "cast(no as string) as text", "x0", "floor(y0 / 40) * 40 as y0", "x0 + 2 as x1")
    return layout.merged_numbers(g)


@query()
def w17_label_blocks(spark, d):
    x = I.lines(spark, d).selectExpr("doc_id", "page", "col", "concat(if(no = 1, '08', lpad(no, 2, '0')), ' 가나') as text", "x0", "y0 / 2 as y0", "y0 / 2 + 10 as y1")
    return layout.label_blocks(x)


@query(f"""WITH {I.LINES_SQL}, {_BOXES}, g AS (SELECT doc_id, page, x0 + no AS gx0, y0 + no AS gy0, CASE WHEN no % 3 <> 0 THEN no END AS off, (CASE WHEN no = 7 THEN 0.5 ELSE 9 + no END)::DOUBLE AS size FROM lines)
SELECT doc_id, page, no, gx0::DOUBLE AS x0, gy0::DOUBLE AS y0, off::INT AS "offset", size, count(*) AS n FROM boxes JOIN g USING (doc_id, page) WHERE size >= 1 AND gx0 + 3 BETWEEN bx0 AND bx1 AND gy0 + 5 BETWEEN by0 AND by1 GROUP BY ALL""")
def g1_region_glyphs(spark, d):
    x = I.lines(spark, d).withColumn("char", F.when(F.col("no") % 3 != 0, F.decode(F.unhex(F.lpad(F.hex(F.col("no").cast("long") + 0xE000), 4, "0")), "UTF-16BE")).otherwise("a"))
    g = x.selectExpr("doc_id", "page", "char", "'HyhwpEQ' as font", "cast(if(no = 7, 0.5, 9 + no) as double) as size", "y0 as baseline", "x0 + no as x0", "y0 + no as y0", "x0 + no + 6 as x1", "y0 + no + 10 as y1")
    return glyphs.region_glyphs(g, _boxes(spark, d)).groupBy("doc_id", "page", "no", "x0", "y0", "offset", "size").agg(F.count("*").alias("n"))


_GLYPHS = """g AS (SELECT l_suppkey AS doc_id, l_linenumber AS no, l_orderkey % 130 AS off, 9.0 + (l_partkey % 4) / 2.0 AS size FROM lineitem)"""


def _glyphs(spark, d):
    x = I.table(spark, d, "lineitem").selectExpr("l_suppkey as doc_id", "l_linenumber as no", "1 as page", "char(57344 + l_orderkey % 130) as c", "l_orderkey % 130 as k", "cast(9.0 + (l_partkey % 4) / 2.0 as double) as size", "cast(l_partkey as double) as x0", "l_quantity as baseline")
    # char() stops at 255: the code point in UTF-16
    ch = F.decode(F.unhex(F.lpad(F.hex(F.col("k") + 0xE000), 4, "0")), "UTF-16BE")
    return x.select("doc_id", "page", "no", ch.alias("char"), F.lit("HyhwpEQ").alias("font"), "size", "x0", (F.col("x0") + 5).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), "baseline").withColumn("offset", glyphs.offset(F.col("char")))


@query(f"WITH {_GLYPHS}, v AS (SELECT doc_id, no, floor(size * 10 + 0.5) / 10 AS s, count(*) AS n FROM g WHERE off NOT IN (92, 109, 110) GROUP BY ALL) SELECT doc_id, no, arg_max(s, (n, s))::DOUBLE AS body FROM v GROUP BY doc_id, no")
def a15_body_sizes(spark, d):
    return glyphs.body_sizes(_glyphs(spark, d))


def _mapped(spark, d):
    table = I.table(spark, d, "part").selectExpr("cast(p_partkey % 130 as int) as offset").distinct().filter("offset % 10 <> 3").withColumn("latex", F.expr("case offset % 5 when 0 then '(' when 1 then ')' when 2 then '|' else concat('x', offset) end")).withColumn("certain", F.expr("offset % 7 <> 2"))
    return glyphs.mapped(_glyphs(spark, d), table)


@query(f"WITH {_GLYPHS} SELECT doc_id, no, coalesce(array_to_string(list_sort(list(DISTINCT off) FILTER (off % 10 = 3 AND off NOT IN (92, 109, 110))), ','), '') AS unknown, coalesce(array_to_string(list_sort(list(DISTINCT off) FILTER (off % 10 <> 3 AND off % 7 = 2)), ','), '') AS uncertain FROM g GROUP BY doc_id, no")
def g1_g2_mapping_report(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return glyphs.mapping_report(_mapped(spark, d)).select("doc_id", "no", text("unknown"), text("uncertain"))


@query(f"WITH {_GLYPHS} SELECT doc_id, no, count(*) FILTER (off % 5 = 0 AND off % 10 <> 3) = count(*) FILTER (off % 5 = 1 AND off % 10 <> 3) AND count(*) FILTER (off % 5 = 2) % 2 = 0 AS paired FROM g GROUP BY doc_id, no")
def a16_pair_checks(spark, d):
    return glyphs.pair_check(_mapped(spark, d))


@query("WITH g AS (SELECT l_suppkey AS doc_id, l_linenumber AS no, (l_partkey % 4) / 2.0 + 6 AS size, l_quantity AS b FROM lineitem) SELECT doc_id, no, CASE WHEN size < 0.8 * 9 AND b - 25 < -0.15 * 9 THEN '^' WHEN size < 0.8 * 9 AND b - 25 > 0.15 * 9 THEN '_' ELSE '' END AS script, count(*) AS glyphs FROM g GROUP BY ALL")
def g3_scripts(spark, d):
    g = _glyphs(spark, d).withColumns({"size": F.col("size") - 3, "body": F.lit(9.0), "line": F.lit(25.0)})
    return glyphs.scripts(g).groupBy("doc_id", "no", "script").agg(F.count("*").alias("glyphs"))


@query()
def g4_g5_g6_g7_decoded(spark, d):
    m = _mapped(spark, d)
    m = m.join(glyphs.body_sizes(m), glyphs.REGION)
    boxes = m.select(*glyphs.REGION).distinct().withColumn("graphics_reason", F.expr("if(doc_id % 9 = 0, 'image', null)"))
    return glyphs.routed(glyphs.decoded(m, boxes).withColumn("has_crop", F.col("no") != 7)).select("doc_id", "no", "ok", "reason", "route")


#: Regions of one row with scripts, every third with a fraction behind it; of some the glyphs are unknown, uncertain, unpaired, blank, left over or none.
_REGIONS = f"""{I.ANCHORS_SQL}, a AS (SELECT doc_id, pos, (doc_id + no * 7 + pos) % 60 AS off, CASE WHEN pos % 3 = 2 AND no % 2 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '^' ELSE '_' END END AS mark FROM anchors),
t AS (SELECT *, CASE WHEN off = 29 THEN '?' WHEN off = 40 THEN '(' WHEN off = 41 THEN ')' ELSE chr((97 + off % 26)::INT) END AS latex FROM a),
r AS (SELECT doc_id, string_agg(CASE WHEN mark IS NULL THEN latex ELSE mark || '{{' || latex || '}}' END, '' ORDER BY pos) AS row, bool_or(off = 29) AS unknown, bool_or(off = 13) AS uncertain, count(*) FILTER (off = 40) <> count(*) FILTER (off = 41) AS unpaired FROM t GROUP BY doc_id)"""


@query(f"""WITH {_REGIONS} SELECT doc_id, 1 AS no, CASE WHEN doc_id % 50 NOT IN (11, 12) THEN row || CASE WHEN doc_id % 3 = 0 THEN '\\frac{{j}}{{k}}' ELSE '' END || CASE WHEN doc_id % 10 = 7 THEN '?' ELSE '' END END AS latex,
CASE doc_id % 50 WHEN 11 THEN 'no_glyphs' WHEN 12 THEN 'no_body' ELSE concat_ws(' / ', CASE WHEN uncertain THEN 'uncertain' END, CASE WHEN unknown THEN 'unknown' END, CASE WHEN doc_id % 10 = 7 THEN 'structure' END, CASE WHEN doc_id % 9 = 0 THEN 'image' END, CASE WHEN unpaired THEN 'pairs' END) END AS reasons,
CASE WHEN doc_id % 50 NOT IN (11, 12) AND NOT (uncertain OR unknown OR unpaired OR doc_id % 10 = 7 OR doc_id % 9 = 0) THEN 'pua' WHEN doc_id % 4 = 0 THEN 'crop_missing' ELSE 'ai' END AS route FROM r""")
def g4_g5_g6_g7_latex(spark, d):
    """Whole regions of known glyphs: most of them decode."""
    a = I.anchors(spark, d).selectExpr("doc_id", "pos", "(doc_id + no * 7 + pos) % 60 as k", "pos % 3 = 2 and no % 2 = 0 as small")
    # What stands behind a row comes with its first glyph, so that the line items are put in order once.
    glyph = lambda k, size, base, x0, width: f"struct(cast({k} as bigint) as k, cast({size} as double) as size, cast({base} as double) as baseline, cast({x0} as double) as x0, cast({width} as double) as width)"
    own = glyph("k", "if(small, 6, 10)", "if(small, if(doc_id % 2 = 0, 95, 104), 100)", "10 * pos", 5)
    third = ", ".join((glyph(61, 10, 92, 202, 5), glyph(glyphs.BAR, 10, 100, 200, 9), glyph(62, 10, 104, 202, 5)))
    left = glyph(glyphs.BAR, 10, 100, 300, 9)
    behind = f"concat(array({own}), if(doc_id % 3 = 0, array({third}), array()), if(doc_id % 10 = 7, array({left}), array()))"
    g = a.filter("doc_id % 50 <> 11").selectExpr("doc_id", f"inline(if(pos = 1, {behind}, array({own})))")
    ch = F.when(F.col("doc_id") % 50 == 12, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.col("k") + 0xE000), 4, "0")), "UTF-16BE"))
    g = g.select("doc_id", F.lit(1).alias("no"), ch.alias("char"), "size", "baseline", "x0", (F.col("x0") + F.col("width")).alias("x1")).withColumn("offset", glyphs.offset(F.col("char")))
    known = I.table(spark, d, "part").selectExpr("cast(p_partkey % 65 as int) as offset").distinct().filter("offset <> 29").selectExpr("offset", "case offset when 40 then '(' when 41 then ')' else decode(unhex(hex(97 + offset % 26)), 'UTF-8') end as latex", "offset <> 13 as certain")
    m = glyphs.mapped(g, known)
    boxes = I.table(spark, d, "lineitem").selectExpr("l_orderkey as doc_id").distinct().selectExpr("doc_id", "1 as no", "if(doc_id % 9 = 0, 'image', null) as graphics_reason")
    return glyphs.routed(glyphs.decoded(m, boxes).withColumn("has_crop", F.col("doc_id") % 4 != 0)).select("doc_id", "no", "latex", F.array_join("reasons", " / ").alias("reasons"), "route")


@query("SELECT doc_id % 50 AS run_id, count(*) FILTER (doc_id % 3 = 0) AS decoded, count(*) FILTER (doc_id % 3 = 1) AS ai, count(*) FILTER (doc_id % 3 = 1 AND doc_id % 5 = 0) AS unavailable FROM documents GROUP BY ALL")
def a12_run_counters(spark, d):
    a = I.table(spark, d, "documents").selectExpr("doc_id % 50 as run_id", "case doc_id % 3 when 0 then 'pua' when 1 then 'ai' else 'crop_missing' end as route", "doc_id % 5 <> 0 as available")
    return glyphs.run_counters(a)


@query(f"""WITH {I.LINES_SQL}, t AS (SELECT doc_id, page, min(x0) AS a, max(x0 + 100) AS b FROM lines WHERE no % 2 = 0 GROUP BY ALL), p AS (SELECT DISTINCT doc_id, page FROM lines)
SELECT doc_id, page, coalesce(greatest(0.0, a - 2), 24.0)::DOUBLE AS x0, coalesce(least(600.0, b + 2), 576.0)::DOUBLE AS x1, coalesce((greatest(0.0, a - 2) + least(600.0, b + 2)) / 2, 300.0)::DOUBLE AS split FROM p LEFT JOIN t USING (doc_id, page)""")
def w2_p28_ocr_rects(spark, d):
    x = I.lines(spark, d).withColumns({"x1": F.col("x0") + 100, "confidence": F.when(F.col("no") % 2 == 0, 0.5).otherwise(0.4999)})
    bodies = x.select("doc_id", "page").distinct().withColumns({"w": F.lit(600.0), "x0": F.lit(24.0), "x1": F.lit(576.0)})
    return layout.ocr_rects(bodies, layout.sure_lines(x)).select("doc_id", "page", "x0", "x1", "split")


@query(f"""WITH {I.LINES_SQL}, b AS (SELECT *, y0 + 12 + no AS y1, CASE col WHEN 0 THEN 60 ELSE 340 END AS c0, CASE col WHEN 0 THEN 290 ELSE 360 END AS c1 FROM lines)
SELECT doc_id, page, col, count(*) FILTER ((y0 + y1) / 2 BETWEEN 40 AND 700) AS anchors, count(*) FILTER (y0 >= 40 AND y1 <= 700 AND x0 BETWEEN c0 - 1 AND c1) AS samples FROM b GROUP BY ALL""")
def p27_content_bands(spark, d):
    x = I.lines(spark, d).withColumns({"y1": F.col("y0") + 12 + F.col("no"), "c0": F.when(F.col("col") == 0, 60).otherwise(340), "c1": F.when(F.col("col") == 0, 290).otherwise(360)})
    band = F.lit(40.0), F.lit(700.0)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return x.groupBy(*layout.COLUMN).agg(n(layout.in_band(F.col("y0"), F.col("y1"), *band), "anchors"), n(layout.is_sample(F.col("x0"), F.col("y0"), F.col("y1"), *band, F.col("c0"), F.col("c1")), "samples"))


@query()
def w15_fallback_anchors(spark, d):
    """Workbooks whose numbers are large glyphs: their chains where plain anchors are fewer than two."""
    x = I.lines(spark, d)
    spans = x.selectExpr("doc_id", "page", "if(no % 2 = 0, 'DINCondensed-Bold', 'Body') as font", "cast(if(no % 3 = 0, 10, 16) as double) as size", "cast(no as string) as text", "x0", "y0", "x0 + 4 as x1")
    bodies = x.select("doc_id", "page").distinct().withColumns({"w": F.lit(600.0), "y0": F.lit(20.0), "y1": F.lit(760.0)})
    numbers = layout.workbook_anchors(spans, bodies)
    kept = chain.chains(numbers.select("doc_id", "pos", "no"), chain.longest_increasing)
    return layout.with_fallback(x.filter("doc_id % 3 = 0"), numbers.join(kept.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi"))
