"""Corpus ingest and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.operators import corpus
from examlake.operators import types as types_
from examlake.plans import inputs as I
from examlake.plans.catalog import query

_ROWS = f"WITH {I.PROBLEMS_SQL}, h AS (SELECT *, {I.HASH_SQL} AS content_hash FROM problems), r AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY content_hash) AS is_stored FROM h)"


def _dedup(spark, d):
    hashed, _ = corpus.hashed(I.problems(spark, d))
    return corpus.deduplicated(hashed, ["doc_id"], keep=["source"])


@query(_ROWS + " SELECT source, count(*) AS problems, count(*) FILTER (is_stored) AS stored, count(*) FILTER (NOT is_stored) AS duplicates FROM r GROUP BY source")
def d1_corpus_dedup(spark, d):
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return _dedup(spark, d).groupBy("source").agg(F.count("*").alias("problems"), n(F.col("is_stored"), "stored"), n(~F.col("is_stored"), "duplicates"))


@query(_ROWS + " SELECT doc_id, content_hash, is_stored FROM r")
def p6_p7_content_hash_rows(spark, d):
    return _dedup(spark, d).select("doc_id", "content_hash", "is_stored")


@query(_ROWS + " SELECT doc_id, content_hash FROM r WHERE is_stored AND content_hash NOT IN (SELECT content_hash FROM h WHERE source = 'src3')")
def d1_dedup_against_stored(spark, d):
    hashed, _ = corpus.hashed(I.problems(spark, d))
    stored = hashed.filter("source = 'src3'")
    return corpus.deduplicated(hashed, ["doc_id"], stored).filter("is_stored").select("doc_id", "content_hash")


@query(_ROWS + """, m AS (SELECT source AS file, is_stored, doc_id % 11 <> 0 AS matched FROM r),
c AS (SELECT file, count(*) AS problems, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (NOT is_stored) AS duplicates, count(*) FILTER (is_stored AND matched) AS tagged FROM m GROUP BY file
  UNION ALL SELECT '*', count(*), count(*) FILTER (matched), count(*) FILTER (NOT matched), count(*) FILTER (NOT is_stored), count(*) FILTER (is_stored AND matched) FROM m)
SELECT *, floor(100.0::DOUBLE * matched / problems * 100 + 0.5) / 100 AS match_rate FROM c""")
def a10_ingest_report(spark, d):
    return corpus.ingest_report(_dedup(spark, d).withColumn("matched", F.col("doc_id") % 11 != 0))


#: Blocks and problems of columns: a block for most columns, two for some, and some below a problem.
_LABELS = """WITH p AS (SELECT l_orderkey AS doc_id, (l_linenumber % 2 + 1)::INT AS page, (l_partkey % 2)::INT AS col, l_linenumber AS no, (l_partkey % 700 + 100)::DOUBLE AS top FROM lineitem),
b AS (SELECT o_orderkey AS doc_id, 1 + x AS page, y AS col, (o_custkey % 300)::DOUBLE AS y1, '08.' || lpad((o_custkey % 12)::VARCHAR, 2, '0') || '.01.01' AS type_id FROM orders, (VALUES (0), (1)) a(x), (VALUES (0), (1)) c(y) WHERE (o_orderkey + x + y) % 5 <> 0
  UNION ALL SELECT o_orderkey, 1, 0, 10, '08.99.01.01' FROM orders WHERE o_orderkey % 6 = 0),
g AS (SELECT doc_id, page, col, count(*) AS n, max(y1) AS bottom, min(type_id) AS type_id FROM b GROUP BY ALL), t AS (SELECT doc_id, page, col, min(top) AS top FROM p GROUP BY ALL),
r AS (SELECT t.doc_id, t.page, t.col, CASE WHEN n IS NULL THEN 'no_label' WHEN n > 1 THEN 'many_labels' WHEN bottom > t.top THEN 'label_below' END AS reason, type_id FROM t LEFT JOIN g USING (doc_id, page, col)),
z AS (SELECT p.doc_id, p.page, p.col, no, top, reason, CASE WHEN reason IS NULL THEN type_id END AS type_id FROM p JOIN r USING (doc_id, page, col))"""


def _labelled(spark, d):
    p = I.table(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber % 2 + 1 as page", "cast(l_partkey % 2 as int) as col", "l_linenumber as no", "cast(l_partkey % 700 + 100 as double) as top")
    o = I.table(spark, d, "orders")
    sides = o.selectExpr("*", "explode(array(0, 1)) as x").selectExpr("*", "explode(array(0, 1)) as y").filter("(o_orderkey + x + y) % 5 <> 0")
    b = sides.selectExpr("o_orderkey as doc_id", "1 + x as page", "y as col", "cast(o_custkey % 300 as double) as y1", "concat('08.', lpad(o_custkey % 12, 2, '0'), '.01.01') as type_id")
    b = b.unionAll(o.filter("o_orderkey % 6 = 0").selectExpr("o_orderkey", "1", "0", "cast(10 as double)", "'08.99.01.01'"))
    return corpus.labels_matched(b, p)


@query(_LABELS + " SELECT doc_id, page, col, no, top, reason, type_id FROM z")
def j4_labels_matched(spark, d):
    return _labelled(spark, d).select("doc_id", "page", "col", "no", "top", "reason", "type_id")


@query(_LABELS + " SELECT reason, count(*) AS problems, count(DISTINCT (doc_id, page)) AS pages FROM z WHERE reason IS NOT NULL GROUP BY reason")
def a11_untagged_reasons(spark, d):
    return corpus.untagged_reasons(_labelled(spark, d))


@query("""WITH t AS (SELECT '08.' || lpad((ps % 9)::VARCHAR, 2, '0') || '.' || lpad((ps % 4)::VARCHAR, 2, '0') || '.01' AS type_id, l_orderkey * 10 + l_linenumber AS seq FROM (SELECT *, l_partkey AS ps FROM lineitem))
SELECT type_id, 'type ' || type_id AS name, count(*) AS problems FROM t GROUP BY type_id ORDER BY count(*) DESC, min(seq) LIMIT 15""")
def a9_tag_counts(spark, d):
    tags = I.table(spark, d, "lineitem").selectExpr("concat('08.', lpad(l_partkey % 9, 2, '0'), '.', lpad(l_partkey % 4, 2, '0'), '.01') as type_id", "l_orderkey * 10 + l_linenumber as seq")
    types = I.table(spark, d, "part").selectExpr("concat('08.', lpad(p_partkey % 9, 2, '0'), '.', lpad(p_partkey % 4, 2, '0'), '.01') as type_id").distinct().selectExpr("type_id", "concat('type ', type_id) as name")
    return corpus.tag_counts(tags, types)


@query("""WITH x AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, '08.0' || (doc_id % 3) || '.0' || quality || '.01' AS t, '08.0' || (doc_id % 3) || '.0' || toxic || '.01' AS a, '08.01.01.01' AS b FROM labels),
s AS (SELECT confidence, (a = t)::INT AS f, (a = t OR b = t)::INT AS e, (a[1:8] = t[1:8])::INT AS c, (a[1:5] = t[1:5])::INT AS r FROM x),
g AS (SELECT confidence, count(*) AS items, sum(f) AS f, sum(e) AS e, sum(c) AS c, sum(r) AS r FROM s GROUP BY confidence UNION ALL SELECT '*', count(*), sum(f), sum(e), sum(c), sum(r) FROM s)
SELECT confidence, items, floor(f::DOUBLE / items * 10000 + 0.5) / 10000 AS first_rate, floor(e::DOUBLE / items * 10000 + 0.5) / 10000 AS either_rate, floor(c::DOUBLE / items * 10000 + 0.5) / 10000 AS chapter_rate, floor(r::DOUBLE / items * 10000 + 0.5) / 10000 AS area_rate FROM g""")
def a19_tag_evaluation(spark, d):
    rows = I.table(spark, d, "labels")
    p = rows.selectExpr("doc_id as item", "case doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence", "concat('08.0', doc_id % 3, '.0', toxic, '.01') as first_choice", "'08.01.01.01' as second_choice")
    return corpus.tag_evaluation(p, rows.selectExpr("doc_id as item", "concat('08.0', doc_id % 3, '.0', quality, '.01') as type_id"))


@query("""WITH n AS (SELECT p_partkey % 500 AS k, p_name AS name, p_partkey AS seq FROM part), o AS (SELECT DISTINCT l_suppkey AS k, 'old' AS name FROM lineitem)
SELECT k, name FROM o UNION ALL SELECT k, arg_min(name, seq) FROM n WHERE k NOT IN (SELECT k FROM o) GROUP BY k""")
def d2_d3_inserted_if_absent(spark, d):
    new = I.table(spark, d, "part").selectExpr("p_partkey % 500 as k", "p_name as name", "p_partkey as seq")
    old = I.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().withColumn("name", F.lit("old"))
    first = corpus.inserted_if_absent(old.withColumn("seq", F.lit(None).cast("long")), new, ["k"], F.col("seq"))
    return first.select("k", "name")


def _definitions(spark, d):
    p = I.table(spark, d, "part")
    return p.selectExpr("concat('08.', lpad(p_partkey % 90 div 30, 2, '0'), '.', lpad(p_partkey % 30, 2, '0'), '.', lpad(p_size % 3, 2, '0')) as id", "p_name as statement", "case when p_partkey % 50 = 0 then ' ' else p_type end as includes", "concat('not 08.01.', lpad(p_size, 2, '0'), '.01') as excludes", "concat('file', p_partkey % 3) as file")


_DEF = "def AS (SELECT '08.' || lpad((p_partkey % 90 // 30)::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 30)::VARCHAR, 2, '0') || '.' || lpad((p_size % 3)::VARCHAR, 2, '0') AS id, p_name AS statement, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_type END AS includes, 'not 08.01.' || lpad(p_size::VARCHAR, 2, '0') || '.01' AS excludes, 'file' || (p_partkey % 3) AS file, p_partkey FROM part)"


@query(f"""WITH {_DEF}, f AS (SELECT id, count(*) AS n, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM def GROUP BY id)
SELECT 'duplicate' AS kind, id, files FROM f WHERE n > 1 UNION ALL SELECT 'blank', id, array_to_string(list_sort(list(DISTINCT file)), ',') FROM def WHERE trim(includes) = '' GROUP BY id
UNION ALL SELECT 'unknown', id, files FROM f WHERE id NOT LIKE '08.01%'""")
def d9_j14_definition_errors(spark, d):
    defs = _definitions(spark, d)
    return types_.load_errors(defs, defs.select("id").distinct().filter("id like '08.01%'"))


@query(f"""WITH {_DEF}, x AS (SELECT DISTINCT id, regexp_extract(excludes, '\\d\\d\\.\\d\\d\\.\\d\\d\\.\\d\\d') AS other FROM def)
SELECT 'unknown' AS kind, id, other FROM x WHERE other <> '' AND other NOT IN (SELECT id FROM def) UNION ALL SELECT 'self', id, other FROM x WHERE id = other""")
def j16_exclude_references(spark, d):
    defs = _definitions(spark, d)
    return types_.exclude_errors(defs).distinct()


@query(f"""WITH {_DEF}, one AS (SELECT id, min(statement) AS statement, min(includes) AS includes, min(excludes) AS excludes FROM def WHERE p_partkey % 2 = 0 GROUP BY id), ids AS (SELECT DISTINCT id FROM def)
SELECT ids.id, 'name ' || ids.id AS name, coalesce(one.statement, 'old') AS statement, coalesce(one.includes, 'old') AS includes, coalesce(one.excludes, 'old') AS excludes FROM ids LEFT JOIN one USING (id)""")
def j15_definitions_applied(spark, d):
    even = I.table(spark, d, "part").filter("p_partkey % 2 = 0")
    e = even.selectExpr("concat('08.', lpad(p_partkey % 90 div 30, 2, '0'), '.', lpad(p_partkey % 30, 2, '0'), '.', lpad(p_size % 3, 2, '0')) as id", "p_name as statement", "case when p_partkey % 50 = 0 then ' ' else p_type end as includes", "concat('not 08.01.', lpad(p_size, 2, '0'), '.01') as excludes")
    one = e.groupBy("id").agg(*(F.min(c).alias(c) for c in ("statement", "includes", "excludes")))
    old = _definitions(spark, d).select("id").distinct().selectExpr("id", "concat('name ', id) as name", "'old' as statement", "'old' as includes", "'old' as excludes")
    return types_.applied(old, one)
