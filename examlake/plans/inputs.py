"""The library's tables derived from the driver's, by one rule written for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Problems: documents with a printed number before the text, some with two, and their kind of delimiter.
RAW_TEXT = "concat(cast(doc_id % 40 + 1 as string), case when doc_id % 2 = 0 then '. ' else ') ' end, case when doc_id % 7 = 0 then '3. ' else '' end, text)"
PROBLEMS_SQL = """problems AS (SELECT doc_id, source, text, doc_id // 40 AS node_id, (doc_id % 40 + 1)::INT AS no,
  (doc_id % 40 + 1)::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ') ' END || CASE WHEN doc_id % 7 = 0 THEN '3. ' ELSE '' END || text AS raw_text,
  CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '' END AS transcript,
  CASE WHEN doc_id % 6 = 0 THEN 'manual' WHEN doc_id % 3 = 0 THEN 'ai' END AS transcript_source,
  CASE WHEN doc_id % 5 = 0 THEN 'E-' || doc_id END AS label FROM documents)"""


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "text", "doc_id div 40 as node_id", "cast(doc_id % 40 + 1 as int) as no", f"{RAW_TEXT} as raw_text",
        "case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then '' end as transcript",
        "case when doc_id % 6 = 0 then 'manual' when doc_id % 3 = 0 then 'ai' end as transcript_source",
        "case when doc_id % 5 = 0 then concat('E-', doc_id) end as label",
    )


HASH_SQL = r"""sha256(regexp_replace(regexp_replace(raw_text, '^(\s*\d+[.)]\s*){1,3}', ''), '\s+', '', 'g'))"""

#: Calls with usage in all its forms: none, broken, as a text, as a number, by fields, no object, empty.
USAGE_SQL = """usage AS (SELECT event_id, event_type AS origin, ts, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'broken{' WHEN 2 THEN '{"total_tokens": "' || k || '0.7"}'
  WHEN 3 THEN '{"total_tokens": ' || k || '}' WHEN 4 THEN '{"input_tokens": ' || k || ', "output_tokens": "' || k || '", "thinking_tokens": true, "total_tokens": "x"}' WHEN 5 THEN '[1]' ELSE '{}' END AS usage_json
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)),
tokens AS (SELECT *, CASE WHEN usage_json IS NULL OR NOT json_valid(usage_json) OR json_type(usage_json) <> 'OBJECT' THEN NULL ELSE
  coalesce(trunc(try_cast(json_extract_string(usage_json, '$.total_tokens') AS DOUBLE))::BIGINT,
    coalesce(trunc(try_cast(json_extract_string(usage_json, '$.input_tokens') AS DOUBLE))::BIGINT, 0) + coalesce(trunc(try_cast(json_extract_string(usage_json, '$.output_tokens') AS DOUBLE))::BIGINT, 0)) END AS tokens FROM usage)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.selectExpr("event_id", "event_type as origin", "ts as at", """case event_id % 7 when 0 then null when 1 then 'broken{' when 2 then concat('{"total_tokens": "', k, '0.7"}')
      when 3 then concat('{"total_tokens": ', k, '}') when 4 then concat('{"input_tokens": ', k, ', "output_tokens": "', k, '", "thinking_tokens": true, "total_tokens": "x"}') when 5 then '[1]' else '{}' end as usage_json""")


#: Priced calls: models of a price list, by dated names, some unknown.
CALLS_SQL = """calls AS (SELECT event_id, user_id, (CASE event_id % 5 WHEN 0 THEN 'large-5' WHEN 1 THEN 'large-5-20260101' WHEN 2 THEN 'small-4' WHEN 3 THEN 'small-4-mini-20260101' ELSE 'other' END) AS model,
  k AS input_tokens, k * 3 AS output_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE k * 7 END AS cache_write_tokens, k * 11 AS cache_read_tokens, event_type <> 'error' AS ok
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
rates(model_key, input, output) AS (VALUES ('large-5', 5.00, 25.00), ('small-4', 3.00, 15.00), ('small-4-mini', 1.00, 5.00)),
costs AS (SELECT c.*, round((coalesce(input_tokens, 0) * r.input + coalesce(output_tokens, 0) * r.output + coalesce(cache_write_tokens, 0) * r.input * 1.25 + coalesce(cache_read_tokens, 0) * r.input * 0.10)::DECIMAL(24,4) * 0.000001::DECIMAL(7,6), 8) AS usd
  FROM calls c JOIN rates r ON r.model_key = (SELECT model_key FROM rates x WHERE starts_with(c.model, x.model_key) ORDER BY length(model_key) DESC LIMIT 1))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr("event_id", "user_id", "case event_id % 5 when 0 then 'large-5' when 1 then 'large-5-20260101' when 2 then 'small-4' when 3 then 'small-4-mini-20260101' else 'other' end as model",
        "k as input_tokens", "k * 3 as output_tokens", "case when event_id % 3 = 0 then null else k * 7 end as cache_write_tokens", "k * 11 as cache_read_tokens", "event_type <> 'error' as ok")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("large-5", "5.00", "25.00"), ("small-4", "3.00", "15.00"), ("small-4-mini", "1.00", "5.00")], "model_key string, input string, output string").selectExpr("model_key", "cast(input as decimal(8,2)) as input", "cast(output as decimal(8,2)) as output")


#: Chat messages: turns of conversations; every third thread is a whole-exam one.
CHAT_SQL = "chat AS (SELECT conv_id, conv_id // 4 AS node_id, CASE WHEN conv_id % 3 <> 0 THEN conv_id % 4 END AS problem_no, turn AS created_at, conv_id * 1000 + turn AS seq, role, text AS content FROM conversations)"


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "conv_id div 4 as node_id", "case when conv_id % 3 <> 0 then conv_id % 4 end as problem_no", "turn as created_at", "conv_id * 1000 + turn as seq", "role", "text as content")


#: Nodes: regions and nations are folders, suppliers folders, customers files; a nation's parent may be missing.
NODES_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node_id, 'folder' AS type, NULL AS parent_id, r_name AS name, 'exam' AS section FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'folder', CASE WHEN n_nationkey = 7 THEN 'gone' ELSE 'r' || n_regionkey END, n_name, 'exam' FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'folder', 'n' || s_nationkey, s_name, CASE WHEN s_suppkey % 10 = 0 THEN 'note' ELSE 'exam' END FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'file', CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE 's' || (c_custkey % (SELECT count(*) FROM supplier)) END, c_name, 'exam' FROM customer)"""
UP_SQL = """RECURSIVE_UP AS (SELECT n.node_id, n.node_id AS ancestor_id, 0 AS distance FROM nodes n
  UNION ALL SELECT u.node_id, p.node_id, u.distance + 1 FROM RECURSIVE_UP u JOIN nodes n ON n.node_id = u.ancestor_id JOIN nodes p ON p.node_id = n.parent_id)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    n = t("supplier").agg(F.count("*").alias("n_suppliers"))
    out = t("region").selectExpr("concat('r', r_regionkey) as node_id", "'folder' as type", "cast(null as string) as parent_id", "r_name as name", "'exam' as section")
    out = out.unionAll(t("nation").selectExpr("concat('n', n_nationkey)", "'folder'", "case when n_nationkey = 7 then 'gone' else concat('r', n_regionkey) end", "n_name", "'exam'"))
    out = out.unionAll(t("supplier").selectExpr("concat('s', s_suppkey)", "'folder'", "concat('n', s_nationkey)", "s_name", "case when s_suppkey % 10 = 0 then 'note' else 'exam' end"))
    files = t("customer").crossJoin(F.broadcast(n))  # one row
    return out.unionAll(files.selectExpr("concat('c', c_custkey)", "'file'", "case when c_custkey % 2 = 0 then concat('n', c_nationkey) else concat('s', c_custkey % n_suppliers) end", "c_name", "'exam'"))


#: Number chains: line numbers of orders, in an order without ties.
ANCHORS_SQL = "anchors AS (SELECT l_orderkey AS doc_id, l_linenumber AS no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS pos FROM lineitem)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as no", "row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) as pos")


#: Page lines: boxes from the keys, by integer arithmetic; two columns of three pages.
LINES_SQL = """lines AS (SELECT l_suppkey AS doc_id, (l_partkey % 3 + 1)::INT AS page, (CASE WHEN l_partkey % 5 < 3 THEN 0 ELSE 1 END)::INT AS col, l_linenumber AS no,
  CASE WHEN l_partkey % 5 < 3 THEN 85 ELSE 353 END + (l_orderkey % 9) * 2.5 AS x0, (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 800 + 0.5 AS y0, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS text FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as doc_id", "cast(l_partkey % 3 + 1 as int) as page", "case when l_partkey % 5 < 3 then 0 else 1 end as col", "l_linenumber as no",
        "cast(case when l_partkey % 5 < 3 then 85 else 353 end + (l_orderkey % 9) * 2.5 as double) as x0", "cast((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 800 + 0.5 as double) as y0", "concat_ws('-', l_orderkey, l_linenumber, l_partkey) as text")


#: Jobs: orders, with the line numbers as targets; every fourth asks for all.
JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS node_id, CASE o_orderkey % 3 WHEN 0 THEN 'solve' WHEN 1 THEN 'variant' ELSE 'ocr' END AS kind, CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'done' END AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN t END AS targets, CASE WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN ['number'] ELSE ['number', 'condition'] END END AS modes, o_orderdate AS created_at, (o_orderkey % 9)::INT AS current_no
  FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS t FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("t"))
    return table(spark, sf_dir, "orders").join(t, "o_orderkey", "left").selectExpr("o_orderkey as job_id", "o_custkey as node_id", "case o_orderkey % 3 when 0 then 'solve' when 1 then 'variant' else 'ocr' end as kind", "case o_orderstatus when 'P' then 'queued' when 'O' then 'running' else 'done' end as status",
        "case when o_orderkey % 4 <> 0 then t end as targets", "case when o_orderkey % 3 = 1 then case when o_orderkey % 2 = 0 then array('number') else array('number', 'condition') end end as modes", "o_orderdate as created_at", "cast(o_orderkey % 9 as int) as current_no")


#: Job events: events of a user are a job's, in order; some ends of every kind and some snapshots. ``k`` is in the data under the names that the event has.
EVENTS_SQL = """ev AS (SELECT user_id AS job_id, event_id AS seq, k, CASE event_type WHEN 'signup' THEN CASE WHEN k % 7 = 0 THEN 'snapshot' ELSE 'start' END WHEN 'view' THEN 'problem' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'done' ELSE CASE WHEN k % 5 = 0 THEN 'end' ELSE 'error' END END AS event,
  CASE k % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'canceled' WHEN 2 THEN 'error' END AS end_status FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr(
        "user_id as job_id", "event_id as seq", "k",
        "case event_type when 'signup' then if(k % 7 = 0, 'snapshot', 'start') when 'view' then 'problem' when 'click' then 'delta' when 'purchase' then 'done' else if(k % 5 = 0, 'end', 'error') end as event")
    data = """case event when 'start' then concat('{"total": ', k, '}') when 'problem' then concat('{"no": ', k, if(k % 2 = 0, ', "route": "pua"', ''), '}') when 'delta' then concat('{"no": ', k, ', "text": "', k, ';"}')
      when 'done' then concat('{"no": ', k, if(k % 3 = 0, ', "transcript": null, "note": "n"', if(k % 3 = 1, concat(', "transcript": "t', k, '", "source": "ai"'), '')), '}') when 'error' then concat('{"no": ', k, if(k % 3 = 0, '', concat(', "message": "', k, ';"')), '}')
      when 'end' then if(k % 4 = 3, '', concat('{"status": "', elt(k % 4 + 1, 'done', 'canceled', 'error'), '"', if(k % 4 = 2, concat(', "message": "failed ', k, '"'), ''), '}'))
      else concat('{"status": "running", "total": ', k, ', "done_count": ', k % 4, ', "current_no": ', k % 6, ', "partial_text": "s', k, '"}') end"""
    return e.selectExpr("job_id", "seq", "event", f"{data} as data")
