"""Planning, merging, notes and listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import files, merge, planning
from examlake.plans import inputs as I
from examlake.plans.catalog import query
from examlake.sources import constraints
from examlake.sources.staging import shared_folder

_DONE = f"WITH {I.PROBLEMS_SQL}, done AS (SELECT node_id, no FROM problems WHERE doc_id % 3 = 0), req AS (SELECT DISTINCT o_custkey % 30 AS node_id, (o_orderkey % 60)::INT AS no FROM orders)"


def _requested(spark, d):
    return I.table(spark, d, "orders").selectExpr("o_custkey % 30 as node_id", "cast(o_orderkey % 60 as int) as no")


@query(_DONE + " SELECT p.node_id, p.no FROM problems p SEMI JOIN req r ON r.node_id = p.node_id AND r.no = p.no ANTI JOIN done d ON d.node_id = p.node_id AND d.no = p.no")
def j5_remaining_solve(spark, d):
    p = I.problems(spark, d)
    return planning.remaining(p, p.filter("doc_id % 3 = 0"), _requested(spark, d))


@query(_DONE + " SELECT node_id, no FROM req ANTI JOIN problems USING (node_id, no)")
def j5_missing_numbers(spark, d):
    return planning.missing(I.problems(spark, d), _requested(spark, d))


@query(_DONE + " SELECT node_id, no FROM problems WHERE coalesce(transcript, '') = ''")
def j6_remaining_transcribe(spark, d):
    p = I.problems(spark, d)
    return planning.remaining(p, planning.has_transcript(p))


_VARIANTS = "v AS (SELECT l_orderkey % 25 AS node_id, l_linenumber AS no, CASE l_partkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'condition' WHEN 2 THEN 'number_condition' ELSE 'zz' END AS mode FROM lineitem)"


def _variants(spark, d):
    return I.table(spark, d, "lineitem").selectExpr("l_orderkey % 25 as node_id", "l_linenumber as no", "case l_partkey % 4 when 0 then 'number' when 1 then 'condition' when 2 then 'number_condition' else 'zz' end as mode", "l_orderkey * 100000 + l_partkey as seq", "l_suppkey")


@query(f"WITH {I.PROBLEMS_SQL}, {_VARIANTS} SELECT node_id, no, mode FROM (SELECT node_id, no, mode FROM problems, (VALUES ('number'), ('condition')) m(mode)) p ANTI JOIN (SELECT * FROM v WHERE node_id % 2 = 0) w USING (node_id, no, mode)")
def j7_remaining_variants(spark, d):
    return planning.remaining_variants(I.problems(spark, d), ["number", "condition"], _variants(spark, d).filter("node_id % 2 = 0"))


@query(f"""WITH {I.JOBS_SQL}, q AS (SELECT job_id AS request_id, node_id, kind, targets, modes FROM jobs WHERE job_id % 5 = 0)
SELECT q.request_id, node_id, kind, arg_min(j.job_id, (j.created_at, j.job_id)) AS job_id FROM q LEFT JOIN (SELECT job_id, node_id, kind, targets AS t, modes AS m, created_at FROM jobs WHERE status IN ('queued', 'running')) j USING (node_id, kind)
WHERE j.job_id IS NULL OR kind = 'ocr' OR ((targets IS NULL OR t IS NULL OR list_has_any(targets, t)) AND (kind <> 'variant' OR modes IS NULL OR m IS NULL OR list_has_any(modes, m))) GROUP BY ALL
UNION ALL SELECT request_id, node_id, kind, NULL FROM q WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.node_id = q.node_id AND j.kind = q.kind AND j.status IN ('queued', 'running')) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.node_id = q.node_id AND j.kind = q.kind AND j.status IN ('queued', 'running') AND (q.kind = 'ocr' OR ((q.targets IS NULL OR j.targets IS NULL OR list_has_any(q.targets, j.targets)) AND (q.kind <> 'variant' OR q.modes IS NULL OR j.modes IS NULL OR list_has_any(q.modes, j.modes)))))""")
def j8_overlapping_jobs(spark, d):
    jobs = I.jobs(spark, d)
    q = jobs.filter("job_id % 5 = 0").selectExpr("job_id as request_id", "node_id", "kind", "targets", "modes")
    return planning.overlapping_job(q, jobs).select("request_id", "node_id", "kind", "job_id")


@query(f"WITH {I.JOBS_SQL} SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, CASE WHEN status = 'done' THEN current_no END AS current_no FROM jobs")
def d10_interrupted_jobs(spark, d):
    return planning.interrupted(I.jobs(spark, d)).select("job_id", "status", "current_no")


@query(f"WITH {I.JOBS_SQL} SELECT job_id, status FROM jobs WHERE status = 'done' ORDER BY created_at DESC, job_id DESC LIMIT 10")
def o2_recent_finished(spark, d):
    return planning.recent_finished(I.jobs(spark, d).withColumnRenamed("created_at", "updated_at")).select("job_id", "status")


@query(f"WITH {_VARIANTS}, u AS (SELECT DISTINCT * FROM v) SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY no, CASE mode WHEN 'number' THEN 1 WHEN 'condition' THEN 2 WHEN 'number_condition' THEN 3 ELSE 99 END, mode) AS place FROM u")
def o1_ordered_variants(spark, d):
    v = _variants(spark, d).select("node_id", "no", "mode").distinct()
    return planning.ordered_variants(v).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {I.PROBLEMS_SQL}, {_VARIANTS}, k AS (SELECT node_id, no, count(DISTINCT mode) AS kinds FROM v GROUP BY ALL) SELECT node_id, count(*) AS problems, count(kinds) AS with_any, coalesce(sum(kinds), 0)::BIGINT AS kinds_done FROM problems LEFT JOIN k USING (node_id, no) GROUP BY node_id")
def a13_variant_progress(spark, d):
    return planning.variant_progress(I.problems(spark, d), _variants(spark, d))


@query(f"WITH {I.PROBLEMS_SQL} SELECT node_id, count(*) FILTER (coalesce(transcript, '') <> '') AS transcribed, coalesce(array_to_string(list_sort(list(no) FILTER (coalesce(transcript, '') = '')), ','), '') AS open_numbers, bool_and(coalesce(transcript, '') <> '') AS all_done FROM problems GROUP BY node_id")
def a13_transcript_progress(spark, d):
    p = planning.transcript_progress(I.problems(spark, d))
    return p.withColumn("open_numbers", F.array_join(F.transform("open_numbers", lambda x: x.cast("string")), ","))


@query("""WITH v AS (SELECT l_orderkey % 25 AS node_id, l_linenumber AS no, CASE l_partkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'condition' WHEN 2 THEN 'number_condition' ELSE 'zz' END AS mode, l_orderkey * 100000 + l_partkey AS seq, l_suppkey, l_suppkey % 2 AS new FROM lineitem),
a AS (SELECT node_id, no, mode, max((new, seq, l_suppkey)) AS x FROM v GROUP BY ALL) SELECT node_id, no, mode, x[2] AS seq FROM a""")
def d4_upserted_variants(spark, d):
    v = _variants(spark, d)
    out = merge.upserted(v.filter("l_suppkey % 2 = 0"), v.filter("l_suppkey % 2 = 1"), ["node_id", "no", "mode"])
    return out.select("node_id", "no", "mode", "seq")


@query(f"""WITH {I.PROBLEMS_SQL}, u AS (SELECT node_id, no, CASE doc_id % 7 WHEN 0 THEN 'new ' || doc_id WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN repeat('x', 20001) ELSE 'ai ' || doc_id END AS ut, CASE doc_id % 7 WHEN 0 THEN 'manual' WHEN 1 THEN 'manual' WHEN 2 THEN NULL ELSE 'ai' END AS us, 'note' AS un FROM problems WHERE doc_id % 2 = 0),
j AS (SELECT p.*, ut, us, un, CASE WHEN un IS NULL OR length(ut) > 20000 OR (transcript_source = 'manual' AND coalesce(us, '') <> 'manual') THEN 'keep' WHEN us = 'manual' AND trim(coalesce(ut, '')) = '' THEN 'clear' WHEN ut IS NULL THEN 'note' ELSE 'write' END AS action FROM problems p LEFT JOIN u USING (node_id, no))
SELECT doc_id, action, sha256(CASE action WHEN 'write' THEN ut WHEN 'clear' THEN NULL ELSE transcript END) AS transcript_sha, CASE action WHEN 'write' THEN us WHEN 'clear' THEN NULL ELSE transcript_source END AS transcript_source, CASE action WHEN 'write' THEN un WHEN 'note' THEN un END AS transcript_note FROM j""")
def d5_merged_transcripts(spark, d):
    p = I.problems(spark, d).withColumn("transcript_note", F.lit(None).cast("string"))
    u = p.filter("doc_id % 2 = 0").selectExpr("node_id", "no", "case doc_id % 7 when 0 then concat('new ', doc_id) when 1 then ' ' when 2 then null when 3 then repeat('x', 20001) else concat('ai ', doc_id) end as u_transcript", "case doc_id % 7 when 0 then 'manual' when 1 then 'manual' when 2 then null else 'ai' end as u_source", "'note' as u_note")
    return merge.merged_transcripts(p, u).select("doc_id", "action", F.sha2("transcript", 256).alias("transcript_sha"), "transcript_source", "transcript_note")


@query(f"""WITH {I.PROBLEMS_SQL}, r AS (SELECT DISTINCT o_custkey % 5 AS note_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 30 END AS source_node_id, (o_orderkey % 60)::INT AS no FROM orders), i AS (SELECT node_id % 5 AS note_id, CASE WHEN doc_id % 3 > 0 THEN node_id END AS source_node_id, no FROM problems WHERE doc_id % 2 = 0)
SELECT r.note_id, r.source_node_id, r.no, CASE WHEN p.doc_id IS NULL THEN 'unknown' WHEN i.no IS NOT NULL THEN 'skipped' ELSE 'added' END AS outcome, CASE WHEN p.doc_id IS NOT NULL AND i.no IS NULL THEN p.label END AS label FROM r LEFT JOIN problems p ON p.node_id = r.source_node_id AND p.no = r.no LEFT JOIN i ON i.note_id = r.note_id AND i.source_node_id = r.source_node_id AND i.no = r.no""")
def d6_added_note_items(spark, d):
    p = I.problems(spark, d).withColumn("name", F.lit("exam"))
    req = I.table(spark, d, "orders").selectExpr("o_custkey % 5 as note_id", "case when o_orderkey % 3 > 0 then o_custkey % 30 end as source_node_id", "cast(o_orderkey % 60 as int) as no")
    items = p.filter("doc_id % 2 = 0").selectExpr("node_id % 5 as note_id", "case when doc_id % 3 > 0 then node_id end as source_node_id", "no")
    return merge.added_items(items, req, p).select("note_id", "source_node_id", "no", "outcome", "label")


@query(f"WITH {I.PROBLEMS_SQL}, {_VARIANTS}, f AS (SELECT DISTINCT node_id FROM problems WHERE node_id % 4 = 0) SELECT f.node_id, coalesce(s.n, 0) AS solutions_dropped, coalesce(w.n, 0) AS variants_dropped FROM f LEFT JOIN (SELECT node_id, count(*) AS n FROM problems WHERE doc_id % 3 = 0 GROUP BY 1) s USING (node_id) LEFT JOIN (SELECT node_id, count(*) AS n FROM v GROUP BY 1) w USING (node_id)")
def d7_re_extracted(spark, d):
    p = I.problems(spark, d)
    tables = {"problems": p, "solutions": p.filter("doc_id % 3 = 0"), "variants": _variants(spark, d)}
    return merge.re_extracted(tables, p.filter("node_id % 4 = 0").select("node_id"), p.filter("node_id % 4 = 0"))[1]


@query(f"""WITH {I.PROBLEMS_SQL}, i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS source_node_id, l_linenumber AS no, l_partkey FROM lineitem), n AS (SELECT DISTINCT node_id FROM problems WHERE node_id % 3 > 0)
SELECT i.id, i.l_partkey, n.node_id IS NOT NULL AS alive, CASE WHEN n.node_id IS NOT NULL THEN sha256(nullif(trim(regexp_replace(regexp_replace(regexp_replace(p.raw_text, '^\\s*\\d{{1,2}}\\s*\\.\\s*', ''), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10)), '')) END AS text_sha
FROM i LEFT JOIN n ON n.node_id = i.source_node_id LEFT JOIN problems p ON p.node_id = i.source_node_id AND p.no = i.no""")
def j10_note_details(spark, d):
    p = I.problems(spark, d)
    items = I.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_suppkey as source_node_id", "l_linenumber as no", "l_partkey")
    nodes = p.filter("node_id % 3 > 0").select("node_id").distinct()
    out = merge.note_detail(items, nodes, p.select("node_id", "no", F.col("raw_text").alias("text")), lambda t: F.sha2(T.cleaned(t), 256))
    return out.select("id", "l_partkey", "alive", F.col("text").alias("text_sha"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, 'exam' AS section, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::VARCHAR ELSE 'L' || l_linenumber END AS label, NULL::VARCHAR AS transcript FROM lineitem")
def s7_back_filled(spark, d):
    old = I.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber as no", "if(l_partkey % 2 = 0, '', null) as section", "if(l_linenumber % 2 = 0, '', concat('L', l_linenumber)) as label")
    return merge.back_filled(old, {"section": "string", "label": "string", "transcript": "string"}).drop("no")


_FILES = "files AS (SELECT 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 50 END AS pages, c_custkey % 30 AS problem_count, CASE WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'image' END AS mode, (c_custkey % 4) / 4.0 AS pua_ratio FROM customer)"


@query(f"WITH {I.NODES_SQL}, {_FILES} SELECT n.node_id, n.type, n.name, n.section, pages, CASE WHEN pages IS NOT NULL THEN problem_count END AS problem_count, CASE WHEN pages IS NOT NULL THEN mode END AS mode FROM nodes n LEFT JOIN files f ON f.node_id = n.node_id AND n.type = 'file'")
def j1_node_list(spark, d):
    f = I.table(spark, d, "customer").selectExpr("concat('c', c_custkey) as node_id", "if(c_custkey % 3 > 0, c_custkey % 50, null) as pages", "c_custkey % 30 as problem_count", "if(c_custkey % 2 = 0, 'text', 'image') as mode", "(c_custkey % 4) / 4.0 as pua_ratio")
    return files.node_list(I.nodes(spark, d), f).select("node_id", "type", "name", "section", "file.pages", "file.problem_count", "file.mode")


@query(f"WITH {I.PROBLEMS_SQL} SELECT node_id, no, coalesce(label, no::VARCHAR) AS label, doc_id % 3 = 0 AS has_solution, coalesce(transcript, '') <> '' AS has_transcript, transcript_source FROM problems")
def j2_file_details(spark, d):
    p = I.problems(spark, d)
    solutions = p.filter("doc_id % 3 = 0")
    return files.file_details(p, solutions.unionAll(solutions)).select("node_id", "no", "label", "has_solution", "has_transcript", "transcript_source")


@query(f"WITH {I.PROBLEMS_SQL}, n AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'cut off' WHEN doc_id % 4 = 2 THEN '' END AS note FROM problems) SELECT node_id, no, sha256(transcript) AS transcript_sha, transcript_source, note AS transcript_note FROM n WHERE coalesce(transcript, '') <> '' OR coalesce(note, '') <> ''")
def p29_transcript_list(spark, d):
    p = I.problems(spark, d).withColumn("transcript_note", F.expr("case doc_id % 4 when 1 then 'cut off' when 2 then '' end"))
    return files.transcript_list(p).select("node_id", "no", F.sha2("transcript", 256).alias("transcript_sha"), "transcript_source", "transcript_note")


@query(f"WITH {I.PROBLEMS_SQL}, i AS (SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS item_id, CASE WHEN l_partkey % 5 > 0 THEN l_suppkey END AS source_node_id, l_linenumber AS no FROM lineitem) SELECT item_id, 'solution ' || doc_id AS solution FROM i JOIN problems p ON p.node_id = i.source_node_id AND p.no = i.no WHERE p.node_id % 3 > 0 AND p.doc_id % 3 = 0")
def j11_note_solutions(spark, d):
    p = I.problems(spark, d)
    items = I.table(spark, d, "lineitem").selectExpr("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as item_id", "if(l_partkey % 5 > 0, l_suppkey, null) as source_node_id", "l_linenumber as no")
    return files.note_solutions(items, p.filter("node_id % 3 > 0").select("node_id"), p.filter("doc_id % 3 = 0").selectExpr("node_id", "no", "concat('solution ', doc_id) as solution"))


@query(f"WITH {I.PROBLEMS_SQL}, {_VARIANTS} SELECT v.node_id, v.no, v.mode, coalesce(p.label, '') AS label, count(*) AS variants FROM v LEFT JOIN problems p ON p.node_id = v.node_id AND p.no = v.no GROUP BY ALL")
def j12_labelled_variants(spark, d):
    out = files.labelled_variants(_variants(spark, d), I.problems(spark, d))
    return out.groupBy("node_id", "no", "mode", "label").agg(F.count("*").alias("variants"))


@query("SELECT o_custkey % 50 AS note_id, o_orderdate AS created_at, o_orderkey AS seq FROM orders")
def o3_note_items(spark, d):
    return files.note_items(I.table(spark, d, "orders").selectExpr("o_custkey % 50 as note_id", "o_orderdate as created_at", "o_orderkey as seq"))


@query("SELECT lpad((p_partkey % 90)::VARCHAR, 2, '0') || '.' || p_partkey AS id, p_name AS name FROM part")
def o5_type_dictionary(spark, d):
    return files.type_dictionary(I.table(spark, d, "part").selectExpr("concat(lpad(p_partkey % 90, 2, '0'), '.', p_partkey) as id", "p_name as name"))


#: Messages as lines of JSON: some cut off, some without a role, some with an id of others, some of conversations that are not there.
_MESSAGES = """m AS (SELECT 'm' || conv_id || '-' || CASE WHEN conv_id % 19 = 0 THEN turn // 2 ELSE turn END AS id, 'v' || conv_id AS conversation_id, CASE WHEN (conv_id * 7 + turn) % 17 <> 0 THEN role END AS role, text AS content, turn AS created_at, (conv_id + turn) % 13 = 0 AS cut, conv_id FROM conversations),
f AS (SELECT *, CASE WHEN cut THEN 'unreadable' WHEN role IS NULL OR content IS NULL THEN 'missing' WHEN conv_id % 23 = 0 THEN 'no_parent' END AS why FROM m),
k AS (SELECT id, conversation_id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY id, why ORDER BY role, content, created_at) > 1 THEN 'repeated_key' END, 'good') AS outcome FROM f)"""


@query(f"""WITH {_MESSAGES}, o AS (SELECT outcome, CASE WHEN outcome <> 'unreadable' THEN conversation_id END AS conversation_id, CASE WHEN outcome <> 'unreadable' THEN id END AS id FROM k)
SELECT outcome, conversation_id, count(*) AS n_rows, min(id) AS first_id FROM o GROUP BY outcome, conversation_id""")
def s1_checked_messages(spark, d):
    m = I.table(spark, d, "conversations").selectExpr("concat('m', conv_id, '-', if(conv_id % 19 = 0, turn div 2, turn)) as id", "concat('v', conv_id) as conversation_id", "if((conv_id * 7 + turn) % 17 <> 0, role, null) as role", "text as content", "cast(turn as string) as created_at", "(conv_id + turn) % 13 = 0 as cut")
    line = F.to_json(F.struct("id", "conversation_id", "role", "content", "created_at"))
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    m.select("cut", line.alias("line")).selectExpr("if(cut, left(line, length(line) - 2), line) as value").write.text(path)
    there = I.table(spark, d, "conversations").filter("conv_id % 23 <> 0").selectExpr("concat('v', conv_id) as id")
    good, rejects = constraints.load(spark, "conversation_messages", path, "json", {"conversations": there})
    of = lambda c: F.when(F.col("reason") != "unreadable", F.get_json_object("row", f"$.{c}")).alias(c)
    both = good.select(F.lit("good").alias("outcome"), "conversation_id", "id", F.lit(1).cast("long").alias("copies")).unionByName(rejects.select(F.col("reason").alias("outcome"), of("conversation_id"), of("id"), "copies"))
    return both.groupBy("outcome", "conversation_id").agg(F.sum("copies").alias("n_rows"), F.min("id").alias("first_id"))
