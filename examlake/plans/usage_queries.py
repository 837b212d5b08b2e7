"""Usage, costs, threads and job progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.operators import threads, usage
from examlake.plans import inputs as I
from examlake.plans.catalog import query
from examlake.streaming import jobs, progress

NOW = "timestamp '2024-01-20 00:00:00'"


@query(f"WITH {I.USAGE_SQL} SELECT event_id, tokens FROM tokens WHERE tokens IS NOT NULL")
def s2_a1_usage_tokens(spark, d):
    return I.usage(spark, d).select("event_id", usage.usage_tokens(F.col("usage_json")).alias("tokens")).filter("tokens is not null")


@query(f"""WITH {I.USAGE_SQL}, c AS (SELECT tokens, CASE WHEN event_id % 13 <> 0 THEN ts END AS t FROM tokens WHERE tokens IS NOT NULL)
SELECT coalesce(sum(tokens) FILTER (t >= {NOW} - INTERVAL 24 HOUR), 0)::BIGINT AS tokens_day, count(*) FILTER (t >= {NOW} - INTERVAL 24 HOUR) AS calls_day, coalesce(sum(tokens) FILTER (t >= {NOW} - INTERVAL 7 DAY), 0)::BIGINT AS tokens_week,
count(*) FILTER (t >= {NOW} - INTERVAL 7 DAY) AS calls_week, sum(tokens)::BIGINT AS tokens_total, count(*) AS calls_total FROM c""")
def a2_usage_summary(spark, d):
    u = I.usage(spark, d).withColumn("at", F.expr("case when event_id % 13 <> 0 then at end"))
    parts = [u.filter(F.col("origin").isin("view", "click")), u.filter(F.col("origin") == "signup"), u.filter(F.col("origin").isin("purchase", "error"))]
    return usage.usage_summary(parts, F.expr(NOW))


@query(f"WITH {I.USAGE_SQL} SELECT origin, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM tokens WHERE tokens IS NOT NULL GROUP BY origin")
def x5_usage_totals(spark, d):
    return progress.usage_totals(I.usage(spark, d))


@query(f"WITH {I.CALLS_SQL} SELECT event_id, model, usd::DOUBLE AS usd, round(usd * 1400, 4)::DOUBLE AS krw FROM costs")
def a3_j9_call_costs(spark, d):
    known, _ = usage.priced(I.calls(spark, d), I.rates(spark))
    return known.select("event_id", "model", F.col("usd").cast("double").alias("usd"), F.col("krw").cast("double").alias("krw"))


@query(f"WITH {I.CALLS_SQL} SELECT event_id, model FROM calls WHERE model = 'other'")
def j9_unknown_models(spark, d):
    _, unknown = usage.priced(I.calls(spark, d), I.rates(spark))
    return unknown.select("event_id", "model")


@query(f"""WITH {I.CALLS_SQL}, g AS (SELECT model, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(cache_write_tokens, 0))::BIGINT AS cache_write_tokens, sum(coalesce(cache_read_tokens, 0))::BIGINT AS cache_read_tokens,
count(*) AS calls, count(*) FILTER (ok) AS solved, count(*) FILTER (usd > 0) AS billed, sum(usd)::DOUBLE AS usd FROM costs GROUP BY model), m AS (SELECT *, CASE WHEN billed > 0 THEN usd / billed ELSE 0 END AS mean FROM g)
SELECT model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens, calls, solved, billed, usd, floor(mean * 1e8 + 0.5) / 1e8 AS mean_usd, floor(mean * 22 * 1e4 + 0.5) / 1e4 AS projected_usd FROM m""")
def a4_call_set_totals(spark, d):
    known, _ = usage.priced(I.calls(spark, d), I.rates(spark))
    return usage.call_set_totals(known, "model", F.lit(22))


@query(f"""WITH {I.CALLS_SQL}, a AS (SELECT c.user_id, c.input_tokens + c.output_tokens AS tokens, x.usd FROM calls c LEFT JOIN costs x USING (event_id))
SELECT user_id, count(*) FILTER (usd IS NULL) AS subscription_calls, coalesce(sum(tokens) FILTER (usd IS NULL), 0)::BIGINT AS subscription_tokens, count(usd) AS billed_calls, coalesce(sum(usd), 0)::DOUBLE AS usd FROM a GROUP BY user_id""")
def a5_session_totals(spark, d):
    known, unknown = usage.priced(I.calls(spark, d), I.rates(spark))
    tokens = (F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    rows = known.select("user_id", tokens, "usd").unionAll(unknown.select("user_id", tokens, F.lit(None).cast("decimal(20,8)")))
    return usage.session_totals(rows, "user_id")


@query("""WITH e AS (SELECT doc_id // 40 AS exam, count(*) AS problems FROM documents GROUP BY ALL), m AS (SELECT *, CASE exam % 3 WHEN 0 THEN 'large-5' WHEN 1 THEN 'small-4' ELSE 'other' END AS model FROM e)
SELECT exam, model, problems, (CASE model WHEN 'large-5' THEN 0.03675 WHEN 'small-4' THEN 0.02205 END::DECIMAL(10,6) * problems)::DOUBLE AS usd FROM m""")
def a6_exam_estimates(spark, d):
    e = I.table(spark, d, "documents").groupBy(F.expr("doc_id div 40").alias("exam")).agg(F.count("*").alias("problems"))
    return usage.exam_estimate(e.withColumn("model", F.expr("case exam % 3 when 0 then 'large-5' when 1 then 'small-4' else 'other' end")), I.rates(spark))


@query(f"WITH {I.CHAT_SQL} SELECT node_id, problem_no, count(*) AS turns, max(created_at) AS last_at, greatest(count(*) - 20, 0) AS truncated FROM chat GROUP BY node_id, problem_no")
def a7_a8_chat_threads(spark, d):
    return threads.thread_list(I.chat(spark, d))


@query(f"WITH {I.CHAT_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY node_id, problem_no ORDER BY created_at DESC, seq DESC) AS back FROM chat) SELECT node_id, problem_no, seq, role, row_number() OVER (PARTITION BY node_id, problem_no ORDER BY back DESC) AS place FROM b WHERE back <= 20")
def w19_last_messages(spark, d):
    return threads.last_messages(I.chat(spark, d)).select("node_id", "problem_no", "seq", "role", F.col("place").cast("long").alias("place"))


@query(f"WITH {I.CHAT_SQL}, c AS (SELECT DISTINCT conv_id FROM chat UNION ALL SELECT -1), l AS (SELECT conv_id, arg_max(content, created_at) AS t FROM chat GROUP BY conv_id) SELECT conv_id, trim(regexp_replace(t, '\\s+', ' ', 'g'))[1:60] AS preview FROM c LEFT JOIN l USING (conv_id)")
def w18_p25_conversation_list(spark, d):
    chat = I.chat(spark, d)
    convs = chat.select("conv_id").distinct().unionAll(spark.range(1).selectExpr("cast(-1 as bigint)"))
    return threads.conversation_list(convs, chat)


@query(f"WITH {I.CHAT_SQL}, c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'kept' ELSE 'new' END AS title FROM chat), l AS (SELECT conv_id, arg_min(content, created_at) AS t FROM chat GROUP BY conv_id) SELECT conv_id, CASE WHEN title = 'new' THEN coalesce(nullif(trim(regexp_replace(t, '\\s+', ' ', 'g'))[1:30], ''), 'new') ELSE title END AS title FROM c LEFT JOIN l USING (conv_id)")
def w20_auto_titles(spark, d):
    chat = I.chat(spark, d)
    return threads.auto_titles(chat.select("conv_id").distinct().withColumn("title", F.expr("case when conv_id % 4 = 0 then 'kept' else 'new' end")), chat, "new")


@query(f"""WITH {I.CHAT_SQL}, {I.PROBLEMS_SQL}, s AS (SELECT node_id, count(*) AS n FROM problems GROUP BY node_id)
SELECT chat.seq, sha256(CASE WHEN chat.problem_no IS NULL THEN 'problems: ' || coalesce(s.n, 0) ELSE coalesce(p.text, '') || CASE WHEN p.text IS NOT NULL AND p.doc_id % 2 = 0 THEN chr(10) || 'solution ' || p.doc_id ELSE '' END END) AS context_sha
FROM chat LEFT JOIN problems p ON p.node_id = chat.node_id AND p.no = chat.problem_no LEFT JOIN s ON s.node_id = chat.node_id""")
def j13_chat_context(spark, d):
    p = I.problems(spark, d).selectExpr("node_id", "cast(no as bigint) as problem_no", "text", "doc_id")
    solutions = p.filter("doc_id % 2 = 0").selectExpr("node_id", "problem_no", "concat('solution ', doc_id) as solution")
    return threads.chat_context(I.chat(spark, d), p, solutions).select("seq", F.sha2("context", 256).alias("context_sha"))


_FOLD = f"""WITH {I.EVENTS_SQL}, b AS (SELECT *, max(seq) FILTER (event = 'snapshot') OVER (PARTITION BY job_id) AS base FROM ev),
p AS (SELECT *, sum((event IN ('problem', 'done', 'error', 'snapshot'))::INT) OVER (PARTITION BY job_id ORDER BY seq) AS piece FROM b WHERE base IS NULL OR seq >= base),
l AS (SELECT job_id, coalesce(arg_max(k, seq) FILTER (event IN ('start', 'snapshot')), 0)::INT AS total, (count(*) FILTER (event IN ('done', 'error')) + coalesce(max(k % 4) FILTER (event = 'snapshot'), 0))::INT AS done,
  arg_max_null(CASE event WHEN 'problem' THEN k WHEN 'snapshot' THEN k % 6 END, seq) FILTER (event IN ('problem', 'end', 'snapshot')) AS current_no, coalesce(arg_max(CASE event WHEN 'end' THEN coalesce(end_status, 'done') ELSE 'running' END, seq) FILTER (event IN ('start', 'end', 'snapshot')), 'queued') AS status,
  arg_max_null(CASE WHEN event = 'end' AND end_status = 'error' THEN 'failed ' || k END, seq) FILTER (event IN ('start', 'end', 'snapshot')) AS error, max(piece) AS piece FROM p GROUP BY job_id),
w AS (SELECT job_id, arg_max(CASE WHEN k % 3 = 0 THEN '알 수 없는 오류가 발생했습니다.' ELSE k || ';' END, seq) FILTER (event = 'error') AS last_error, max(seq) AS last_seq FROM ev GROUP BY job_id),
t AS (SELECT job_id, piece, string_agg(CASE event WHEN 'delta' THEN k || ';' ELSE 's' || k END, '' ORDER BY seq) AS partial FROM p WHERE event IN ('delta', 'snapshot') GROUP BY job_id, piece)
SELECT l.job_id, total, done, current_no, coalesce(partial, '') AS partial, status, error, last_error, last_seq FROM l JOIN w USING (job_id) LEFT JOIN t USING (job_id, piece)"""


@query(_FOLD)
def s5_x1_x2_job_progress(spark, d):
    events = progress.parsed_events(I.job_events(spark, d))
    return jobs.progress_batch(events.unionAll(events.filter("event in ('done', 'delta')")))  # these come twice, and count once


@query(f"WITH f AS ({_FOLD}), e AS (SELECT job_id % 50 AS node_id, done, total, (current_no IS NOT NULL)::INT AS r FROM f WHERE status IN ('queued', 'running')) SELECT node_id, sum(done)::BIGINT AS done, sum(greatest(total, done + r))::BIGINT AS total FROM e GROUP BY node_id")
def x3_exam_progress(spark, d):
    now = jobs.progress_batch(progress.parsed_events(I.job_events(spark, d))).selectExpr("job_id % 50 as node_id", "'solve' as kind", "status", "done", "total", "current_no")
    return jobs.exam_progress(now, "solve")
