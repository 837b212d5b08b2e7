"""Text functions, sections, plain text and document blocks over problem texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.functions import markdown as M
from examlake.functions import text as T
from examlake.operators import blocks
from examlake.plans import inputs as I
from examlake.plans.catalog import query
from examlake.sources import tables

#: Every fifth text has glyphs of the private-use area in place of its e's.
_PUA = "CASE WHEN doc_id % 5 = 0 THEN replace(text, 'e', chr(57445)) ELSE text END"


def _pua(spark, d):
    return I.table(spark, d, "documents").withColumn("t", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text")))


@query(f"""WITH x AS (SELECT doc_id, {_PUA} AS t FROM documents), n AS (SELECT doc_id, length(regexp_replace(t, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) AS p, length(regexp_replace(t, '\\s', '', 'g')) AS s FROM x)
SELECT doc_id, floor((CASE WHEN s > 0 THEN p / s::DOUBLE ELSE 0 END) * 10000 + 0.5) / 10000 AS pua_ratio FROM n""")
def p1_pua_ratio(spark, d):
    return _pua(spark, d).select("doc_id", T.half_up(T.pua_ratio(F.col("t")), 4).alias("pua_ratio"))


@query(f"""WITH x AS (SELECT doc_id // 10 AS file, {_PUA} AS t FROM documents), n AS (SELECT file, count(*) AS pages, sum(length(regexp_replace(t, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g'))) AS p, sum(length(regexp_replace(t, '\\s', '', 'g'))) AS s, sum(length(trim(t, ' ' || chr(10)))) AS c FROM x GROUP BY file)
SELECT file, CASE WHEN s > 0 AND p / s::DOUBLE >= 0.02 THEN 'image' ELSE 'text' END AS mode, c::BIGINT AS text_chars, c < 50 * pages AS scanned, CASE WHEN file % 3 > 0 THEN NULL WHEN file % 2 = 0 THEN 'ocr_no_anchor' WHEN c < 50 * pages THEN 'scanned' ELSE 'no_anchor' END AS reason FROM n""")
def p2_p3_p4_file_modes(spark, d):
    pages = _pua(spark, d).select(F.expr("doc_id div 10").alias("file"), T.pua_chars(F.col("t")).alias("p"), T.solid_chars(F.col("t")).alias("s"), F.char_length(T.stripped(F.col("t"))).alias("c"))
    n = pages.groupBy("file").agg(F.count("*").alias("pages"), F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("c").alias("text_chars"))
    ratio = F.when(F.col("s") > 0, F.col("p") / F.col("s")).otherwise(0.0)
    scanned = T.looks_scanned(F.col("text_chars"), F.col("pages"))
    return n.select("file", T.document_mode(ratio).alias("mode"), "text_chars", scanned.alias("scanned"), T.extract_error(F.col("file") % 3, scanned, F.col("file") % 2 == 0).alias("reason"))


_ANCHOR_TEXT = "CASE doc_id % 4 WHEN 0 THEN '기 본 문제 ' || (doc_id % 9 + 1) || '-' || (doc_id % 17) || ' ' WHEN 1 THEN ' ' || (doc_id % 1200) || '. ' WHEN 2 THEN (doc_id % 50) || ') ' ELSE '' END || text"


@query(f"""WITH x AS (SELECT doc_id, {_ANCHOR_TEXT} AS t FROM documents), y AS (SELECT doc_id, regexp_extract(t, '^\\s*(\\d{{1,3}})\\s*([.)])', 1) AS n, regexp_extract(t, '^\\s*(\\d{{1,3}})\\s*([.)])', 2) AS m, doc_id % 4 = 0 AS book FROM x)
SELECT doc_id, CASE WHEN book THEN (doc_id % 9 + 1) * 1000 + doc_id % 17 ELSE n::INT END::INT AS no, CASE WHEN NOT book THEN m END AS delimiter, CASE WHEN book THEN '기본문제' END AS series, CASE WHEN book THEN '기 본 문제 ' || (doc_id % 9 + 1) || '-' || (doc_id % 17) ELSE n END AS label FROM y WHERE book OR n <> ''""")
def p5_anchor_lines(spark, d):
    t = F.expr("concat(case doc_id % 4 when 0 then concat('기 본 문제 ', doc_id % 9 + 1, '-', doc_id % 17, ' ') when 1 then concat(' ', doc_id % 1200, '. ') when 2 then concat(doc_id % 50, ') ') else '' end, text)")
    return I.table(spark, d, "documents").select("doc_id", T.anchor(t).alias("a")).filter("a is not null").select("doc_id", "a.*")


@query(f"WITH {I.PROBLEMS_SQL}, x AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(raw_text, '^\\s*\\d{{1,2}}\\s*\\.\\s*', ''), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS t FROM problems) SELECT doc_id, sha256(trim(t, ' ' || chr(10))) AS cleaned_sha FROM x WHERE trim(t, ' ' || chr(10)) <> ''")
def p8_cleaned_texts(spark, d):
    return I.problems(spark, d).select("doc_id", T.cleaned(F.col("raw_text")).alias("t")).filter("t is not null").select("doc_id", F.sha2("t", 256).alias("cleaned_sha"))


_SOLVE = f"""WITH {I.PROBLEMS_SQL}, x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'image' END AS mode, doc_id % 11 <> 0 AS crop, CASE WHEN doc_id % 9 = 0 THEN '다음 그림 ' || coalesce(transcript, '') ELSE coalesce(transcript, '') END AS tr, CASE WHEN doc_id % 13 = 0 THEN '7. ' ELSE raw_text END AS tx FROM problems),
u AS (SELECT *, length(regexp_replace(regexp_replace(trim(tr, ' ' || chr(10)), '^[ \\t]*\\d+[ \\t]*[).\\]][ \\t]*', ''), '\\s', '', 'g')) >= 5 AS tok, length(regexp_replace(regexp_replace(tx, '^[ \\t]*\\d+[ \\t]*[).\\]][ \\t]*', ''), '\\s', '', 'g')) >= 5 AS xok FROM x),
r AS (SELECT *, CASE WHEN crop AND doc_id % 9 = 0 THEN 'figure' WHEN coalesce(transcript_source, '') = 'manual' AND tok THEN 'manual' WHEN mode = 'text' AND xok THEN 'original' WHEN tok THEN 'transcript' WHEN crop THEN 'crop' ELSE 'none' END AS reason FROM u)"""


@query(_SOLVE + " SELECT doc_id, CASE WHEN reason IN ('figure', 'crop') THEN 'image' WHEN reason <> 'none' THEN 'text' END AS way, reason, CASE WHEN mode = 'text' THEN CASE WHEN crop THEN 'image' END WHEN tok THEN 'text' END AS fallback FROM r")
def p9_p10_p11_p12_solve_inputs(spark, d):
    x = I.problems(spark, d).withColumns({"mode": F.expr("if(doc_id % 2 = 0, 'text', 'image')"), "crop": F.expr("doc_id % 11 <> 0"), "tr": F.expr("if(doc_id % 9 = 0, concat('다음 그림 ', coalesce(transcript, '')), coalesce(transcript, ''))"), "tx": F.expr("if(doc_id % 13 = 0, '7. ', raw_text)")})
    picked = T.solve_input(F.col("mode"), F.col("tx"), F.col("tr"), F.col("transcript_source"), F.col("crop"))
    return x.select("doc_id", picked.alias("p"), T.fallback_input(F.col("mode"), F.col("tr"), F.col("crop")).alias("fallback")).select("doc_id", F.col("p.mode").alias("way"), "p.reason", "fallback")


@query(f"WITH {I.PROBLEMS_SQL} SELECT doc_id, CASE WHEN label IS NULL THEN no || '번' ELSE label END AS shown, sha256(CASE WHEN doc_id % 40 + 1 = no THEN regexp_replace(raw_text, '^[ \\t]*\\d+[ \\t]*[).\\]][ \\t]*', '') END) AS body_sha, 'exam' || node_id || '_' || CASE WHEN doc_id % 2 = 0 THEN '변형문제' ELSE '문제' END || CASE WHEN doc_id % 3 = 0 THEN '와해설' ELSE '' END || '.docx' AS file FROM problems")
def p13_p14_p15_display(spark, d):
    p = I.problems(spark, d)
    return p.select("doc_id", T.display_no(F.col("no"), F.col("label")).alias("shown"), F.sha2(T.without_own_number(F.col("raw_text"), F.col("no")), 256).alias("body_sha"), T.export_name(F.concat(F.lit("exam"), F.col("node_id"), F.lit(".pdf")), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.lit("docx")).alias("file"))


@query("SELECT doc_id, sha256(trim(text, ' ' || chr(10))) AS kept_sha FROM documents")
def p16_without_followups(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit("\n\n---\n\nfollow-up question: more?\nyes"))).otherwise(F.col("text"))
    return I.table(spark, d, "documents").select("doc_id", F.sha2(T.without_followups(t), 256).alias("kept_sha"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad_output' WHEN 1 THEN 'empty' END AS reason, CASE WHEN event_id % 4 >= 2 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def p17_recovered_json(spark, d):
    e = I.table(spark, d, "events").selectExpr("event_id", "case event_id % 4 when 0 then concat('no ', substring(props, 2)) when 1 then ' ' when 2 then props else concat('so: ', props, ' end') end as t")
    return e.select("event_id", T.recovered_json(F.col("t")).alias("r")).select("event_id", "r.reason", F.try_element_at("r.value", F.lit("k")).alias("k"))


@query("""WITH x AS (SELECT conv_id * 1000 + turn AS seq, conv_id % 30 + 1 AS a, turn % 30 + 1 AS b FROM conversations)
SELECT seq, array_to_string(list_filter(list_transform([CASE WHEN a <= 22 THEN a END, CASE WHEN b <> a AND b <= 22 THEN b END], lambda v: v::VARCHAR), lambda v: v IS NOT NULL), ',') AS numbers FROM x""")
def p23_mentions(spark, d):
    c = I.table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as seq", "concat('2026년 3단계 [3점] 2.7 ', conv_id % 30 + 1, '번 그리고 문제 ', turn % 30 + 1, ' 5번째 줄 ', conv_id % 30 + 1, '번') as t")
    return c.select("seq", F.array_join(F.transform(T.mentions(F.col("t"), F.sequence(F.lit(1), F.lit(22))), lambda x: x.cast("string")), ",").alias("numbers"))


@query("SELECT conv_id * 1000 + turn AS seq, turn % 2 = 0 AS adds, CASE WHEN turn % 2 = 0 THEN '민지' || CASE conv_id % 3 WHEN 0 THEN '가' ELSE '나' END END AS note FROM conversations")
def p24_note_intents(spark, d):
    c = I.table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as seq", "concat('3번을 민지', if(conv_id % 3 = 0, '가', '나'), '의 오답 노트에 ', if(turn % 2 = 0, '추가해', '보여')) as t")
    return c.select("seq", T.note_intent(F.col("t"), F.sequence(F.lit(1), F.lit(22))).alias("i")).select("seq", "i.adds", "i.note")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 AND doc_id % 2 = 0 THEN 'manual' WHEN doc_id % 4 = 1 THEN 'ai' END AS source FROM documents")
def p26_transcript_sources(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.transcript_source(F.expr("case when doc_id % 4 < 3 and doc_id % 2 = 0 then 'manual' when doc_id % 4 = 1 then 'ai' else 'robot' end")).alias("source"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) - INTERVAL 9 HOUR END AS at FROM events")
def p30_instants(spark, d):
    e = I.table(spark, d, "events").selectExpr("event_id", "case event_id % 4 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") when 1 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00') when 2 then date_format(ts, 'yyyy-MM-dd') else 'soon' end as t")
    return e.select("event_id", T.instant(F.col("t")).cast("timestamp_ntz").alias("at"))


def _answers(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.withColumn("answer", F.expr("case doc_id % 4 when 0 then text when 1 then concat('pre\\n## 판정\\n가능\\n## 문제\\n', text) when 2 then concat('## 문제 확인\\nx\\n## 풀이\\n', text, '\\n### 하나\\n## 검산\\ny\\n## 풀이\\nz') else '' end"))


@query("""WITH x AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents), s AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN CASE WHEN t = '' THEN [] ELSE [('문제', t)] END WHEN 1 THEN [('판정', '가능'), ('문제', t)] WHEN 2 THEN [('문제 확인', 'x'), ('풀이', CASE WHEN t = '' THEN '' ELSE t || chr(10) END || '### 하나' || chr(10) || chr(10) || 'z'), ('검산', 'y')] ELSE [] END) AS s,
  unnest(CASE doc_id % 4 WHEN 0 THEN CASE WHEN t = '' THEN [] ELSE [0] END WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1, 2] ELSE [] END) AS pos FROM (SELECT doc_id, t FROM x))
SELECT doc_id, pos::INT AS pos, s[1] AS title, sha256(replace(s[2], chr(10), '')) AS body_sha FROM s""")
def p18_sections(spark, d):
    s = _answers(spark, d).select("doc_id", F.posexplode(M.sections(F.col("answer"))).alias("pos", "s"))
    return s.select("doc_id", "pos", "s.title", F.sha2(F.replace("s.body", F.lit("\n"), F.lit("")), 256).alias("body_sha"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN sha256(trim(text, ' ' || chr(10))) END AS transcript_sha FROM documents")
def p19_transcriptions(spark, d):
    return _answers(spark, d).select("doc_id", F.sha2(M.transcription(F.col("answer"))["transcript"], 256).alias("transcript_sha"))


@query("SELECT doc_id, 'x² and (1)/(2) √(y) $5 ' || doc_id AS plain FROM documents")
def p20_p21_plain_texts(spark, d):
    t = F.concat(F.lit(r"$x^2$ and \(\frac{1}{2}\) $$\sqrt{y}$$ \$5 "), F.col("doc_id").cast("string"))
    return I.table(spark, d, "documents").select("doc_id", M.plain(t).alias("plain"))


@query("SELECT doc_id, 1 AS pos, 'a₁ ' AS x, NULL AS latex FROM documents WHERE false UNION ALL SELECT doc_id, 0, 'at ' || doc_id || ' ', NULL FROM documents UNION ALL SELECT doc_id, 1, 'a₁≤b', 'a_1 \\le b' FROM documents WHERE false")
def p22_plain_segments_lead(spark, d):
    t = F.concat(F.lit("at "), F.col("doc_id").cast("string"), F.lit(r" $a_1 \le b$"))
    s = I.table(spark, d, "documents").select("doc_id", F.posexplode(M.plain_segments(t)).alias("pos", "s"))
    return s.filter("pos = 0").select("doc_id", "pos", F.col("s.text").alias("x"), "s.latex")


_BLOCK_ITEMS = "WITH x AS (SELECT doc_id // 40 AS doc, doc_id, doc_id % 40 + 1 AS item, doc_id % 2 = 0 AND trim(text, ' ') <> '' AS t, doc_id % 3 = 0 AS s FROM documents)"
_BLOCKS = _BLOCK_ITEMS + """, r AS (SELECT DISTINCT doc, 0 AS part, 0 AS item, 0 AS i, 'heading' AS kind, 1 AS level, 'exam ' || doc AS text FROM x
UNION ALL SELECT doc, 1, item, 0, 'heading', 2, item || '번' FROM x UNION ALL SELECT doc, 1, item, 1, CASE WHEN t THEN 'text' ELSE 'image' END, NULL, CASE WHEN t THEN 'doc ' || doc_id END FROM x
UNION ALL SELECT DISTINCT doc, 2, 0, 0, 'page_break', NULL, NULL FROM x WHERE s UNION ALL SELECT DISTINCT doc, 2, 0, 1, 'heading', 1, '정답 및 해설' FROM x WHERE s
UNION ALL SELECT doc, 3, item, 0, 'heading', 2, item || '번' FROM x WHERE s UNION ALL SELECT doc, 3, item, 1, 'heading', 3, '풀이' FROM x WHERE s UNION ALL SELECT doc, 3, item, 2, 'text', NULL, 'why ' || doc_id FROM x WHERE s),
b AS (SELECT doc AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY part, item, i) - 1 AS pos, kind, level::INT AS level, text FROM r)"""


def _blocks(spark, d):
    x = I.problems(spark, d)
    body = blocks.item_body(F.expr("doc_id % 2 = 0 and trim(text) <> ''"), F.concat(F.lit("doc "), F.col("doc_id")), F.lit(True))
    answer = blocks.solution_blocks(F.expr("case when doc_id % 3 = 0 then concat('## 문제 확인\\nq\\n## 풀이\\nwhy ', doc_id) else '' end"))
    items = x.withColumns({"body": body, "answer": answer}).select(F.col("node_id").alias("doc_id"), F.col("no").cast("long").alias("item"), T.display_no(F.col("no"), F.lit("")).alias("heading"), "body", "answer")
    return blocks.assembled(items, F.concat(F.lit("exam "), F.col("doc_id"))).withColumn("pos", F.col("pos").cast("long"))


@query(_BLOCKS + " SELECT * FROM b")
def b1_b2_b3_exam_blocks(spark, d):
    return _blocks(spark, d)


@query(_BLOCKS + """, e AS (SELECT *, sum((kind = 'heading' AND level = 2)::INT) OVER w AS n, max(CASE WHEN kind = 'page_break' OR (kind = 'heading' AND level <= 2) THEN pos * 2 + (level = 2)::INT END) OVER w AS last FROM (SELECT doc_id, pos, kind, coalesce(level, 0) AS level FROM b) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CASE WHEN last % 2 = 1 THEN n::BIGINT END AS item_no, CASE WHEN kind = 'page_break' THEN NULL ELSE kind = 'heading' AND level = 1 END AS full_width FROM e""")
def w21_w22_item_spans(spark, d):
    return blocks.item_spans(_blocks(spark, d)).select("doc_id", "pos", "item_no", blocks.full_width(F.col("kind"), F.col("level")).alias("full_width"))


@query(f"WITH {I.PROBLEMS_SQL}, g AS (SELECT node_id AS doc_id, count(*) FILTER (doc_id % 3 = 0) AS n, count(*) FILTER (doc_id % 6 = 0) AS m, count(*) FILTER (doc_id % 6 = 3) AS a FROM problems GROUP BY node_id) SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN n = m THEN 'manual' WHEN a > 0 THEN 'restored_ai' ELSE 'restored' END AS notice FROM g")
def a14_export_notices(spark, d):
    p = I.problems(spark, d).select(F.col("node_id").alias("doc_id"), (F.col("doc_id") % 3 == 0).alias("as_text"), F.col("transcript_source").alias("source"))
    return blocks.export_notice(p)


_B4 = """WITH x AS (SELECT doc_id // 40 AS doc, (doc_id % 40 + 1) * 10 + CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 9 END AS item, doc_id,
  CASE WHEN doc_id % 5 = 0 THEN 'E-' || doc_id ELSE (doc_id % 40 + 1) || '번' END || ' · ' || CASE doc_id % 4 WHEN 0 THEN '숫자 변형' WHEN 1 THEN '조건 변형' WHEN 2 THEN '숫자·조건 변형' ELSE 'zz' END AS h,
  trim(text, ' ' || chr(10)) AS t, doc_id % 3 = 0 AS s FROM documents),
r AS (SELECT DISTINCT doc, 0 AS part, 0 AS item, 0 AS i, 'heading' AS kind, 1 AS level, 'variants ' || doc AS text FROM x UNION ALL SELECT doc, 1, item, 0, 'heading', 2, h FROM x UNION ALL SELECT doc, 1, item, 1, 'text', NULL, sha256(t) FROM x WHERE t <> ''
UNION ALL SELECT DISTINCT doc, 2, 0, 0, 'page_break', NULL, NULL FROM x WHERE s UNION ALL SELECT DISTINCT doc, 2, 0, 1, 'heading', 1, '정답 및 해설' FROM x WHERE s
UNION ALL SELECT doc, 3, item, 0, 'heading', 2, h FROM x WHERE s UNION ALL SELECT doc, 3, item, 1, 'heading', 3, '정답' FROM x WHERE s UNION ALL SELECT doc, 3, item, 2, 'text', NULL, sha256('answer ' || doc_id) FROM x WHERE s)
SELECT doc AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY part, item, i) - 1 AS pos, kind, level::INT AS level, text FROM r"""


@query(_B4)
def b4_variant_documents(spark, d):
    v = I.problems(spark, d).select(F.col("node_id").alias("doc_id"), "no", "label", F.expr("case doc_id % 4 when 0 then 'number' when 1 then 'condition' when 2 then 'number_condition' else 'zz' end").alias("mode"), F.expr("concat('## 문제\n', text, '\n## 문제 확인\nq\n## 풀이\n \n', if(doc_id % 3 = 0, concat('## 정답\nanswer ', doc_id), ''))").alias("text"))
    out = blocks.assembled(blocks.variant_items(v), F.concat(F.lit("variants "), F.col("doc_id")))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "level", F.when(F.col("kind") == "text", F.sha2("text", 256)).otherwise(F.col("text")).alias("text"))


_B5 = """WITH x AS (SELECT doc_id // 40 AS doc, doc_id % 40 + 1 AS item, doc_id, 'exam' || (doc_id % 3) || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'E-' || doc_id ELSE (doc_id % 40 + 1) || '번' END AS h,
  doc_id % 2 = 0 AND trim(text, ' ' || chr(9) || chr(10)) <> '' AS t, text, doc_id % 7 = 0 AS m, doc_id % 3 = 0 AS s FROM documents),
r AS (SELECT DISTINCT doc, 0 AS part, 0 AS item, 0 AS i, 'heading' AS kind, 1 AS level, 'note ' || doc AS text FROM x UNION ALL SELECT doc, 1, item, 0, 'heading', 2, h FROM x UNION ALL SELECT doc, 1, item, 1, CASE WHEN t THEN 'text' ELSE 'image' END, NULL, CASE WHEN t THEN sha256(text) END FROM x
UNION ALL SELECT doc, 1, item, 2, 'text', NULL, sha256('메모: why ' || doc_id) FROM x WHERE m
UNION ALL SELECT DISTINCT doc, 2, 0, 0, 'page_break', NULL, NULL FROM x WHERE s UNION ALL SELECT DISTINCT doc, 2, 0, 1, 'heading', 1, '정답 및 해설' FROM x WHERE s
UNION ALL SELECT doc, 3, item, 0, 'heading', 2, h FROM x WHERE s UNION ALL SELECT doc, 3, item, 1, 'heading', 3, '풀이' FROM x WHERE s UNION ALL SELECT doc, 3, item, 2, 'text', NULL, sha256('so ' || doc_id) FROM x WHERE s)
SELECT doc AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY part, item, i) - 1 AS pos, kind, level::INT AS level, text FROM r"""


@query(_B5)
def b5_note_documents(spark, d):
    n = I.problems(spark, d).select(F.col("node_id").alias("doc_id"), F.col("no").cast("long").alias("item"), "no", "label", F.concat(F.lit("exam"), F.col("doc_id") % 3, F.lit(".PDF")).alias("source_name"), (F.col("doc_id") % 2 == 0).alias("as_text"), F.col("text").alias("transcript"), F.lit(True).alias("has_crop"), F.expr("if(doc_id % 7 = 0, concat(' why ', doc_id), ' ')").alias("memo"), F.expr("if(doc_id % 3 = 0, concat('so ', doc_id), null)").alias("solution"))
    out = blocks.assembled(blocks.note_document_items(n), F.concat(F.lit("note "), F.col("doc_id")))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "level", F.when(F.col("kind") == "text", F.sha2("text", 256)).otherwise(F.col("text")).alias("text"))


# Whole jobs over the texts themselves: a parser's results, which SQL cannot give; tests compare them with brute force.
def _maths(spark, d):
    """Documents as they are, with maths before and behind the text, and with the whole text as maths."""
    t = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(r"$x^2$ "), "text", F.lit(r" \(\frac{1}{2}\)"))).when(F.col("doc_id") % 3 == 2, F.concat(F.lit("$$"), "text", F.lit("$$"))).otherwise(F.col("text"))
    return I.table(spark, d, "documents").select("doc_id", t.alias("t"))


@query()
def p20_p21_document_plain_texts(spark, d):
    return _maths(spark, d).select("doc_id", M.plain(F.col("t")).alias("plain"))


@query()
def p22_document_segments(spark, d):
    return M.segment_rows(_maths(spark, d), "doc_id", "t").withColumnRenamed("text", "x")


@query()
def p23_conversation_mentions(spark, d):
    return I.table(spark, d, "conversations").select("conv_id", "turn", T.mentions(F.col("text"), F.sequence(F.lit(1), F.lit(22))).alias("numbers"))


@query()
def p24_conversation_intents(spark, d):
    c = I.table(spark, d, "conversations").select("conv_id", "turn", T.note_intent(F.col("text"), F.sequence(F.lit(1), F.lit(22))).alias("i"))
    return c.select("conv_id", "turn", "i.adds", "i.numbers", "i.note")


@query()
def b1_b2_b3_document_blocks(spark, d):
    """Exams of the texts themselves: every second problem as text, every third with its text as the solution."""
    x = I.problems(spark, d)
    body = blocks.item_body(F.col("doc_id") % 2 == 0, F.col("text"), F.lit(True))
    answer = blocks.solution_blocks(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## 문제 확인\nq\n## 풀이\n"), "text")))
    items = x.withColumns({"body": body, "answer": answer}).select(F.col("node_id").alias("doc_id"), F.col("no").cast("long").alias("item"), T.display_no(F.col("no"), F.lit("")).alias("heading"), "body", "answer")
    return blocks.assembled(items, F.concat(F.lit("exam "), F.col("doc_id"))).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'empty_file' WHEN page_id % 2 = 0 THEN 'not_a_pdf' END AS reason FROM pages")
def s4_upload_errors(spark, d):
    p = I.table(spark, d, "pages").select("page_id", F.expr("case when page_id % 10 = 0 then '' when page_id % 2 = 0 then html else concat('%PDF-1.7', html) end").cast("binary").alias("content"))
    return p.select("page_id", tables.upload_error(F.length("content"), F.substring("content", 1, 4)).alias("reason"))


@query(f"""WITH {I.EVENTS_SQL} SELECT seq, event AS type, CASE event WHEN 'snapshot' THEN k % 6 WHEN 'start' THEN NULL WHEN 'end' THEN NULL ELSE k END AS no, CASE WHEN event IN ('start', 'snapshot') THEN k END AS total,
  CASE event WHEN 'delta' THEN k || ';' WHEN 'snapshot' THEN 's' || k END AS text, CASE event WHEN 'problem' THEN 'running' WHEN 'snapshot' THEN 'running' WHEN 'end' THEN end_status END AS status,
  CASE WHEN event = 'error' THEN CASE WHEN k % 3 = 0 THEN '알 수 없는 오류가 발생했습니다.' ELSE k || ';' END WHEN event = 'end' AND k % 4 = 2 THEN 'failed ' || k END AS message, CASE event WHEN 'error' THEN 'unknown' END AS error_code,
  CASE event WHEN 'snapshot' THEN k % 4 END AS done_count, CASE WHEN event = 'problem' AND k % 2 = 0 THEN 'pua' END AS route, CASE WHEN event = 'done' AND k % 3 = 1 THEN 't' || k END AS transcript, CASE WHEN event = 'done' AND k % 3 = 1 THEN 'ai' END AS source,
  CASE WHEN event = 'done' AND k % 3 = 0 THEN 'n' END AS note, event = 'done' AND k % 3 < 2 AS has_transcript FROM ev""")
def s5_job_events(spark, d):
    e = I.job_events(spark, d)
    return e.select("seq", tables.job_event(F.col("event"), F.col("data")).alias("e")).select("seq", "e.*")
