"""Reading and writing the library's tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators.usage import json_map
from examlake.sources.staging import staged

# The columns of each table.
SCHEMAS = {
    "nodes": "node_id string, type string, name string, parent_id string, section string, created_at string",
    "files": "node_id string, pages int, mode string, pua_ratio double, problem_count int, extract_error string",
    "problems": "node_id string, no int, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, crop_path string, text string, label string, transcript string, transcript_source string, transcript_note string",
    "solutions": "node_id string, no int, solution string, usage_json string, cost_json string, truncated boolean, created_at string",
    "variants": "node_id string, no int, mode string, text string, usage_json string, cost_json string, created_at string",
    "chat_messages": "id string, node_id string, problem_no int, role string, content string, usage_json string, created_at string",
    "conversations": "id string, title string, created_at string, updated_at string",
    "conversation_messages": "id string, conversation_id string, role string, content string, file_id string, problem_no int, usage_json string, created_at string",
    "note_items": "id string, note_id string, source_node_id string, no int, name string, crop_path string, transcript string, label string, memo string, created_at string",
    "jobs": "id string, kind string, node_id string, targets_json string, status string, total int, done_count int, current_no int, error string, created_at string, updated_at string",
    "problem_types": "id string, subject string, area string, chapter string, name string, statement string, includes string, excludes string, status string",
    "bank_problems": "id string, raw_text string, transcript string, content_hash string, origin string, visibility string, source_label string",
    "problem_tags": "bank_id string, type_id string, confidence double, source string, evidence string",
    "page_words": "doc_id long, page int, x0 double, y0 double, x1 double, y1 double",
    "page_rules": "doc_id long, page int, x0 double, y0 double, x1 double, y1 double",
    "page_spans": "doc_id long, page int, font string, size double, text string, x0 double, y0 double, x1 double, y1 double",
    "ocr_lines": "doc_id long, page int, text string, confidence double, x0 double, y0 double, x1 double, y1 double",
    "glyphs": "doc_id long, page int, char string, font string, size double, baseline double, x0 double, y0 double, x1 double, y1 double",
    "page_lines": "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double",
}
LARGEST_FILE = 50 << 20
EVENTS = ("snapshot", "start", "problem", "delta", "done", "error", "end")
NO_MESSAGE = "알 수 없는 오류가 발생했습니다."


def read(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A table with its schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def write(df: DataFrame, path: str, by: list[str] | None = None, keys: list[str] | None = None) -> None:
    """Rows replace the stored rows of their ``keys``; stored rows of other keys stay. A second run gives the same.

    Only partitions of ``by`` that the rows name are read and written again (without ``by``, the table). Their new state is staged in the shared
    folder first, and the table's files change when that is complete; a run that stops before leaves the table as it was. Of several
    rows of one key one stays (the last as JSON). A row whose key was stored in another partition is added, so ``keys`` should
    name the columns of ``by``. Without ``keys`` the partitions (or the table) are replaced as a whole.
    """
    spark = df.sparkSession
    if keys:
        row = F.struct(*df.columns)
        df = df.groupBy(*keys).agg(F.max_by(row, F.to_json(row)).alias("_row")).select("_row.*")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            stored, new = spark.read.schema(df.schema).parquet(path), staged(df)
            same = lambda a, b, columns: functools.reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))
            if by:
                touched = new.select(*by).distinct()
                stored = stored.alias("s").join(F.broadcast(touched).alias("t"), same(stored, touched, by), "left_semi")  # a row for each partition
            df = new.unionByName(stored.join(new, same(stored, new, keys), "left_anti").select(*new.columns))
            df = staged(df)
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def type_definitions(spark: SparkSession, path: str) -> DataFrame:
    """S3: definitions of all seed files in a folder, with the file's name; other keys are ignored, a missing or empty folder is an empty table."""
    kind = "types array<struct<id:string,statement:string,includes:string,excludes:string>>"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not there.exists(hadoop) or not len(there.listStatus(hadoop)):
        return spark.createDataFrame([], "id string, statement string, includes string, excludes string, file string")
    files = spark.read.schema(kind).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return files.select(F.explode("types").alias("t"), F.col("_metadata.file_name").alias("file")).select("t.*", "file")


def upload_error(length: Column, head: Column) -> Column:
    """Why a file is not accepted, from its length and first four bytes; null for a good one."""
    return F.when(length == 0, "empty_file").when(length > LARGEST_FILE, "file_too_large").when(~F.coalesce(head.cast("string") == "%PDF", F.lit(False)), "not_a_pdf")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """S4 over a folder of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", upload_error(F.col("length"), F.substring("content", 1, 4)).alias("reason"))


def job_event(event: Column, data: Column) -> Column:
    """An event's fields by its type (unknown for an unreadable or unnamed one); what a type does not have is null.

    ``no``: the number (of a snapshot: the current one). ``text``: what a delta adds, or a snapshot's partial text. ``transcript``, ``source`` and ``note`` stand in a done event with
    any of transcript and note, as ``has_transcript`` says, for null is a finding there. ``route``: how a problem is read. ``status``: of a problem, snapshot or end.
    """
    blank = F.coalesce(data, F.lit("")) == ""
    fields = F.when(blank, F.create_map().cast("map<string,string>")).otherwise(json_map(data))
    known = F.coalesce(event.isin(*EVENTS) & fields.isNotNull(), F.lit(False))
    get = lambda k: F.try_element_at(fields, F.lit(k))
    of = lambda *kinds: known & event.isin(*kinds)
    number = lambda k: get(k).try_cast("int")
    read = of("done") & (F.map_contains_key(fields, "transcript") | F.map_contains_key(fields, "note"))
    return F.struct(
        F.when(known, event).otherwise("unknown").alias("type"),
        F.when(of("snapshot"), number("current_no")).when(of("problem", "delta", "done", "error"), number("no")).alias("no"),
        F.when(of("start"), number("total")).when(of("snapshot"), F.coalesce(number("total"), F.lit(0))).alias("total"),
        F.when(of("delta"), F.coalesce(get("text"), F.lit(""))).when(of("snapshot"), F.coalesce(get("partial_text"), F.lit(""))).alias("text"),
        F.when(of("problem", "snapshot"), F.coalesce(get("status"), F.lit("running"))).when(of("end"), get("status")).alias("status"),
        F.when(of("error"), F.coalesce(get("message"), F.lit(NO_MESSAGE))).when(of("end"), get("message")).alias("message"),
        F.when(of("error"), F.coalesce(get("error_code"), F.lit("unknown"))).alias("error_code"),
        F.when(of("snapshot"), F.coalesce(number("done_count"), F.lit(0))).alias("done_count"),
        F.when(of("problem"), get("route")).alias("route"),
        F.when(read, get("transcript")).alias("transcript"),
        F.when(read, get("source")).alias("source"),
        F.when(read, get("note")).alias("note"),
        F.coalesce(read, F.lit(False)).alias("has_transcript"),
    )
