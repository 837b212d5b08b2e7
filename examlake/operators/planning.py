"""What is left to do, and which job does it already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["node_id", "no"]
MODE_ORDER = ("number", "condition", "number_condition")


def remaining(problems: DataFrame, done: DataFrame, requested: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Problems requested (null: all), once each, less those done; with ``force`` all of them."""
    wanted = problems.select(*KEY) if requested is None else problems.select(*KEY).join(requested.select(*KEY).distinct(), KEY, "left_semi")
    return wanted if force else wanted.join(done.select(*KEY), KEY, "left_anti")


def missing(problems: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested numbers that the exam does not have."""
    return requested.select(*KEY).distinct().join(problems.select(*KEY), KEY, "left_anti")


def has_transcript(problems: DataFrame) -> DataFrame:
    """A null or empty transcript does not count."""
    return problems.filter(F.coalesce(F.col("transcript"), F.lit("")) != "").select(*KEY)


def remaining_variants(problems: DataFrame, modes: list[str], existing: DataFrame) -> DataFrame:
    """Every wanted kind of every problem, less what exists."""
    wanted = problems.select(*KEY, F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return wanted.join(existing.select(*KEY, "mode"), [*KEY, "mode"], "left_anti")


#: What stands in an index of jobs for a job without targets (it does all), and for every job.
_ALL, _ANY = "all", "any"


def _entries(values: Column, asks: bool) -> Column:
    """Keys of a set of targets or modes (null: all): of a job all that it can be found by, of a request those it looks for."""
    each = F.transform(F.filter(F.array_distinct(values), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("="), x.cast("string")))
    known = F.concat(each, F.array(F.lit(_ALL if asks else _ANY)))
    return F.when(values.isNull(), F.array(F.lit(_ANY)) if asks else F.array(F.lit(_ALL), F.lit(_ANY))).otherwise(known)


def _indexed(rows: DataFrame, targets: str, modes: str, asks: bool) -> DataFrame:
    """``rows`` once for every key (_t, _m). Modes count for variants only, and nothing for text recognition."""
    one = F.array(F.lit(_ANY))
    rows = rows.withColumn("_t", F.explode(F.when(F.col("kind") == "ocr", one).otherwise(_entries(F.col(targets), asks))))
    return rows.withColumn("_m", F.explode(F.when(F.col("kind") == "variant", _entries(F.col(modes), asks)).otherwise(one)))


def overlapping_job(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each request, the first active job of its node and kind that does some of it, if any.

    A request or job without targets means all; text recognition overlaps always; variants need a common mode, too. Jobs are indexed by node, kind, target and mode, the first
    job of each; a request looks up its own targets and modes, so requests and jobs of a node are never paired.
    """
    active = jobs.filter(F.col("status").isin("queued", "running"))
    index = _indexed(active.select("node_id", "kind", "job_id", "created_at", "targets", "modes"), "targets", "modes", asks=False)
    index = index.groupBy("node_id", "kind", "_t", "_m").agg(F.min(F.struct("created_at", "job_id")).alias("_j"))
    looked = _indexed(requests.select("request_id", "node_id", "kind", "targets", "modes"), "targets", "modes", asks=True)
    first = looked.join(index, ["node_id", "kind", "_t", "_m"]).groupBy("request_id").agg(F.min("_j").alias("_j"))
    return requests.join(first, "request_id", "left").select(*requests.columns, F.col("_j.job_id").alias("job_id"))


def interrupted(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs of an earlier run."""
    open_ = F.col("status").isin("queued", "running")
    return jobs.withColumn("current_no", F.when(~open_, F.col("current_no"))).withColumn("status", F.when(open_, "interrupted").otherwise(F.col("status")))


def mode_rank(mode: Column) -> Column:
    """O1: variants of a problem stand in this order, others after them by name."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, MODE_ORDER)), mode), F.lit(0)).cast("int")


def ordered_variants(variants: DataFrame) -> DataFrame:
    """O1 with an explicit place within each exam."""
    rank = F.when(mode_rank(F.col("mode")) == 0, 99).otherwise(mode_rank(F.col("mode")))
    return variants.withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("no", rank, "mode")))


def recent_finished(jobs: DataFrame, n: int = 10) -> DataFrame:
    """O2: the jobs finished last."""
    return jobs.filter(~F.col("status").isin("queued", "running")).orderBy(F.desc("updated_at"), F.desc("job_id")).limit(n)


def variant_progress(problems: DataFrame, variants: DataFrame) -> DataFrame:
    """Kinds done by problem; problems with any, by exam."""
    kinds = variants.groupBy(*KEY).agg(F.countDistinct("mode").alias("kinds"))
    return problems.join(kinds, KEY, "left").groupBy("node_id").agg(F.count("*").alias("problems"), F.count("kinds").alias("with_any"), F.coalesce(F.sum("kinds"), F.lit(0)).cast("long").alias("kinds_done"))


def transcript_progress(problems: DataFrame) -> DataFrame:
    """Transcribed, the numbers that are not, and whether all are (false without problems)."""
    done = F.coalesce(F.col("transcript"), F.lit("")) != ""
    return problems.groupBy("node_id").agg(F.count(F.when(done, 1)).alias("transcribed"), F.sort_array(F.collect_list(F.when(~done, F.col("no")))).alias("open_numbers"), F.min(done).alias("all_done"))
