"""Tokens and costs of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that hold tokens, and what caching and currencies multiply prices by.
TOKEN_FIELDS = ("input_tokens", "output_tokens", "thinking_tokens", "cache_read_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
CACHE_WRITE, CACHE_READ, KRW = "1.25", "0.10", 1400
ESTIMATE_TOKENS = {"output": 1400, "cache_read": 2500, "input": 100}


def json_map(text: Column) -> Column:
    """The fields of a JSON object as texts; null for anything else."""
    return F.from_json(text, "map<string,string>")


def _number(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name)).try_cast("double").cast("long")


def usage_tokens(usage: Column) -> Column:
    """A1: total_tokens if that is a number or the text of one, cut to an integer; else the sum of the known fields. Null for no call."""
    fields = json_map(usage)
    each = sum((F.coalesce(_number(fields, f), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))
    return F.when(fields.isNotNull(), F.coalesce(_number(fields, "total_tokens"), each))


def usage_summary(tables: list[DataFrame], now: Column) -> DataFrame:
    """A2: tokens and calls of the last 24 hours, 7 days and in total. Tables have usage_json and at (a timestamp or null)."""
    rows = tables[0].select("usage_json", "at")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("usage_json", "at"))
    calls = rows.select(usage_tokens(F.col("usage_json")).alias("tokens"), "at").filter("tokens is not null")
    cells = []
    for name, inside in (("day", F.col("at") >= now - F.expr("interval 24 hours")), ("week", F.col("at") >= now - F.expr("interval 7 days")), ("total", F.lit(True))):
        hit = F.coalesce(inside, F.lit(False))
        cells += [F.coalesce(F.sum(F.when(hit, F.col("tokens"))), F.lit(0)).cast("long").alias(f"tokens_{name}"), F.count(F.when(hit, 1)).alias(f"calls_{name}")]
    return calls.agg(*cells)


def priced(calls: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (model, and *_tokens) with usd and krw, and those of unknown models. ``rates`` (model_key, input, output as decimals per million tokens) is a price list, a handful of rows.

    The exact model counts, or else the longest key that begins its name: names are joined by each of their beginnings.
    """
    models = calls.select("model").distinct()
    begins = models.select("model", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("model")), lambda n: F.left("model", n))).alias("model_key"))
    best = begins.join(rates, "model_key").groupBy("model").agg(F.max_by(F.struct("input", "output"), F.length("model_key")).alias("rate"))
    joined = calls.join(best, "model", "left")
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(12,0)")
    m = lambda x: F.lit(x).cast("decimal(3,2)")
    usd = (tokens("input_tokens") * F.col("rate.input") + tokens("output_tokens") * F.col("rate.output") + tokens("cache_write_tokens") * F.col("rate.input") * m(CACHE_WRITE) + tokens("cache_read_tokens") * F.col("rate.input") * m(CACHE_READ)) * F.lit("0.000001").cast("decimal(7,6)")
    # decimals throughout: eight places of dollars, four of won
    out = joined.filter("rate is not null").withColumn("usd", F.round(usd, 8).cast("decimal(20,8)")).withColumn("krw", F.round(F.col("usd") * F.lit(KRW).cast("decimal(5,0)"), 4).cast("decimal(24,4)")).drop("rate")
    return out, joined.filter("rate is null").drop("rate")


def call_set_totals(calls: DataFrame, by: str, total_problems: Column) -> DataFrame:
    """A4: tokens, calls solved and billed (cost over 0), the mean cost of billed ones and what all problems would cost."""
    billed = F.col("usd") > 0
    sums = calls.groupBy(by).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")), F.count("*").alias("calls"), F.count(F.when(F.col("ok"), 1)).alias("solved"), F.count(F.when(billed, 1)).alias("billed"), F.coalesce(F.sum(F.when(billed, F.col("usd"))), F.lit(0)).cast("decimal(30,8)").alias("usd"))
    mean = F.when(F.col("billed") > 0, F.col("usd").cast("double") / F.col("billed")).otherwise(0.0)
    return sums.withColumn("mean_usd", F.floor(mean * 1e8 + 0.5) / 1e8).withColumn("projected_usd", F.floor(mean * total_problems * 1e4 + 0.5) / 1e4).withColumn("usd", F.col("usd").cast("double"))


def session_totals(calls: DataFrame, by: str) -> DataFrame:
    """A5: a call without a cost is one of the subscription, whose tokens count; the others are billed."""
    free = F.col("usd").isNull()
    return calls.groupBy(by).agg(F.count(F.when(free, 1)).alias("subscription_calls"), F.coalesce(F.sum(F.when(free, F.col("tokens"))), F.lit(0)).cast("long").alias("subscription_tokens"), F.count(F.when(~free, 1)).alias("billed_calls"), F.coalesce(F.sum("usd"), F.lit(0)).cast("decimal(30,8)").cast("double").alias("usd"))


def exam_estimate(exams: DataFrame, rates: DataFrame) -> DataFrame:
    """Exams (exam, model, problems) with the estimated dollars; null for an unknown model or no problems."""
    e = ESTIMATE_TOKENS
    one = (F.col("output") * e["output"] + F.col("input") * F.lit(CACHE_READ).cast("decimal(3,2)") * e["cache_read"] + F.col("input") * e["input"]) * F.lit("0.000001").cast("decimal(7,6)")
    joined = exams.join(rates, exams["model"] == rates["model_key"], "left")
    return joined.select("exam", "model", "problems", F.when(F.col("problems") > 0, F.round(one * F.col("problems"), 6)).cast("double").alias("usd"))
