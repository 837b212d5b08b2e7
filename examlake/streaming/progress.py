"""Corpus dedup and usage totals as they arrive, and the events of jobs (whose progress is in ``jobs``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from examlake.operators import corpus
from examlake.operators.usage import usage_tokens
from examlake.sources import tables

DAY, WEEK = 24 * 3600, 7 * 24 * 3600
WINDOWS = "day_tokens long, day_calls long, week_tokens long, week_calls long, tokens long, calls long"


def dedup_into(path: str):
    """The function for foreachBatch: new hashes are added to the stored corpus, the first of each batch in order.

    The corpus lies by the first two digits of the hash and by epoch, so a batch reads the parts it has hashes of and no others; of each
    stored row only the hash. An epoch's rows replace those of an earlier try of the same epoch, which its look at the corpus leaves out, so
    a batch that comes again gives the same corpus. One stream writes to a path.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hashed, _ = corpus.hashed(batch)
        hashed = hashed.withColumn("bucket", F.substring("content_hash", 1, 2)).persist()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            stored = None
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                touched = [r["bucket"] for r in hashed.select("bucket").distinct().collect()]  # at most 256
                stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched) & (F.col("epoch") != epoch)).select("content_hash")
            new = corpus.deduplicated(hashed, ["seq"], stored, ["problem_id"]).filter("is_stored").drop("is_stored")
            new = new.withColumn("bucket", F.substring("content_hash", 1, 2)).withColumn("epoch", F.lit(epoch))
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)
        finally:
            hashed.unpersist()

    return store


def usage_totals(calls: DataFrame, by: str = "origin") -> DataFrame:
    """Tokens and calls so far, for a query in update or complete mode."""
    return calls.select(by, usage_tokens(F.col("usage_json")).alias("tokens")).filter("tokens is not null").groupBy(by).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))


class UsageState(StatefulProcessor):
    """The usage of the last day and week, by second, and of all time. Seconds older than a week go; a timer shows the row anew when the oldest of a window leaves it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getMapState("recent", "second long", "tokens long, calls long")
        self.all = handle.getValueState("all", "tokens long, calls long")

    def _row(self, key, now: int) -> pd.DataFrame:
        day, week, next_ = [0, 0], [0, 0], []
        for (second,), (tokens, calls) in list(self.recent.iterator()):
            age = now - second * 1000
            if age > WEEK * 1000:
                self.recent.removeKey((second,))
                continue
            for sums, length in ((day, DAY), (week, WEEK)):
                if age <= length * 1000:
                    sums[0] += tokens
                    sums[1] += calls
                    next_.append(second * 1000 + length * 1000 + 1)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if next_:
            self.handle.registerTimer(min(next_))
        return pd.DataFrame([[key[0], *day, *week, *self.all.get()]], columns=["origin", *(f.split()[0] for f in WINDOWS.split(", "))])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        tokens, calls = self.all.get() if self.all.exists() else (0, 0)
        for part in rows:
            tokens, calls = tokens + int(part["tokens"].sum()), calls + len(part)
            timed = part[part["second"].notna()]
            for second, mine in timed[timed["second"] >= now // 1000 - WEEK].groupby("second"):
                k = (int(second),)
                had = self.recent.getValue(k) if self.recent.containsKey(k) else (0, 0)
                self.recent.updateValue(k, (had[0] + int(mine["tokens"].sum()), had[1] + len(mine)))
        self.all.update((tokens, calls))
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def usage_windows(calls: DataFrame, by: str = "origin", at: str = "at") -> DataFrame:
    """X5 as a stream: calls (``by``, usage_json, timestamp ``at``) to tokens and calls of the last 24 hours, the last 7 days and in total, by origin; the cut is inclusive, calls without a time count in the total only.

    "Now" is the batch's time. Needs the RocksDB state store.
    """
    rows = calls.select(F.col(by).alias("origin"), usage_tokens(F.col("usage_json")).alias("tokens"), F.unix_seconds(F.col(at)).alias("second")).filter("tokens is not null")
    return rows.groupBy("origin").transformWithStateInPandas(UsageState(), f"origin string, {WINDOWS}", "update", "processingTime")


def parsed_events(raw: DataFrame) -> DataFrame:
    """Raw (job_id, seq, event, data) to typed events; unknown ones go. Other columns stay."""
    e = raw.withColumn("e", tables.job_event(F.col("event"), F.col("data")))
    others = [c for c in raw.columns if c not in ("job_id", "seq", "event", "data")]
    return e.select("job_id", "seq", F.col("e.type").alias("event"), "e.no", "e.total", "e.text", "e.status", "e.message", "e.done_count", *others).filter("event != 'unknown'")
