"""Streams against their batch twins, after every batch."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlake.sources import tables
from examlake.streaming import jobs, progress

KINDS = ["snapshot", "start", "problem", "delta", "delta", "done", "error", "end"]


def events(rng, job, n, kinds=KINDS):
    out = []
    for k in range(n):
        kind, number = rng.choice(kinds), lambda: rng.choice([None, rng.randint(1, 9)])
        text = rng.choice([None, f"t{k};"]) if kind in ("delta", "snapshot") else None
        out.append((job, k, kind, number(), number(), text, rng.choice([None, "done", "canceled", "error"]), rng.choice([None, f"m{k}"]), number()))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_any_order_and_replays(spark):
    """Any order and any cut into batches gives the batch twin's row; an event that comes twice counts once."""
    rng = random.Random(3)
    cases = [events(rng, j, 14, KINDS if j % 2 else KINDS[1:]) for j in range(12)]
    # the batch twin gets every event twice
    want = {r["job_id"]: list(r)[1:] for r in jobs.progress_batch(spark.createDataFrame([e for c in cases for e in c * 2], jobs.EVENT)).collect()}
    for job, case in enumerate(cases):
        frame = pd.DataFrame(case, columns=[f.split()[0] for f in jobs.EVENT.split(", ")]).astype(object)
        for _ in range(5):
            mixed = frame.sample(frac=1, random_state=rng.randint(0, 99))
            head, seen, pieces = dict(jobs._FIRST), {}, {}
            for a in range(0, 14, 5):
                jobs.folded(head, seen, pieces, pd.concat([mixed.iloc[a : a + 5], mixed.iloc[:2]]))
            assert jobs.shown(head, pieces) == want[job], case


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def batches(spark, tmp_path, parts, schema, query, after):
    """Feeds one part after the other to a stream, and looks at its result after each."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    state = {}
    keep = lambda df, _: state.update({r[0]: tuple(r) for r in df.collect()})
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = query(source).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
        try:  # with timers in processing time there is always another batch to look for, so neither availableNow nor processAllAvailable ends
            end = time.time() + 60
            while time.time() < end and q.exception() is None and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.2)
        finally:
            q.stop()
        after(k, state)


def test_progress_stream(rocks, tmp_path):
    rng = random.Random(5)
    all_ = [e for j in range(6) for e in events(rng, j, 12)]
    rng.shuffle(all_)
    parts = [all_[:30], all_[30:] + all_[:5]]

    def same(k, state):
        want = jobs.progress_batch(rocks.createDataFrame([e for p in parts[: k + 1] for e in p], jobs.EVENT))
        assert sorted(tuple(None if x != x else x for x in r) for r in state.values()) == sorted(map(tuple, want.collect()))

    batches(rocks, tmp_path, parts, jobs.EVENT, jobs.progress, same)


def test_stream_goes_on_from_stored_totals(rocks, tmp_path):
    """A job whose state has gone starts from its stored row; replays up to that row's last seq do not know which events it has counted, later events do count."""
    first = [(1, 1, "start", None, 5, None, None, None, None), (1, 2, "problem", 3, None, None, None, None, None), (1, 3, "done", None, None, None, None, None, None), (1, 4, "delta", None, None, "ab", None, None, None)]
    more = [(1, 5, "delta", None, None, "c", None, None, None), (1, 6, "error", None, None, None, None, "bad", None), (1, 7, "end", None, None, None, "error", "why", None)]
    stored = jobs.progress_batch(rocks.createDataFrame(first, jobs.EVENT))
    want = rows(jobs.progress_batch(rocks.createDataFrame(first + more, jobs.EVENT)))
    batches(rocks, tmp_path, [more], jobs.EVENT, lambda s: jobs.progress(s, stored), lambda k, state: [*map(tuple, [[None if x != x else x for x in r] for r in state.values()])] == want or pytest.fail(f"{state} {want}"))


def test_exam_progress_stream(rocks, tmp_path):
    """Equal to the batch after every batch; an exam whose jobs have all ended is withdrawn."""
    rng = random.Random(6)
    all_ = sorted((e for j in range(9) for e in events(rng, j, 8, ["start", "problem", "done"])), key=lambda e: e[1])
    ends = [(j, 99, "end", None, None, None, "canceled", None, None) for j in range(9) if j % 3 == 0 or j == 4]
    schema = f"{jobs.EVENT}, node_id long, kind string"
    parts = [[(*e, e[0] % 3, "solve") for e in p] for p in (all_[:40], all_[40:], ends)]

    def same(k, state):
        done = rocks.createDataFrame([e for p in parts[: k + 1] for e in p], schema)
        batch = jobs.progress_batch(done).withColumn("node_id", F.col("job_id") % 3).withColumn("kind", F.lit("solve"))
        assert sorted((r[0], r[3], r[4]) for r in state.values() if r[2]) == rows(jobs.exam_progress(batch, "solve"))
        if k == 2:
            assert [r[2] for r in state.values() if r[0] == 0] == [0]

    batches(rocks, tmp_path, parts, schema, jobs.exam_progress_stream, same)


def test_usage_windows_stream(rocks, tmp_path):
    now = int(time.time())
    call = lambda origin, age, tokens: (origin, json.dumps({"total_tokens": tokens}) if tokens is not None else "broken{", None if age is None else now - age)
    day, week = progress.DAY, progress.WEEK
    parts = [[call("a", 10, 1), call("a", day - 900, 2), call("a", day + 900, 4), call("a", week + 900, 8), call("a", None, 16), call("a", 5, None)], [call("a", 7, 32), call("b", week - 900, 64), call("b", -50, 1)]]
    want = [{"a": (3, 2, 7, 3, 31, 5)}, {"a": (35, 3, 39, 4, 63, 6), "b": (1, 1, 65, 2, 65, 2)}]
    schema = "origin string, usage_json string, s long"
    batches(rocks, tmp_path, parts, schema, lambda s: progress.usage_windows(s.withColumn("at", F.timestamp_seconds("s"))), lambda k, state: {o: tuple(map(int, r[1:])) for o, r in state.items()} == want[k] or pytest.fail(f"{k} {state}"))


def test_incremental_dedup(spark, tmp_path):
    schema = "seq long, problem_id long, raw_text string"
    path = str(tmp_path / "corpus")
    store = progress.dedup_into(path)
    parts = [[(1, 1, "1. a"), (2, 2, "2. a")], [(3, 3, "b"), (4, 4, "a"), (5, 5, "3) b")], [(6, 6, "c")]]
    for k, part in enumerate(parts):
        for _ in range(2):  # every batch comes again
            store(spark.createDataFrame(part, schema), k)
    assert sorted((r["problem_id"], r["epoch"]) for r in spark.read.parquet(path).collect()) == [(1, 0), (3, 1), (6, 2)]
    plan = spark.read.parquet(path).filter("bucket in ('aa')")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_event_fields(spark):
    cases = [("snapshot", "{}"), ("done", '{"no": 1, "transcript": null}'), ("done", '{"no": 1, "note": "n"}'), ("done", '{"no": 1}'), ("end", ""), ("error", "{}"), ("odd", "{}"), ("start", "[1]"), (None, None), ("problem", '{"no": 2, "route": "ai", "status": "waiting"}')]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, event string, data string").orderBy("i").select(tables.job_event(F.col("event"), F.col("data")).alias("e")).select("e.*").collect()
    assert [r["type"] for r in got] == ["snapshot", "done", "done", "done", "end", "error", "unknown", "unknown", "unknown", "problem"]
    assert [r["has_transcript"] for r in got] == [False, True, True] + [False] * 7
    assert (got[0]["status"], got[0]["total"], got[0]["done_count"], got[0]["no"], got[0]["text"]) == ("running", 0, 0, None, "") and got[2]["note"] == "n" and got[4]["status"] is None
    assert (got[5]["error_code"], got[5]["message"]) == ("unknown", tables.NO_MESSAGE) and (got[9]["route"], got[9]["status"]) == ("ai", "waiting")
