"""Per-key writes and the index of jobs."""

import random

from pyspark.sql import functions as F

from examlake.operators import planning
from examlake.sources import tables


def test_writes_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "node_id long, no int, v string"
    read = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(path).select("node_id", "no", "v").collect()))
    put = lambda rows: tables.write(spark.createDataFrame(rows, schema), path, ["node_id"], ["node_id", "no"])
    put([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    for _ in range(2):
        put([(1, 2, "B"), (3, 1, "d"), (3, 1, "e")])
        assert read() == [(1, 1, "a"), (1, 2, "B"), (2, 1, "c"), (3, 1, "e")]
    put([])
    assert len(read()) == 4
    whole = str(tmp_path / "w")
    for rows in ([(1, 1, "a"), (None, 2, "b")], [(None, 2, "c")]):
        tables.write(spark.createDataFrame(rows, schema), whole, keys=["node_id", "no"])
    assert sorted(r["v"] for r in spark.read.parquet(whole).collect()) == ["a", "c"]


def test_a_stopped_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(spark.createDataFrame([(1, 1)], "k int, v int"), path, ["k"], ["k"])
    bad = spark.createDataFrame([(1, 2)], "k int, v int").withColumn("v", F.when(F.col("v") > 1, F.raise_error("stop")).otherwise(F.col("v")).cast("int"))
    try:
        tables.write(bad, path, ["k"], ["k"])
        raise AssertionError
    except Exception as e:
        assert "stop" in str(e)
    assert [tuple(r) for r in spark.read.schema("k int, v int").parquet(path).select("k", "v").collect()] == [(1, 1)]


def test_overlapping_jobs_by_brute_force(spark):
    rng = random.Random(8)
    some = lambda of: rng.choice([None, [], rng.sample(of, 1), rng.sample(of, 2), [of[0], None]])
    make = lambda i: (i, rng.randrange(3), rng.choice(["solve", "variant", "ocr"]), some([1, 2, 3, 4]), some(["number", "condition", "x"]))
    jobs = [(*make(i), rng.choice(["queued", "running", "done"]), rng.randrange(9)) for i in range(60)]
    requests = [make(i) for i in range(80)]
    kind = "node_id long, kind string, targets array<int>, modes array<string>"
    got = planning.overlapping_job(spark.createDataFrame(requests, f"request_id long, {kind}"), spark.createDataFrame(jobs, f"job_id long, {kind}, status string, created_at long")).collect()
    meets = lambda a, b: a is None or b is None or bool(set(a) & set(b) - {None})
    for r in got:
        hits = [(j[6], j[0]) for j in jobs if j[1] == r["node_id"] and j[2] == r["kind"] and j[5] != "done" and (j[2] == "ocr" or (meets(r["targets"], j[3]) and (j[2] != "variant" or meets(r["modes"], j[4]))))]
        assert r["job_id"] == (min(hits)[1] if hits else None)
    many = spark.range(20_000).selectExpr("id as request_id", "1L as node_id", "'solve' as kind", "if(id % 3 = 0, null, array(cast(id % 50 as int)))  as targets", "cast(null as array<string>) as modes")
    out = planning.overlapping_job(many, many.withColumnRenamed("request_id", "job_id").withColumn("status", F.lit("queued")).withColumn("created_at", -F.col("job_id")))
    assert out.filter("job_id is null").count() == 0 and out.count() == 20_000
