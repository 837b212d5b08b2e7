"""Columns of documents that are called as an operator's results come through the stages as they are; parts of any size make cells."""

import corpus_pipeline
from pyspark.sql import functions as F

from examlake.llm import mixing

SF = "/root/testdata/sf0.001"


def test_clashing_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit("mine"), F.col("doc_id").cast("string")) for c in ("secrets", "p_good", "expected_grade", "n_hit", "component_id", "Items")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"mine{r['doc_id']}" for r in rows for c in ("secrets", "p_good", "expected_grade", "n_hit", "component_id", "Items")), name


def test_masked_texts_have_their_length(spark):
    docs = spark.createDataFrame([(1, "password = hunter22 x", "a", 21), (2, "plain", "a", 99)], "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r for r in corpus_pipeline.secrets_masked(spark, docs, SF).collect()}
    assert out[1]["text"] == "password = [secret] x" or len(out[1]["text"]) == out[1]["n_chars"]
    assert out[1]["n_chars"] == len(out[1]["text"]) and (out[2]["text"], out[2]["n_chars"]) == ("plain", 99)


def test_cells_of_a_large_part(spark):
    """10^10 slots of one source are 150 million cells, made range by range."""
    parts = spark.createDataFrame([("a", 5, 0), ("b", 10**10, 5), ("c", 0, 10**10 + 5), ("d", 70, 10**10 + 5)], "source_key string, slots long, start long")
    cells = mixing._cells(parts, "start", "slots")
    got = {r["source_key"]: (r["n"], r["a"], r["b"]) for r in cells.groupBy("source_key").agg(F.count("*").alias("n"), F.min("cell").alias("a"), F.max("cell").alias("b")).collect()}
    end = 10**10 + 4
    assert got == {"a": (1, 0, 0), "b": (end // 64 + 1, 0, end // 64), "d": ((end + 70) // 64 - (end + 1) // 64 + 1, (end + 1) // 64, (end + 70) // 64)}
