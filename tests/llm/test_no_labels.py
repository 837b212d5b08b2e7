"""The decision of the quality classifier without labels."""

from pyspark.sql import functions as F

import corpus_pipeline
from examlake.llm import queries

SF = "/root/testdata/sf0.001"


def test_without_labels_everything_with_words_is_kept(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.filter("false").write.parquet(str(tmp_path / "none/labels.parquet"))
    labels.withColumn("quality", F.lit(None).cast("int")).write.parquet(str(tmp_path / "null/labels.parquet"))
    texts = [(1, "one two", "en", "s", 7), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1), (3, " \n\t", "en", "s", 3), (4, "", "en", "s", 0), (5, None, "en", "s", 0), (None, "日本", "en", "s", 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    for at in ("none", "null"):
        assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path / at)).collect()) == [0, 1, 2, 2]
        docs.write.mode("overwrite").parquet(str(tmp_path / at / "documents.parquet"))
        kept = queries.op3_quality_classifier(spark, str(tmp_path / at)).filter("kept").collect()
        assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 2]
