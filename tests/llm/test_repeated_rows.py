"""The pipeline's near-duplicate stage on repeated rows, rows without an id and rows of one id with different texts."""

import corpus_pipeline


def test_of_rows_alike_one_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [
        (1, a, "x", 1), (1, a, "x", 1), (1, a, "w", 2), (2, a, "x", 3),  # copies of a: one of id 1 stays, the first by its other columns
        (3, b, "x", 4), (4, b + " more", "x", 5),  # near copies
        (5, c, "x", 6), (5, "other words", "x", 7), (5, c, "x", 6),  # one id, two texts
        (None, c, "y", 8), (None, c, "y", 8), (None, None, "y", 9), (6, None, None, None), (7, "", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, a, "w", 2), (3, b, "x", 4), (5, c, "x", 6), (5, "other words", "x", 7), (None, c, "y", 8), (None, None, "y", 9), (6, None, None, None), (7, "", "x", 1)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_only_id_and_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "one two")], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()] == [(1, "one two")]
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0
