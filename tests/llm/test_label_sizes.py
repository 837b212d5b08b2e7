"""op7's links do not depend on how large a label is."""

import inspect

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
from examlake.llm import embeddings, queries  # noqa: E402


def test_no_size_turns_to_hash_tables(spark, tmp_path, monkeypatch):
    """Labels of more than 32,768 classes lost 56 of 10,000 planted links; a label's size is no parameter of the query now."""
    assert inspect.signature(embeddings.near_embeddings).parameters["whole"].default is None
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    base = np.random.default_rng(3).standard_normal((300, 64))
    x = np.concatenate([base, base + 0.01])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(600), "embedding": x.tolist(), "label": ["a"] * 600}))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op7_embedding_near_dedup(spark, str(tmp_path)).toPandas().sort_values("vec_id")
    assert got["n_links"].tolist() == [1] * 600 and got["component_id"].tolist() == [*range(300)] * 2
