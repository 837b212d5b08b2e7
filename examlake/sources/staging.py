"""Intermediate tables of jobs that read their own results again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set in the session; one of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it ends the lineage and the plan, and its size is known to later joins.

    A checkpoint would keep the plan's constraints, which grow with every round of a loop until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
