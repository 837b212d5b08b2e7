"""Small things that several operators need: the shared folder, written tables, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set in the session. Where there is none, a new one for a local master (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_results(df: DataFrame, results: str, without: str | None = None) -> tuple[DataFrame, StructType]:
    """``df`` without columns that have a result's name, and the schema of its columns (less ``without``) and the results: a result replaces a column of its name."""
    added = StructType.fromDDL(results)
    df = df.drop(*added.names)
    return df, StructType([*(f for f in df.schema.fields if f.name != without), *added.fields])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A string column without nulls (null: empty text)."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that working arrays stay small; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def smallest(df: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those of the smallest ``by``, a 64-bit hash; ties by the other columns.

    Hashes are spread evenly, so a count gives a bound that somewhat more than ``most`` rows stay below (8 standard deviations
    more); without it every task would hand ``most`` rows to the one that takes the limit.
    """
    n = df.count()
    if n > most:
        bound = int(2**64 * min(1.0, (most + 8 * most**0.5 + 64) / n)) - 2**63
        df = df.filter(F.col(by) <= min(bound, 2**63 - 1))
    return df.orderBy(by, *(c for c in df.columns if c != by)).limit(most)
