"""Python over the rows of each group, with no more than one group and one Arrow batch in memory."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one batch of results.
BATCH = 10_000


def grouped(rows: DataFrame, by: list[str], columns: tuple[str, ...], found: Callable, fields: str, order: tuple[Column, ...] = ()) -> DataFrame:
    """(``by``, ``fields``): what ``found`` gives, as tuples, for the columns of each group as tuples in order of ``order`` and of the columns themselves.

    Rows are dealt and sorted by group and come to Python as they are, so a batch holds so many rows and not so many groups. Null numbers with a fraction are NaN.
    """
    schema = StructType([*(rows.schema[k] for k in by), *StructType.fromDDL(fields)])
    arrow, n = to_arrow_schema(schema), len(by)

    def values(column: pa.Array, fraction_nulls: bool) -> list:
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_string(kind)):
            return column.to_pylist()
        # by NumPy, as to_pylist makes a scalar of each value first
        if not column.null_count or pa.types.is_string(kind):
            return column.to_numpy(zero_copy_only=False).tolist()
        out = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
        none = None if fraction_nulls or not pa.types.is_floating(kind) else float("nan")
        for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0]:
            out[i] = none
        return out

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def scan(batches):
        stream = (row for b in batches for row in zip(*(values(c, i < n) for i, c in enumerate(b.columns)), strict=True))
        out: list[tuple] = []
        for key, own in groupby(stream, itemgetter(slice(n))):
            out += (key + row for row in found(*list(zip(*own, strict=True))[n:]))
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return rows.repartition(*by).sortWithinPartitions(*by, *order, *columns).select(*by, *columns).mapInArrow(scan, schema)
