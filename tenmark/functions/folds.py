"""Ordered folds per key over sorted partitions.

One shuffle by key and one sort; then each partition is read as a stream, and a fold gets its key's rows one by
one, so a key of any size costs what the fold itself keeps. A grouped Pandas call costs milliseconds for each key
and holds it whole; this costs microseconds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SIZE = 4096


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """``fold`` gets an iterator of each key's rows, in order, as tuples of ``rows``' columns, and gives rows of ``schema``."""
    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)
    at = [rows.columns.index(k) for k in keys]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        parts = (b.slice(lo, SIZE) for b in it for lo in range(0, b.num_rows, SIZE))
        stream = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for _, own in itertools.groupby(stream, lambda row: tuple(row[k] for k in at)):
            for made in fold(own):
                out.append(made)
                if len(out) >= SIZE:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
