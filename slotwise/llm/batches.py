"""Python steps over Arrow batches that keep every value exact, such as large ids beside nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
         "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def _fields(fields: str) -> list[tuple[str, pa.DataType]]:
    return [(name, TYPES[kind]) for name, kind in (f.strip().split(" ") for f in fields.split(","))]


SLICE_BYTES = 1 << 20    # Arrow bytes that are Python objects at once


def slices(batches: Iterable[pa.RecordBatch]):
    """Record batches cut into pieces of about SLICE_BYTES, so that few rows are Python objects at a time."""
    for b in batches:
        step = max(1, min(b.num_rows, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def extend(df: DataFrame, make: Callable[[], Callable], reads: str | list[str], fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns row by row. make() runs once a task and returns a function from one row's `reads` to the new values.

    Columns named in `drop` are left out, all others pass through untouched.
    """
    reads, new = [reads] if isinstance(reads, str) else list(reads), _fields(fields)
    kept = [f.name for f in df.schema.fields if f.name not in drop]
    schema = StructType([f for f in df.schema.fields if f.name in kept] + StructType.fromDDL(fields).fields)

    def run(batches):
        one = make()
        for b in slices(batches):
            values = [one(*row) for row in zip(*(b.column(c).to_pylist() for c in reads))]
            columns = list(zip(*values)) or [()] * len(new)
            arrays = [b.column(c) for c in kept] + [pa.array(v, type=t) for v, (_, t) in zip(columns, new)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + [n for n, _ in new])
    return df.mapInArrow(run, schema)


def emit(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], fields: str) -> DataFrame:
    """Any number of rows from each row. make() runs once a task and returns a function from a row's values to tuples."""
    names, types = zip(*_fields(fields))
    reads = df.columns

    def run(batches):
        rows_of = make()
        for b in slices(batches):
            rows = [out for row in zip(*(b.column(c).to_pylist() for c in reads)) for out in rows_of(*row)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, types)], names=list(names))
    return df.mapInArrow(run, fields)
