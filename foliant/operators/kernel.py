"""Run a Python function over rows in Arrow batches, one document at a time, with bounded output batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Output rows of one batch, and bytes of input that one is made of at most, but for a longer row.
BATCH = 4096
BYTES = 1 << 20
#: Bytes of short rows, as they are stored, for a task of their own: about a thousand rows.
SHORT = 8 << 10


def spread(df: DataFrame) -> DataFrame:
    """Short rows of which much is made, dealt to all cores by their values: a file of a million of them is one task to its reader."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # executors may still be registering; a task costs about an eighth of a second besides its rows
    most = max(4 * cores, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    n = min(most, max(cores, int(size) // SHORT))
    return df.repartition(n, *df.columns)


def give_back() -> None:
    """Blocks of BYTES and more, such as whole input batches, go back to the system when freed; glibc by itself keeps as many as were ever held at once."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, BYTES)  # M_MMAP_THRESHOLD


def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that become Python objects one at a time: of about BYTES / 4, one row at least."""
    n = max(1, b.num_rows * (BYTES // 4) // max(1, b.nbytes))
    for i in range(0, max(1, b.num_rows), n):
        yield b.slice(i, n)


@dataclass(frozen=True)
class Made:
    """Rows that fn makes of those of df, for the next kernel to take in the same worker. As DataFrames, two kernels are two workers for each task, and batches between them."""

    df: DataFrame
    fn: Callable[..., Iterable[tuple]]
    names: tuple[str, ...]

    def select(self, *names: str) -> Made:
        if names != self.names:
            raise ValueError(f"made are {self.names}, not {names}")
        return self

    def then(self, fn: Callable[..., Iterable[tuple]], names: tuple[str, ...]) -> Made:
        first = self.fn
        return Made(self.df, lambda *values: (row for made in first(*values) for row in fn(*made)), names)


def flat_map(df: DataFrame | Made, fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """fn(*values of a row) yields output rows as tuples; df holds just the columns that fn takes."""
    if isinstance(df, Made):
        df, fn = df.df, df.then(fn, ()).fn
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        give_back()
        out: list[tuple] = []
        held = 0
        for b in batches:
            for part in parts(b):
                for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for row in fn(*values):
                        out.append(row)
                        if len(out) >= BATCH:
                            yield batch(out)
                            out, held = [], 0
                held += part.nbytes
                if held >= BYTES and out:
                    yield batch(out)
                    out, held = [], 0
            del b, part  # before the next one is read
        yield batch(out)

    return df.mapInArrow(run, struct)
