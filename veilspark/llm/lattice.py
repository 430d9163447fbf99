"""Vectors of whole numbers in packed blocks, for jobs that run in rounds.

A round reads blocks and writes new ones to the shared folder; that cuts the
lineage, and what a lost executor held is read again.  Sums that a round needs
from all vectors leave each task as one array and are added up by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Vectors of a block.
BLOCK = 4096


def usable(vector: str) -> Column:
    """Neither null nor with null or non-finite components."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def largest(width: int) -> int:
    """The magnitude up to which squared distances of *width* components fit in a long."""
    return int(np.sqrt((1 << 62) / max(1, width)) / 2)


def whole_numbers(vectors: pa.Array, width: int, scale: int = 256) -> np.ndarray:
    """``floor(scale * x)`` of each component, held within :func:`largest`."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)
    top = largest(width)
    return np.clip(np.floor(flat * scale), -top, top).astype(np.int64)


def pack(x: np.ndarray) -> tuple[bytes, str]:
    """*x* in the narrowest kind of whole numbers that holds it."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))) - 1)
    kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


def unpack(data: bytes, kind: str, *shape: int) -> np.ndarray:
    """A read-only view of what :func:`pack` wrote."""
    return np.frombuffer(data, kind).reshape(shape)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of *x* to each of *centres*."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:  # sums of doubles are exact up to here
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    a = x.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in centres.astype(np.int64)], axis=1)


def pieces(batches, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def listed(values: pa.Array) -> pa.Array:
    """*values* as the one row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Layout:
    """The columns of a block, and the last row of a task, which holds its sums."""

    def __init__(self, kind: str):
        self.kind = f"{kind}, change array<long>"
        self.names = [c.split(" ")[0] for c in self.kind.split(", ")]

    def row(self, *values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*values, pa.nulls(1, pa.list_(pa.int64()))], names=self.names)

    def report(self, like: pa.RecordBatch, change: np.ndarray) -> pa.RecordBatch:
        empty = [pa.nulls(1, c.type) for c in like.columns[:-1]]
        return pa.RecordBatch.from_arrays([*empty, listed(pa.array(change.ravel()))], names=self.names)


def step(rows: DataFrame, run: Callable, layout: Layout, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Write what *run* makes of *rows*: the new blocks, and the tasks' sums by position in ``change``."""
    written = stage(rows.mapInArrow(run, layout.kind), name)
    found = written.where("change is not null").select(F.posexplode("change").alias("at", "x"))
    # as many rows as a task has sums, whatever the input
    sums = found.where("x <> 0").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    return written.where("change is null").drop("change"), {r.at: int(r.x) for r in sums}
