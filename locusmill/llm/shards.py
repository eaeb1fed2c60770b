"""Cell-wise sums of arrays that many tasks give, without one task or the driver holding them all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = "slice int, cells binary"


def slices_of(cells: np.ndarray, first: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(slice, packed cells) of a flat array in parts of ``size`` cells, numbered from ``first``; parts of zeros are left out."""
    for i, at in enumerate(range(0, len(cells), size)):
        part = cells[at : at + size]
        if part.any():
            yield first + i, zlib.compress(part.tobytes(), 1)


def slice_batch(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s for s, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], ["slice", "cells"])


def held_sums(batches: Iterator[pa.RecordBatch], dtype: np.dtype, cap: int | None = None) -> dict[int, np.ndarray]:
    """The sums of all rows of each slice of a task."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cells = np.frombuffer(zlib.decompress(packed), dtype)
            if s in held:
                cells = held[s] + cells
            held[s] = cells if cap is None else np.minimum(cells, dtype.type(cap))
    return held


def sum_slices(parts: DataFrame, dtype: np.dtype, tasks: int, cap: int | None = None) -> DataFrame:
    """(slice, cells): sums of the rows of each slice, at most ``cap`` a cell.

    Rows are streamed, so a task holds the sums of its own slices only, however many rows they have.
    """
    dtype = np.dtype(dtype)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield slice_batch([(s, zlib.compress(c.tobytes(), 1)) for s, c in held_sums(batches, dtype, cap).items()])

    return parts.select("slice", "cells").repartition(tasks, "slice").mapInArrow(add, SLICE)


def gathered(sums: DataFrame, dtype: np.dtype, size: int, total: int) -> np.ndarray:
    """The whole summed array on the driver; ``total`` follows from parameters or dimensions, never from the number of rows."""
    out = np.zeros(total, dtype)
    for row in sums.toLocalIterator():
        cells = np.frombuffer(zlib.decompress(row["cells"]), dtype)
        out[row["slice"] * size : row["slice"] * size + len(cells)] = cells
    return out
