"""R of the QR factorisation of a table's columns, by a tree of small factorisations.

A task factorises its rows batch by batch and keeps one R, of the size of the columns; the Rs
are dealt to FAN tasks and then to one, which stack and factorise them again. A Gram
matrix squares the columns' condition and can't tell columns apart that differ by less than
1e-8 relative; R keeps them apart down to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks of the tree's second level.
FAN = 32


def r_factor(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R, with a diagonal that isn't negative, of the columns' values without nulls; zeros for a table without rows."""
    k = len(columns)
    if not k:
        return np.zeros((0, 0))

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((0, k))
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
            own = np.linalg.qr(np.vstack([own, flat.reshape(-1, k)]), mode="r")
        if len(own):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * k, pa.int32()), pa.array(own.ravel()))
            yield pa.record_batch([lists], ["v"])

    values = [F.col(f"`{c}`").cast("double") for c in columns]
    rows = df.select(F.array(*values).alias("v")).filter(~F.exists("v", lambda x: x.isNull()))
    factors = rows
    for parts in (None, FAN, 1):
        factors = (factors.repartition(parts) if parts else factors).mapInArrow(reduce_rows, "v array<double>")
    flat = factors.toArrow()["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((k, k))
    got = np.linalg.qr(flat.reshape(-1, k), mode="r")
    out[: len(got)] = got
    return out * np.where(np.diag(out) < 0, -1.0, 1.0)[:, None]


def independent(df: DataFrame, columns: list[str], intercept: bool = True, tolerance: float = 1e-10) -> list[str]:
    """The columns that add something to the intercept and to those before them.

    What is left of a column must exceed ``tolerance`` of its length; a column without length
    goes. Only kept columns count for the later ones, so the rounding errors of a dropped one
    are no direction of their own.
    """
    table = df.select(*([F.lit(1.0).alias("_one")] if intercept else []), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    r = r_factor(table, table.columns)
    kept: list[int] = []
    for j in range(r.shape[1]):
        column = r[: j + 1, j]
        length = np.linalg.norm(column)
        basis = np.linalg.qr(r[:, kept])[0] if kept else np.zeros((len(r), 0))
        rest = r[:, j] - basis @ (basis.T @ r[:, j])
        rest -= basis @ (basis.T @ rest)
        if length > 0 and np.linalg.norm(rest) > tolerance * length:
            kept.append(j)
    first = int(intercept)
    return [columns[j - first] for j in kept if j >= first]
