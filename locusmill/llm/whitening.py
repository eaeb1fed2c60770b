"""Embedding whitening by shifted CholeskyQR (operator 13).

The distinct integer vectors are centred exactly and orthogonalised in place: a pass over the
rows gives the Gram matrix of Q, its (first shifted) Cholesky factor R_k goes to the tasks, and
the next pass reads the rows through one more triangular solve, until the Gram matrix of
Q = A R_1^-1 R_2^-1 ... is the identity on the range of A. The composed R has A's singular
values, its SVD gives the components, and the whitened rows are Q times small vectors, so they
are orthonormal to rounding however ill-conditioned A is. Only d x d matrices (d: dimensions)
leave the tasks.

Output, one row for each row that takes part and each component: ``n`` and ``deviation``
(exact), ``whitened``, ``explained`` and ``identity_error``.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no
part, nor do those with an entry of 2^46 or more in size (its integer form leaves the exact
range of a double) and those whose length isn't the most frequent one (ties: the longer).
Repeated vectors count once in the fit and get equal rows. Directions whose standard deviation
is under 1e-11 of the largest have no component: vectors that are all equal, or a single one,
give no rows, nor does an empty table. A deviation beyond 64 bits is null. Other columns,
whatever their names, are ignored; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialise
from .shards import SLICE, gathered, slice_batch, slices_of, sum_slices

_CELLS = 1 << 17
_LOW = (1 << 26) - 1


def integer_vectors(df: DataFrame, vector: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``x``: floor(scale * c) + offset of every entry, for rows whose vector takes part; other columns stay."""
    c = F.col(f"`{vector}`")
    sound = c.isNotNull() & (F.size(c) > 0) & F.coalesce(F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < 2.0**46)), F.lit(False))
    out = df.filter(sound).withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long") + offset))
    lengths = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _rows(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _summed(fit: DataFrame, fn, dtype, total: int) -> np.ndarray:
    """Sum over all rows of fn(x block), an array of ``total`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total, dtype)
        for batch in batches:
            if batch.num_rows:
                sums += fn(_rows(batch.column(0))).ravel()
        yield slice_batch(list(slices_of(sums, 0, _CELLS)))

    tasks = min(-(-total // _CELLS), int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return gathered(sum_slices(fit.select("x").mapInArrow(run, SLICE), dtype, tasks), dtype, _CELLS, total)


@dataclass(frozen=True)
class Whitening:
    """A fit: everything the tasks need to whiten rows; d x d numbers."""

    n: int
    centre: np.ndarray  # nearest integers to the means
    rest: np.ndarray  # S - n * centre, at most n / 2 in size
    factors: tuple[np.ndarray, ...]  # R_1, R_2, ...
    coef: np.ndarray  # d x components: whitened = Q coef
    components: np.ndarray  # unit eigenvectors, one a column
    explained: np.ndarray
    identity_error: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where they suffice, else in Python's integers."""
        u = x - self.centre
        if len(u) and float(np.abs(u).max()) * self.n > 2.0**61:
            u = u.astype(object)
        return u * self.n - self.rest

    def orthogonal(self, scaled: np.ndarray) -> np.ndarray:
        q = scaled.astype(float) / self.n
        for r in self.factors:
            q = np.linalg.solve(r.T, q.T).T
        return q

    def deviations(self, scaled: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; None beyond 64 bits."""
        if scaled.dtype != object and (scaled.astype(float) ** 2).sum(1).max(initial=0.0) < 2.0**62:
            return (scaled * scaled).sum(1).tolist()
        sums = (sum(int(v) ** 2 for v in row) for row in scaled)
        return [s if s < 1 << 63 else None for s in sums]


def fit_whitening(vectors: DataFrame, most: int = 16, passes: int = 8) -> Whitening | None:
    """Fit on the distinct vectors of ``x``; None where there are none."""
    fit = materialise(vectors.select("x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        return None
    d, n = len(first["x"]), fit.count()
    # sums in two halves: 64 bits hold them for 2^36 vectors
    halves = _summed(fit, lambda x: np.stack([(x >> 26).sum(0), (x & _LOW).sum(0)]), np.int64, 2 * d)
    total = [(int(hi) << 26) + int(lo) for hi, lo in zip(halves[:d], halves[d:])]
    centre = [(2 * s + n) // (2 * n) for s in total]
    known = Whitening(n, np.array(centre), np.array([s - n * c for s, c in zip(total, centre)]), (), np.zeros((d, 0)), np.zeros((d, 0)), np.zeros(0), 0.0)
    r = np.eye(d)
    for _ in range(passes):
        now = known

        def gram(x: np.ndarray) -> np.ndarray:
            q = now.orthogonal(now.scaled(x))
            return q.T @ q

        g = _summed(fit, gram, np.float64, d * d).reshape(d, d)
        if not g.any():
            return known
        eigen = np.linalg.eigvalsh(g)
        # on the range of A the Gram matrix is the identity, elsewhere nothing
        if known.factors and np.abs(g @ g - g).max() < 1e-10:
            break
        shift = 0.0 if known.factors and eigen[0] > 0.1 else 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * eigen[-1]
        factor = np.linalg.cholesky(g + min(shift, 0.01 * eigen[-1]) * np.eye(d)).T
        r = factor @ r
        known = Whitening(n, known.centre, known.rest, (*known.factors, factor), known.coef, known.components, known.explained, 0.0)
    values, sides = np.linalg.eigh(g)
    last = np.sqrt(np.maximum(values, 0.0))[:, None] * sides.T  # G = last' last, so A'A = (last R)'(last R)
    _, s, wt = np.linalg.svd(last @ r)
    kept = np.flatnonzero(s > 1e-11 * s[0])[:most]
    coef = (r @ wt[kept].T) / s[kept] * np.sqrt(n)
    known = Whitening(n, known.centre, known.rest, known.factors, coef, wt[kept].T, s[kept] ** 2 / (s**2).sum(), 0.0)
    k = len(kept)

    def moments(x: np.ndarray) -> np.ndarray:
        z = known.orthogonal(known.scaled(x)) @ known.coef
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    m = _summed(fit, moments, np.float64, k * k + k) / n
    error = np.abs(m[: k * k].reshape(k, k) - np.outer(m[k * k :], m[k * k :]) - np.eye(k)).max(initial=0.0)
    return Whitening(n, known.centre, known.rest, known.factors, coef, known.components, known.explained, float(error))


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, fit: Whitening, key: str) -> DataFrame:
    """(key, component, ...): one row for each row of ``x`` and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(fit)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = w.coef.shape[1]
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            scaled = w.scaled(_rows(batch.column(1)))
            z = w.orthogonal(scaled) @ w.coef
            each = np.repeat(np.arange(len(z)), k)
            deviation = pa.array(w.deviations(scaled), pa.int64())
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(each), w.n)), deviation.take(pa.array(each)),
                       pa.array(z.ravel()), pa.array(np.tile(w.explained, len(z))), pa.array(np.full(len(each), w.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, [key, *[c.split()[0] for c in _OUT.split(", ")]])

    return vectors.select(key, "x").mapInArrow(run, f"`{key}` {kind}, {_OUT}")


def whiten_embeddings(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 16) -> DataFrame:
    """Fit and whiten the vectors of a table."""
    vectors = integer_vectors(df.select(key, vector), vector)
    fit = fit_whitening(vectors, most)
    if fit is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {df.schema[key].dataType.simpleString()}, {_OUT}")
    return whiten(vectors, fit, key)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
