"""Exact top-k inner products over a bit-sliced index (operator 7).

Rows are packed into blocks. In a block every attribute (a quantised component, less the
block's minimum) is cut into binary slices, and each slice is a bitmap over the block's rows.
A query's score is a weighted sum of attributes, so the index adds, for every binary digit
of a weight, the attribute's slices at that digit's place to the slices of the sum, by
ripple-carry addition on bitmaps; a negative weight adds the complement. The top rows are
then selected from the sum's most significant slice downward: rows that have the slice's
bit go on as long as they are at least k, and are taken where they are fewer. What remains
at the boundary ties, and is resolved by row id. All steps work on whole bitmaps of a tile
of queries at once.

Query blocks meet row blocks by a join on block groups; each block pair gives at most k
rows a query, and a ranking a query keeps the best. Nothing but blocks is held by a task.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows
with a null id take no part; shorter vectors count as padded with zeros; components have no
bound, sums that don't fit 62 bits are added as whole numbers of any length and a score
beyond a long is shown as the nearest long; a repeated query id is one query, with the
smallest of its vectors; repeated candidates are candidates each; ties go to the smaller
id; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import materialise

SCALE = 1024
ROW_BLOCK = 8192
QUERY_BLOCK = 512
_TILE = 64
#: Sums of more binary digits leave the bitmaps.
_DIGITS = 62


def quantise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of the usable vectors (whole numbers, exact as doubles), padded to one width, and their places."""
    usable, rows = [], []
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    plain = not column.null_count and not column.values.null_count and len(column) and (sizes == sizes[0]).all() and sizes[0]
    with np.errstate(over="ignore"):
        if plain:
            x = np.floor(SCALE * column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1))
            at = np.flatnonzero(np.isfinite(x).all(axis=1))
            return x[at], at
        for i, v in enumerate(column):
            v = v.as_py()
            x = None if v is None or None in v else np.floor(SCALE * np.asarray(v, np.float64))
            if x is not None and np.isfinite(x).all():
                usable.append(i)
                rows.append(x)
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, np.array(usable, np.int64)


_BLOCK = "n long, width long, ids binary, vectors binary"


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` usable vectors of (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array([len(ids)]), pa.array([x.shape[1]]), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary())], ["n", "width", "ids", "vectors"])

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            width = max(x.shape[1] for _, x in held)
            ids = np.concatenate([i for i, _ in held])
            x = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held])
            held.clear()
            at = 0
            while len(ids) - at >= least and at < len(ids):
                yield block(ids[at : at + rows], x[at : at + rows])
                at += rows
            if at < len(ids):
                held.append((ids[at:], x[at:]))

        for batch in batches:
            x, at = quantise(batch.column("embedding"))
            if len(at):
                held.append((batch.column("vec_id").to_numpy(zero_copy_only=False)[at], x))
                if sum(len(i) for i, _ in held) >= rows:
                    yield from flush(rows)
        yield from flush(1)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null").mapInArrow(run, _BLOCK)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans (their number a multiple of 64) as words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """Attribute slices of a block of rows: bitmaps over the rows, least significant first."""

    def __init__(self, x: np.ndarray) -> None:
        self.n = len(x)
        padded = np.zeros((-(-self.n // 64) * 64, x.shape[1]), np.int64)
        self.low = x.min(axis=0)
        padded[: self.n] = x - self.low
        self.bits = [int(m).bit_length() for m in padded.max(axis=0)]
        self.slices = [[_bitmap((padded[:, d] >> b & 1).astype(bool)) for b in range(self.bits[d])] for d in range(x.shape[1])]
        self.rows = _bitmap(np.arange(len(padded)) < self.n)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices (queries, words) of every row's sum for each query, and what to add to the sums to get the scores."""
        total: list[np.ndarray] = []
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        shift = q @ self.low
        for d, own in enumerate(self.slices):
            weight = q[:, d]
            negative = weight < 0
            shift = shift + np.where(negative, weight * ((1 << self.bits[d]) - 1), 0)
            flip = np.where(negative, ones, np.uint64(0))[:, None]
            size = np.abs(weight)
            for digit in range(int(size.max(initial=0)).bit_length()):
                wanted = np.where(size >> digit & 1 == 1, ones, np.uint64(0))[:, None]
                if not wanted.any() or not own:
                    continue
                carry = None
                at = digit
                while at - digit < len(own) or carry is not None:
                    while len(total) <= at:
                        total.append(np.zeros((len(q), len(self.rows)), np.uint64))
                    s = total[at]
                    if at - digit < len(own):
                        add = (own[at - digit] ^ flip) & wanted
                        half = s ^ add
                        up = s & add
                        if carry is not None:
                            up |= half & carry
                            half ^= carry
                    else:
                        half = s ^ carry
                        up = s & carry
                    total[at] = half
                    carry = up if up.any() else None
                    at += 1
        return total, shift


def select_top(sums: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (queries, words) of the rows that are surely among the k highest sums, and of those that tie for the last places."""
    sure, open_ = np.zeros_like(rows), rows.copy()
    count = lambda b: np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    for s in reversed(sums):
        high = open_ & s
        both = sure | high
        n = count(both)
        many = (n >= k)[:, None]
        sure = np.where(many, sure, both)
        open_ = np.where(many, high, open_ & ~s)
    return sure, open_


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def block_top(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows of a block."""
    width = max(x.shape[1], q.shape[1], 1)
    x, q = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, q))
    out: tuple[list, list, list] = ([], [], [])
    largest = lambda v: int(np.abs(v).max(initial=0)).bit_length()
    if not len(x) or not len(q):
        return tuple(np.zeros(0, np.int64) for _ in out)
    if largest(x) + largest(q) + width.bit_length() + 2 > _DIGITS:
        return _long_top(ids, x, q_ids, q, k)
    x, q = x.astype(np.int64), q.astype(np.int64)
    block = SlicedBlock(x)
    for t in range(0, len(q), _TILE):
        weights = q[t : t + _TILE]
        sums, _ = block.sums(weights)
        own = np.zeros((len(weights), len(block.rows) * 64), bool)
        own[:, : block.n] = q_ids[t : t + _TILE, None] == ids[None, :]
        sure, tie = select_top(sums, block.rows & ~_bitmap(own), k)
        for i in range(len(weights)):
            at, even = (np.flatnonzero(np.unpackbits(b[i].view(np.uint8), bitorder="little")) for b in (sure, tie))
            # rows of the boundary tie in every slice: the smaller ids have it
            left = k - len(at)
            if len(even) > left:
                even = even[np.argsort(ids[even], kind="stable")[:left]]
            at = np.concatenate([at, even])
            score = x[at] @ weights[i]
            best = _best(ids[at], score, k)
            for column, values in zip(out, (np.full(len(best), q_ids[t + i]), ids[at[best]], score[best])):
                column.append(values)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *o]) for o in out)


def _long_top(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for components so large that sums need whole numbers of any length."""
    rows, out = [[int(v) for v in r] for r in x], []
    for name, weights in zip(q_ids.tolist(), q):
        w = [int(v) for v in weights]
        scored = sorted((-sum(a * b for a, b in zip(r, w)), i) for r, i in zip(rows, ids.tolist()) if i != name)[:k]
        out += [(name, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for s, i in scored]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with other ids."""
    asked = materialise(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    q = materialise(pack(asked.repartition(parts), QUERY_BLOCK), "query-blocks")
    rows = materialise(pack(vectors, ROW_BLOCK), "row-blocks")
    # every query block meets every group of row blocks, a block or so each
    groups = max(1, rows.count())
    rows = rows.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "vectors")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                read = lambda p: (np.frombuffer(r[f"{p}ids"], np.int64), np.frombuffer(r[f"{p}vectors"], np.float64).reshape(r[f"{p}n"], r[f"{p}width"]))  # noqa: E731, B023
                found = block_top(*read(""), *read("q_"), k)
                yield pa.record_batch([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    best = rows.join(q, "group").drop("group").mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
