"""Mixed null models where a family is too large for a dense inverse.

The covariance is never inverted and no family is gathered. Rows are numbered by family and dealt to
blocks of ``BLOCK`` rows; the kernels' entries are packed by the block of their column. S Z, with
S the inverse covariance, is found for all columns Z at once by conjugate gradients with the
covariance's diagonal as preconditioner: an iteration multiplies each block's search directions by the
entries of its columns, sums the pieces of a row block by one shuffle and writes the new state, so
a lost executor repeats one iteration at most. Only inner products leave the tasks.

tr(S K) is the mean of u' S K u over ``probes`` columns of random signs, drawn by block and the same at
every step, so the search runs on one smooth function. Their spread gives ``tau_error``: the standard
error of the components that is due to the probes. It falls with the root of rows times probes.

``OneFamily`` answers the same questions as ``mixed.Stacks``; Gaussian traits only, one search of
directions a trait.

Defined cases: rows without a covariate take no part; rows without a trait have no line in its
covariance; kernels may be empty; a pair may have one entry a kernel in each direction. Covariances
that aren't positive definite, or too ill-conditioned for ``most`` iterations, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import repeated_measure_kernel, with_row_index
from .mixed import SAME_SUBJECT, Ask, Stacks, Trait, _read_information, families
from .shared import forget, materialise

BLOCK = 1024
#: Entries of a packed group of kernel entries, on average.
GROUP = 1 << 18
_STATE = "b long, spread binary, scale binary, cells binary, dots array<double>"


def family_sizes(rows: DataFrame, kernels: list[DataFrame | str]) -> DataFrame:
    """rows with ``family``, written."""
    return materialise(families(rows, kernels), "labelled")


def largest_family(labelled: DataFrame) -> int:
    return labelled.groupBy("family").count().agg(F.max("count")).first()[0] or 0


def stacks_for(rows: DataFrame, kernels: list[DataFrame | str], covariates: list[str], largest: int = 4096, probes: int = 32) -> Stacks | OneFamily:
    """Dense stacks where no family has more than ``largest`` rows, else conjugate gradients with ``probes`` columns of signs."""
    labelled = family_sizes(rows, kernels)
    if largest_family(labelled) <= largest:
        return Stacks(labelled, kernels, covariates)
    ones = lambda: materialise(repeated_measure_kernel(labelled.select(F.col("subject").alias("sample_id"), "row_idx")), "kernel")
    return OneFamily(labelled, [ones() if k is SAME_SUBJECT else k for k in kernels], covariates, probes)


def _cells(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(shape)


def _entry_sums(weights: np.ndarray, width: int):
    """Packed entries with the vectors of their columns' block to pieces (b, at, piece): sums by row for each line of weights."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                v = _cells(r["cells"], -1, width)
                to, col, k, value = (np.frombuffer(r[c], t) for c, t in (("to", np.int64), ("col", np.int32), ("k", np.int32), ("value", float)))
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                out = np.empty((len(first), len(weights), width))
                for i, w in enumerate(weights):
                    scaled = w[k] * value
                    # a few columns at a time, so that the products of a group stay small
                    for c in range(0, width, 8):
                        out[:, i, c : c + 8] = np.add.reduceat(v[col, c : c + 8] * scaled[:, None], first)
                rows, block = to[first], to[first] // BLOCK
                cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                for x, y in zip(cut, [*cut[1:], len(block)]):
                    yield pa.record_batch([pa.array([int(block[x])]), pa.array([(rows[x:y] % BLOCK).astype(np.int32).tobytes()]), pa.array([out[x:y].tobytes()])], ["b", "at", "piece"])

    return run


class OneFamily:
    """Rows of one study with large families, and the sums over them.

    rows: (row_idx, family, y array<double> with NaN where a trait is missing, covariates...), with
    ``subject`` where a subject has several rows.
    """

    def __init__(self, rows: DataFrame, kernels: list[DataFrame], covariates: list[str], probes: int = 32, seed: int = 1, tol: float = 1e-6, most: int = 1000):
        self.p, self.q, self.probes, self.seed, self.tol, self.most = 1 + len(covariates), len(kernels), probes, seed, tol, most
        self.spark = rows.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.dropna(subset=covariates) if covariates else rows
        subject = F.col("subject") if "subject" in rows.columns else F.col("row_idx")
        x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in covariates])
        placed = with_row_index(rows.select("row_idx", "family", subject.alias("subject"), "y", x.alias("x")), ["family", "row_idx"], "at")
        placed = materialise(placed, "placed")
        self.entries = self._packed(placed, kernels)
        own = reduce(DataFrame.unionByName, [k.filter("i = j").select(F.col("i").alias("row_idx"), F.struct(F.lit(n).alias("k"), F.col("value").cast("double").alias("value")).alias("e")) for n, k in enumerate(kernels)])
        diagonal = own.groupBy("row_idx").agg(F.collect_list("e").alias("diagonal"))
        line = F.struct("at", "row_idx", "subject", "y", "x", "diagonal")
        grouped = placed.join(diagonal, "row_idx", "left").groupBy((F.col("at") / BLOCK).cast("long").alias("b")).agg(F.sort_array(F.collect_list(line)).alias("r"))
        self.rows = self._blocks(grouped)
        first = F.row_number().over(Window.partitionBy("subject").orderBy("row_idx")) == 1
        zero = F.coalesce(F.aggregate(F.filter("diagonal", lambda e: e["k"] == 0), F.lit(0.0), lambda a, e: a + e["value"]), F.lit(0.0))
        total = placed.join(diagonal, "row_idx", "left").withColumn("first", first).filter("first").agg(F.count("*"), F.sum(zero)).first()
        self.n_all, self.trace_all = total[0] or 0, total[1] or 0.0
        self.solved: dict[int, tuple[tuple, np.ndarray, DataFrame]] = {}
        self.tau_error: dict[int, np.ndarray] = {}
        self.iterations = 0

    def _packed(self, placed: DataFrame, kernels: list[DataFrame]) -> DataFrame:
        """(b, to, col, k, value): entries of the columns of block b, in order of their rows."""
        a = placed.select(F.col("row_idx").alias("i"), F.col("at").alias("to"))
        c = placed.select(F.col("row_idx").alias("j"), F.col("at").alias("from"))
        each = reduce(DataFrame.unionByName, [k.select("i", "j", F.col("value").cast("double").alias("value"), F.lit(n).alias("k")) for n, k in enumerate(kernels)])
        each = materialise(each.join(a, "i").join(c, "j").select((F.col("from") / BLOCK).cast("long").alias("b"), "to", (F.col("from") % BLOCK).cast("int").alias("col"), "k", "value"), "entries")
        n, last, blocks = each.agg(F.count("*"), F.max("to"), F.countDistinct("b")).first()
        # dense kernels are cut by ranges of rows, sparse ones stay whole by column block
        ranges = -(-(n or 1) // (max(blocks, 1) * GROUP))
        width = -(-((last or 0) + 1) // ranges)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    to, col, k, value = (f.to_numpy() for f in batch.column("r")[i].values.flatten())
                    yield pa.record_batch([batch.column("b").slice(i, 1), *[pa.array([x.tobytes()]) for x in (to, col, k, value)]], ["b", "to", "col", "k", "value"])

        grouped = each.groupBy("b", (F.col("to") / width).cast("long").alias("g")).agg(F.sort_array(F.collect_list(F.struct("to", "col", "k", "value"))).alias("r"))
        return materialise(grouped.select("b", "r").mapInArrow(run, "b long, to binary, col binary, k binary, value binary"), "packed")

    def _blocks(self, grouped: DataFrame) -> DataFrame:
        q = self.q

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for b, members in zip(batch.column("b").to_pylist(), batch.column("r").to_pylist()):
                    whole = lambda c, t: np.array([m[c] for m in members], t)
                    d = np.zeros((q, len(members)))
                    for i, m in enumerate(members):
                        for e in m["diagonal"] or []:
                            d[e["k"], i] += e["value"]
                    cells = [whole("row_idx", np.int64), whole("subject", np.int64), whole("y", float), whole("x", float), d]
                    yield pa.record_batch([pa.array([b]), pa.array([len(members)], pa.int32()), *[pa.array([c.tobytes()]) for c in cells]], ["b", "n", "ids", "subject", "y", "x", "diagonal"])

        return materialise(grouped.mapInArrow(run, "b long, n int, ids binary, subject binary, y binary, x binary, diagonal binary"), "rows")

    def _columns(self, t: Trait, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the trait, and the columns [X, y, probes], zero on other rows."""
        n = r["n"]
        y = _cells(r["y"], n, -1)[:, t.at]
        seen = ~np.isnan(y)
        signs = np.random.default_rng([self.seed, r["b"]]).integers(0, 2, (n, self.probes)) * 2.0 - 1.0
        return seen, np.column_stack([_cells(r["x"], n, self.p), np.where(seen, y - t.mean, 0.0), signs]) * seen[:, None]

    def _moments(self, t: Trait) -> np.ndarray:
        p, q = self.p, self.q

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for r in batch.to_pylist():
                    y = _cells(r["y"], r["n"], -1)[:, t.at]
                    seen = ~np.isnan(y)
                    v = y[seen] - t.mean
                    d = _cells(r["diagonal"], q, r["n"])[:, seen].sum(1)
                    yield pa.record_batch([pa.array([[len(v), v.sum(), (v * v).sum(), *d]])], ["v"])

        return _total(self.rows.mapInArrow(run, "v array<double>"), 3 + q)

    def _scales(self, t: Trait, tau: np.ndarray, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row has the trait, and one by the diagonal of its covariance."""
        seen = ~np.isnan(_cells(r["y"], r["n"], -1)[:, t.at])
        d = tau[0] + tau[1:] @ _cells(r["diagonal"], self.q, r["n"])
        return seen.astype(float), np.where(seen, 1 / np.where(d > 0, d, 1.0), 0.0)

    def _multiplied(self, vectors: DataFrame, weights: np.ndarray, width: int) -> DataFrame:
        """Pieces of the weighted kernels' products with (b, cells)."""
        met = self.entries.join(vectors.select("b", "cells"), "b").select("to", "col", "k", "value", "cells")
        return met.mapInArrow(_entry_sums(weights, width), "b long, at binary, piece binary")

    def _gathered(self, blocks: DataFrame, pieces: DataFrame, finish, lines: int, width: int, kind: str) -> DataFrame:
        """Blocks with the sums of their pieces, one at a time: finish(row, sums) gives a record batch."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema.fields if f.name != "b"]
        both = blocks.select("*", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("piece")).unionByName(pieces.select("b", *none, "at", "piece"))

        def run(batches):
            row, sums = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["piece"] is None:
                        if row is not None:
                            yield finish(row, sums)
                        row, sums = r, np.zeros((BLOCK, lines, width))
                    else:
                        # a piece holds a row once
                        sums[np.frombuffer(r["at"], np.int32)] += _cells(r["piece"], -1, lines, width)
            if row is not None:
                yield finish(row, sums)

        return both.repartition(self.parts, "b").sortWithinPartitions("b", F.col("piece").isNotNull()).mapInArrow(run, kind)

    def _solve(self, start: DataFrame, tau: np.ndarray, width: int) -> DataFrame:
        """(b, spread, cells): S Z of start (b, spread, scale, cells), by conjugate gradients on all columns at once."""
        import pyarrow as pa

        def moved(a: np.ndarray, beta: np.ndarray, begin: bool):
            """The state [X, R, P] after a step of a and a new direction."""

            def of(r: dict) -> np.ndarray:
                scale = np.frombuffer(r["scale"])
                if begin:
                    z = _cells(r["cells"], len(scale), width)
                    return np.stack([np.zeros_like(z), z, z * scale[:, None]])
                x, rest, way, image = _cells(r["cells"], 4, len(scale), width)
                rest = rest - a * image
                return np.stack([x + a * way, rest, rest * scale[:, None] + beta * way])

            return of

        def mapped(table: DataFrame, move, only: int | None) -> DataFrame:
            def run(batches):
                for batch in batches:
                    for r in batch.to_pylist():
                        s = move(r)
                        yield pa.record_batch([pa.array([r["b"]]), pa.array([r["spread"]]), pa.array([r["scale"]]), pa.array([(s if only is None else s[only]).tobytes()])], ["b", "spread", "scale", "cells"])

            return table.mapInArrow(run, "b long, spread binary, scale binary, cells binary")

        def finish(r: dict, sums: np.ndarray) -> pa.RecordBatch:
            spread, scale = np.frombuffer(r["spread"]), np.frombuffer(r["scale"])
            x, rest, way = _cells(r["cells"], 3, len(spread), width)
            image = tau[0] * way + sums[: len(spread), 0] * spread[:, None]
            z, zi = rest * scale[:, None], image * scale[:, None]
            dots = np.concatenate([(u * v).sum(0) for u, v in ((rest, z), (way, image), (z, image), (image, zi))])
            return pa.record_batch([pa.array([r["b"]]), pa.array([r["spread"]]), pa.array([r["scale"]]), pa.array([np.stack([x, rest, way, image]).tobytes()]), pa.array([dots])], ["b", "spread", "scale", "cells", "dots"])

        table, a, beta, norm, kept = start, np.zeros(width), np.zeros(width), None, False
        for step in range(self.most + 1):
            move = moved(a, beta, step == 0)
            if norm is not None and (left <= norm * self.tol**2).all():
                break
            if step == self.most:
                raise ValueError(f"conjugate gradients don't converge in {self.most} iterations")
            pieces = self._multiplied(mapped(table, move, 2), tau[None, 1:], width)
            new = materialise(self._gathered(mapped(table, move, None), pieces, finish, 1, width, _STATE), "directions")
            rz, pq, zq, qz = _total(new.select(F.col("dots").alias("v")), 4 * width).reshape(4, width)
            if (pq[rz > 0] <= 0).any():
                raise ValueError("the covariance isn't positive definite")
            if kept:
                forget(table)
            table, kept = new, True
            norm = rz if norm is None else norm
            # a column that has arrived stays
            live = (pq > 0) & (rz > norm * self.tol**2)
            a = np.where(live, rz / np.where(live, pq, 1.0), 0.0)
            left = np.maximum(rz - 2 * a * zq + a * a * qz, 0.0)
            beta = np.where(live, left / np.where(live, rz, 1.0), 0.0)
            self.iterations += 1
        out = materialise(mapped(table, move, 0), "solved")
        if kept:
            forget(table)
        return out

    def _information(self, t: Trait, tau: np.ndarray) -> np.ndarray:
        import pyarrow as pa

        p, q, probes = self.p, self.q, self.probes
        z, width = p + 1, p + 1 + probes
        asked = (*tau, t.mean)
        if t.at in self.solved and self.solved[t.at][0] == asked:
            return self.solved[t.at][1]

        def columns(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    spread, scale = self_._scales(t, tau, r)
                    yield pa.record_batch([pa.array([r["b"]]), *[pa.array([c.tobytes()]) for c in (spread, scale, self_._columns(t, r)[1])]], ["b", "spread", "scale", "cells"])

        self_ = _Local(self)
        kind = "b long, spread binary, scale binary, cells binary"
        solved = self._solve(materialise(self.rows.mapInArrow(columns, kind), "columns"), tau, width)

        def finish(r: dict, sums: np.ndarray) -> pa.RecordBatch:
            """Traces and inner products of a block, and its K_k S Z as the columns to solve next."""
            spread = np.frombuffer(r["spread"])
            own = _cells(r["solved"], len(spread), width)
            k = np.concatenate([own[:, None], sums[: len(spread)]], axis=1) * spread[:, None, None]
            cells = self_._columns(t, r)[1]
            trace = np.einsum("ns,nks->ks", cells[:, z:], k[:, :, z:])
            first = cells[:, :z].T @ own[:, :z]
            inner = np.einsum("ni,nkj->kij", own[:, :z], k[:, :, :z])
            after = np.ascontiguousarray(k[:, :, :z]).reshape(len(spread), -1)
            v = np.concatenate([trace.ravel(), first.ravel(), inner.ravel()])
            return pa.record_batch([pa.array([r["b"]]), pa.array([r["spread"]]), pa.array([self_._scales(t, tau, r)[1].tobytes()]), pa.array([after.tobytes()]), pa.array([v])], ["b", "spread", "scale", "cells", "dots"])

        blocks = self.rows.join(solved.select("b", "spread", F.col("cells").alias("solved")), "b")
        images = materialise(self._gathered(blocks, self._multiplied(solved, np.eye(q), width), finish, q, width, _STATE), "images")
        v = _total(images.select(F.col("dots").alias("v")), (q + 1) * probes + z * z + (q + 1) * z * z)
        trace, rest = v[: (q + 1) * probes].reshape(q + 1, probes), v[(q + 1) * probes :]
        second = self._solve(images.drop("dots"), tau, (q + 1) * z)

        def cross(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    a, b = (np.frombuffer(r[c]).reshape(-1, q + 1, z) for c in ("cells", "after"))
                    yield pa.record_batch([pa.array([np.einsum("nki,nlj->klij", a, b).ravel()])], ["v"])

        both = images.select("b", "cells").join(second.select("b", F.col("cells").alias("after")), "b")
        found = np.concatenate([trace.mean(1), rest, _total(both.mapInArrow(cross, "v array<double>"), (q + 1) ** 2 * z * z)])
        for done in (images, second):
            forget(done)
        if t.at in self.solved:
            forget(self.solved[t.at][2])
        self.solved[t.at] = (asked, found, solved)
        ai = _read_information(t, found, p, q).ai
        free = tau != 0
        self.tau_error[t.at] = np.zeros(q + 1)
        # the probes' score errors move together: each probe's own step, then their spread
        steps = np.linalg.pinv(ai[np.ix_(free, free)]) @ (trace - trace.mean(1)[:, None])[free]
        self.tau_error[t.at][free] = steps.std(1, ddof=1) / np.sqrt(probes) if probes > 1 else np.inf
        return found

    def _scaled(self, t: Trait, coef: np.ndarray) -> DataFrame:
        """(subject, row_idx, py) on rows with the trait: P y from the last solution."""
        import pyarrow as pa

        p, width = self.p, self.p + 1 + self.probes
        w = np.append(-coef, 1.0)
        w[0] += t.mean

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    seen = np.frombuffer(r["spread"]) > 0
                    py = _cells(r["cells"], r["n"], width)[:, : p + 1] @ w
                    yield pa.record_batch([pa.array(np.frombuffer(r["subject"], np.int64)[seen]), pa.array(np.frombuffer(r["ids"], np.int64)[seen]), pa.array(py[seen])], ["subject", "row_idx", "py"])

        met = self.rows.select("b", "n", "ids", "subject").join(self.solved[t.at][2].select("b", "spread", "cells"), "b")
        by_row = met.mapInArrow(run, "subject long, row_idx long, py double")
        return by_row.groupBy("subject").agg(F.min("row_idx").alias("row_idx"), F.sum("py").alias("py"))

    def _correction(self, t: Trait, tau: np.ndarray, coef: np.ndarray) -> np.ndarray:
        """The first kernel holds all pairs of subjects' rows, so sums by subject are sums over its entries."""
        p, q = self.p, self.q
        found = self.solved[t.at][1]
        inner = found[q + 1 :].reshape(-1, p + 1, p + 1)
        square = self._scaled(t, coef).agg(F.sum(F.col("py") * F.col("py"))).first()[0]
        return np.concatenate([[found[1], square], inner[2][:p, :p].ravel()])

    def sums(self, asked: list[tuple[Trait, Ask]]) -> list[np.ndarray]:
        """What each trait asks for, one trait after the other."""
        out = []
        for t, ask in asked:
            if t.binary:
                raise ValueError("binary traits need families of at most ``largest`` rows")
            if ask.kind == "moments":
                out.append(self._moments(t))
            elif ask.kind == "correction":
                out.append(self._correction(t, ask.tau, ask.coef))
            else:
                out.append(self._information(t, ask.tau))
        return out

    def move(self, asked: list[tuple[Trait, Ask]]) -> None:
        """Gaussian traits have no linear predictors to move."""

    def residuals(self, traits: list[tuple[Trait, np.ndarray, np.ndarray, float]]) -> DataFrame:
        """(row_idx, trait, resid): c1 times the subject's summed P y, at its first row with a value."""
        return reduce(DataFrame.unionByName, [self._scaled(t, coef).select("row_idx", F.lit(t.at).alias("trait"), (F.lit(float(c1)) * F.col("py")).alias("resid")) for t, _, coef, c1 in traits])


class _Local:
    """The numbers of a OneFamily that tasks need, without its tables."""

    _columns = OneFamily._columns
    _scales = OneFamily._scales

    def __init__(self, of: OneFamily):
        self.p, self.q, self.probes, self.seed = of.p, of.q, of.probes, of.seed


def _total(parts: DataFrame, size: int) -> np.ndarray:
    """Cell-wise sum of arrays ``v``; its size follows from the model, not from the rows."""
    out = np.zeros(size)
    for r in parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["at"]] = r["v"]
    return out
