"""Null models without random effects: least squares and logistic, and the residual correction.

Samples stay in Spark: Gram matrices, scores and weights are sums over rows. Only systems of the
size of the design are solved on the driver. Mixed models are in ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_1_tail
from .shared import materialise


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """Sums of products of all pairs of columns, in one aggregation."""
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(columns)
    sums = [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*sums).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def independent_columns(g: np.ndarray, names: list[str]) -> list[str]:
    """Names whose column adds something to those before it.

    The Cholesky factor of the Gram matrix is R of the unpivoted QR factorisation, so a
    column is dropped where its diagonal entry is under sqrt(eps) of the largest. Columns
    are scaled to length one first, as a Gram matrix squares the condition.
    """
    scale = np.sqrt(np.maximum(np.diag(g), 0))
    kept: list[int] = []
    for j in range(len(names)):
        if scale[j] == 0:
            continue
        c = g[np.ix_(kept, [j])][:, 0] / scale[kept] / scale[j] if kept else np.zeros(0)
        a = g[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept]) if kept else np.zeros((0, 0))
        rest = 1.0 - (c @ np.linalg.solve(a, c) if kept else 0.0)
        if rest > 1e-10:
            kept.append(j)
    return [names[j] for j in kept]


@dataclass
class Fit:
    pheno: str
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    sigma2: float
    n: int
    family: str = "gaussian"
    converged: bool = True
    tau: tuple[float, ...] = ()  # variance components of a mixed model: residual, then one for each kernel

    def report(self) -> list[tuple]:
        """(pheno, name, estimate, se, z, p) of each coefficient."""
        se = np.sqrt(np.diag(self.cov))
        return [(self.pheno, n, float(b), float(s), float(b / s), chi2_1_tail(float((b / s) ** 2))) for n, b, s in zip(self.names, self.coef, se)]


def design(df: DataFrame, covariates: list[str]) -> tuple[DataFrame, list[str]]:
    return df.withColumn("intercept", F.lit(1.0)), ["intercept", *covariates]


def grams(rows: DataFrame, columns: list[str], weight: str | None = None) -> dict[str, tuple[int, np.ndarray]]:
    """Rows and sums of products of all pairs of columns, by ``pheno``, in one aggregation for all traits."""
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(columns)
    places = [(i, j) for i in range(k) for j in range(i, k)]
    sums = F.array(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i, j in places])
    out = {}
    for row in rows.groupBy("pheno").agg(F.count("*").alias("n"), sums.alias("s")).collect():
        g = np.zeros((k, k))
        for (i, j), value in zip(places, row["s"]):
            g[i, j] = g[j, i] = value or 0.0
        out[row["pheno"]] = row["n"], g
    return out


def fit_traits(rows: DataFrame, covariates: list[str]) -> dict[str, Fit]:
    """Least squares of ``y`` for every ``pheno`` over its rows with y and all covariates."""
    rows, every = design(rows.dropna(subset=["y", *covariates]), covariates)
    fits = {}
    for pheno, (n, g) in sorted(grams(rows, [*every, "y"]).items()):
        names = independent_columns(g[:-1, :-1], every)
        at = [every.index(c) for c in names]
        if n <= len(names):
            raise ValueError(f"{pheno}: {n} rows for {len(names)} columns")
        a, b = g[np.ix_(at, at)], g[at, -1]
        coef = np.linalg.solve(a, b)
        sigma2 = float(max(g[-1, -1] - coef @ b, 0.0) / (n - len(names)))
        fits[pheno] = Fit(pheno, names, coef, sigma2 * np.linalg.inv(a), sigma2, n)
    return fits


def with_predictor(rows: DataFrame, fits: list[Fit], covariates: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """Rows of the fitted traits with ``_eta``, ``_binomial`` and ``_scale``: a join with one row of coefficients a trait."""
    every = ["intercept", *covariates]
    place = lambda f: [float(f.coef[f.names.index(c)]) if c in f.names else 0.0 for c in every]
    table = [(f.pheno, place(f), f.family == "binomial", float(scale[f.pheno]) if scale else 1.0) for f in fits]
    coef = rows.sparkSession.createDataFrame(table, "pheno string, _b array<double>, _binomial boolean, _scale double")
    eta = reduce(lambda acc, i: acc + F.col("_b")[i] * (F.col(every[i]) if i else F.lit(1.0)), range(len(every)), F.lit(0.0))
    # one row a trait: a join by shuffle would send all rows of a trait to one task
    return rows.join(F.broadcast(coef), "pheno").withColumn("_eta", eta).drop("_b")


def _weights(rows: DataFrame) -> DataFrame:
    """Means and binomial weights beside the predictor."""
    return rows.withColumn("_mu", 1 / (1 + F.exp(-F.col("_eta")))).withColumn("_w", F.greatest(F.col("_mu") * (1 - F.col("_mu")), F.lit(1e-10)))


def fit_logistic_traits(rows: DataFrame, covariates: list[str], starts: dict[str, Fit], tol: float = 1e-5, most: int = 50) -> dict[str, Fit]:
    """Iteratively reweighted least squares from least squares starts; one aggregation a step for all traits still moving.

    Weights don't fall under 1e-10, so a separated trait, whose coefficients grow without end,
    comes out as not converged and the others finish.
    """
    rows, every = design(rows.dropna(subset=["y", *covariates]), covariates)
    now, done = dict(starts), {}
    for _ in range(most):
        if not now:
            return done
        step = _weights(with_predictor(rows, list(now.values()), covariates))
        step = step.withColumn("_z", F.col("_eta") + (F.col("y") - F.col("_mu")) / F.col("_w"))
        found = grams(step, [*every, "_z"], "_w")
        for pheno, old in list(now.items()):
            g = found[pheno][1]
            at = [every.index(c) for c in old.names]
            a = g[np.ix_(at, at)]
            fit = Fit(pheno, old.names, np.linalg.solve(a, g[at, -1]), np.linalg.inv(a), 1.0, old.n, "binomial")
            now[pheno] = fit
            if np.abs(fit.coef - old.coef).max() <= tol:
                done[pheno] = now.pop(pheno)
    return done | {pheno: replace(fit, converged=False) for pheno, fit in now.items()}


def correct_traits(rows: DataFrame, fits: list[Fit], covariates: list[str], n_all: int) -> tuple[DataFrame, dict[str, float]]:
    """(sample_id, pheno, resid) and c2 by trait, for unrelated samples with one row each.

    c1 = tr(K) / tr(PK) with K the identity over all n_all samples, s the residual over its
    dispersion, r = c1 s and c2 = c1 sum(s^2) / (n_all - 1). For least squares both follow from
    the fit; P = W - W X (X'WX)^-1 X'W of the binomial traits needs sums, one aggregation for all.
    """
    rows, every = design(rows.dropna(subset=["y", *covariates]), covariates)
    scale, c2 = {f.pheno: n_all / (f.n - len(f.names)) for f in fits if f.family == "gaussian"}, {}
    c2 |= {p: n_all / (n_all - 1) for p in scale}
    if binomial := [f for f in fits if f.family == "binomial"]:
        d = _weights(with_predictor(rows, binomial, covariates)).withColumn("_s", F.col("y") - F.col("_mu")).withColumn("_r", F.col("_s") / F.col("_w"))
        # weighted by w^2, the squares of the last two columns are w and s^2
        sums = grams(d.withColumn("_w2", F.col("_w") * F.col("_w")).withColumn("_i", 1 / F.sqrt("_w")), [*every, "_i", "_r"], "_w2")
        for f in binomial:
            g = sums[f.pheno][1]
            at = [every.index(c) for c in f.names]
            c1 = n_all / (g[-2, -2] - float((f.cov * g[np.ix_(at, at)]).sum()))
            scale[f.pheno], c2[f.pheno] = c1, float(c1 * g[-1, -1] / (n_all - 1))
    out = with_predictor(rows, fits, covariates, scale)
    mu = F.when(F.col("_binomial"), 1 / (1 + F.exp(-F.col("_eta")))).otherwise(F.col("_eta"))
    return out.select("sample_id", "pheno", (F.col("_scale") * (F.col("y") - mu)).alias("resid")), c2


def _one(rows: DataFrame, y: str, pheno: str) -> DataFrame:
    return rows.withColumn("y", F.col(y)).withColumn("pheno", F.lit(pheno))


def fit_gaussian(rows: DataFrame, covariates: list[str], y: str = "y", pheno: str = "y") -> Fit:
    """Least squares of one trait."""
    fits = fit_traits(_one(rows, y, pheno), covariates)
    if not fits:
        raise ValueError(f"{pheno}: no rows")
    return fits[pheno]


def fit_logistic(rows: DataFrame, covariates: list[str], y: str = "y", pheno: str = "y") -> Fit:
    """The logistic model of one trait."""
    # each step reads the rows again, but not what they come from
    rows = materialise(_one(rows, y, pheno).select("pheno", "y", *covariates), "logistic")
    start = fit_gaussian(rows, covariates, "y", pheno)
    return fit_logistic_traits(rows, covariates, {pheno: start})[pheno]
