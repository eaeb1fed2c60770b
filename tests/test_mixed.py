"""Mixed models against dense algebra: binary traits, repeated measures, random slopes and many traits at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.jobs import cli, study
from locusmill.operators import mixed
from locusmill.sources.genotype import genotypes
from locusmill.sources.text import read_corrections

from .test_study import write_bed

FOUR = np.full((4, 4), 0.5) + 0.5 * np.eye(4)


def dense(y, x, kernels, tau, binary, start=None):
    """Coefficients, P, working response, weights, scaled residuals and scores at tau, all dense."""
    w, v = np.ones(len(y)), y
    eta = x @ start if binary else None
    for _ in range(300 if binary else 1):
        if binary:
            mu = 1 / (1 + np.exp(-eta))
            w = mu * (1 - mu)
            v = eta + (y - mu) / w
        s = np.linalg.inv(np.diag(tau[0] / w) + sum(t * k for t, k in zip(tau[1:], kernels)))
        c = np.linalg.inv(x.T @ s @ x)
        alpha = c @ x.T @ s @ v
        if binary:
            eta = v - tau[0] / w * (s @ (v - x @ alpha))
    p = s - s @ x @ c @ x.T @ s
    rest = y - 1 / (1 + np.exp(-eta)) if binary else p @ v
    score = [v @ p @ k @ p @ v - np.trace(p @ k) for k in [np.diag(1 / w), *kernels]]
    return alpha, s, c, p, rest, np.array(score)


def correction(who, x, s, c, kernel, trace_all, n_all, rest):
    """c1, c2 and the subjects' residuals in order of first appearance; who: subject of each row, kernel over subjects."""
    j = np.array([[float(a == b) for b in who] for a in dict.fromkeys(who)])
    c1 = trace_all / (((j @ s @ j.T) * kernel).sum() - (c * (x.T @ s @ j.T @ kernel @ j @ s @ x)).sum())
    r = j @ rest
    return c1, c1 * (r @ r) / (n_all - 1), c1 * r


def loglik(y, x, kernels, tau):
    s = tau[0] * np.eye(len(y)) + sum(t * k for t, k in zip(tau[1:], kernels))
    si = np.linalg.inv(s)
    xsx = x.T @ si @ x
    e = y - x @ np.linalg.solve(xsx, x.T @ si @ y)
    return -0.5 * (np.linalg.slogdet(s)[1] + np.linalg.slogdet(xsx)[1] + e @ si @ e)


def entries(spark, k):
    return spark.createDataFrame([(int(i), int(j), float(k[i, j])) for i, j in zip(*np.nonzero(k))], "i long, j long, value double")


def study_of(spark, n=200):
    rng = np.random.default_rng(8)
    k = np.kron(np.eye(n // 4), FOUR)
    a = rng.normal(size=n)
    u = np.linalg.cholesky(2.5 * k) @ rng.normal(size=n)
    values = {"b": (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.6 * a + u)))).astype(float), "g": 1 + 0.5 * a + u + rng.normal(size=n), "h": 0.2 * a + rng.normal(size=n)}
    values["h"][::7] = values["b"][::9] = np.nan
    cohort = spark.createDataFrame([(f"s{i:03}", float(v)) for i, v in enumerate(a)], "sample_id string, a double")
    rows = [(f"s{i:03}", p, float(v)) for p, y in values.items() for i, v in enumerate(y) if not np.isnan(v)]
    edges = spark.createDataFrame([(f"s{i:03}", f"s{j:03}", int(i * n + j), float(k[i, j])) for i, j in zip(*np.nonzero(k)) if i < j], "id1 string, id2 string, edge_idx long, value double")
    return cohort, spark.createDataFrame(rows, "sample_id string, pheno string, y double"), edges, k, a, values


def test_all_traits_at_once_equal_dense_algebra(spark):
    """Two Gaussian traits and a binary one with rows missing from each: optimum, correction and residuals."""
    cohort, phenotypes, edges, k, a, values = study_of(spark)
    resid, c2, fits = study.fit_null(cohort, phenotypes, ["a"], edges)
    got = {(r["pheno"], r["sample_id"]): r["resid"] for r in resid.collect()}
    assert [f.pheno for f in fits] == ["b", "g", "h"] and [f.family for f in fits] == ["binomial", "gaussian", "gaussian"]
    every = np.stack([np.ones(len(a)), a], axis=1)
    for f in fits:
        assert f.converged
        y = values[f.pheno]
        seen = ~np.isnan(y)
        tau = np.array(f.tau)
        x, kk = every[seen], k[np.ix_(seen, seen)]
        alpha, s, c, p, rest, score = dense(y[seen], x, [kk], tau, f.family == "binomial", np.zeros(2))
        assert np.allclose(alpha, f.coef, rtol=1e-5, atol=1e-6) and np.allclose(c, f.cov, rtol=1e-4)
        free = [i for i in (0, 1) if not (f.family == "binomial" and i == 0) and tau[i] > 0]
        assert np.abs(score[free] / [(p * p).sum(), (p @ kk * (p @ kk).T).sum()][free[0] : free[-1] + 1] / tau[free]).max() < 1e-3
        c1, want, r = correction(np.flatnonzero(seen), x, s, c, kk, np.trace(k), len(a), rest)
        assert abs(c2[f.pheno] - want) < 1e-5 * abs(want)
        ids = [f"s{i:03}" for i in np.flatnonzero(seen)]
        assert np.allclose([got[f.pheno, i] for i in ids], r, rtol=1e-4, atol=1e-5)
    assert len(got) == sum((~np.isnan(y)).sum() for y in values.values())


def test_penalised_quasi_likelihood_at_given_components(spark):
    _, _, _, k, a, values = study_of(spark)
    y = values["b"]
    rows = spark.createDataFrame([(i, [float(v)], float(z)) for i, (v, z) in enumerate(zip(y, a))], "row_idx long, y array<double>, a double")
    trait = mixed.Trait(0, [0, 1], True, np.zeros(2))
    fits, resid = mixed.fit_mixed(mixed.Stacks(rows, [entries(spark, k)], ["a"]), [trait], tau=[[1.0, 0.8]], tol=1e-9)
    seen = ~np.isnan(y)
    x = np.stack([np.ones(len(a)), a], axis=1)[seen]
    kk = k[np.ix_(seen, seen)]
    alpha, s, c, _, rest, _ = dense(y[seen], x, [kk], [1.0, 0.8], True, np.zeros(2))
    c1, c2, r = correction(np.flatnonzero(seen), x, s, c, kk, len(a), len(a), rest)
    assert np.allclose(fits[0].coef, alpha, atol=1e-6) and abs(fits[0].c1 - c1) < 1e-6 and abs(fits[0].c2 - c2) < 1e-6
    assert np.allclose([v["resid"] for v in resid.orderBy("row_idx").collect()], r, atol=1e-6)


def repeated_files(tmp_path, slope=0.0, n=24, times=5, families=False):
    """Five rows a sample in shuffled file order, the k-th row of a sample on both sides belonging together."""
    rng = np.random.default_rng(12)
    who = rng.permutation(np.repeat(np.arange(n), times))
    t = rng.normal(size=len(who))
    u, b = 1.5 * rng.normal(size=n), slope * rng.normal(size=n)
    y = 0.5 + 0.7 * t + u[who] + b[who] * t + 0.8 * rng.normal(size=len(who))
    y[3::17] = np.nan
    write_bed(tmp_path / "g.bed", rng.integers(0, 3, (4, n)).tolist())
    (tmp_path / "c.csv").write_text("FID,IID,t\n" + "".join(f"0,s{w},{float(v)!r}\n" for w, v in zip(who, t)))
    # the same rows grouped by sample, in each sample's own order
    grouped = np.argsort(who, kind="stable")
    (tmp_path / "p.csv").write_text("FID,IID,y\n" + "".join(f"0,s{who[i]},{'NA' if np.isnan(y[i]) else repr(float(y[i]))}\n" for i in grouped))
    (tmp_path / "k.csv").write_text("a,b,v\n" + "".join(f"s{i},s{i ^ 1},0.5\n" for i in range(0, n, 2)))
    args = ["--covar-names", "t"]
    for name, file in (("--pheno-file", "p.csv"), ("--cov-file", "c.csv"), ("--bed", "g.bed"), ("--corr-file", "corr"), ("--out", "out.txt"), *((("--kin-file", "k.csv"),) if families else ())):
        args += [name, str(tmp_path / file)]
    return args, who, t, y


@pytest.mark.parametrize("related", [False, True])
def test_repeated_measures_from_files(spark, tmp_path, related):
    args, who, t, y = repeated_files(tmp_path, families=related)
    n = who.max() + 1
    written = cli.main(args, spark)
    seen = ~np.isnan(y)
    x, w, v = np.stack([np.ones(len(t)), t], axis=1)[seen], who[seen], y[seen]
    same = (w[:, None] == w[None, :]).astype(float)
    pair = np.eye(n) + np.kron(np.eye(n // 2), [[0, 0.5], [0.5, 0]])
    kernels = [pair[np.ix_(w, w)], same] if related else [same]
    c2, resid = read_corrections(spark, str(tmp_path / "corr"))
    got = {r["sample_id"]: r["resid"] for r in resid.collect()}
    # the dense maximum from a start near it, by coordinates
    tau = np.full(len(kernels) + 1, 0.7)
    step = 0.5
    while step > 1e-6:
        best = max((loglik(v, x, kernels, np.maximum(tau * (1 + step * e), 1e-9)), i) for i, e in enumerate([z * s for z in np.eye(len(tau)) for s in (1, -1)]))
        if best[0] > loglik(v, x, kernels, tau) + 1e-12:
            tau = np.maximum(tau * (1 + step * ([z * s for z in np.eye(len(tau)) for s in (1, -1)][best[1]])), 1e-9)
        else:
            step /= 2
    _, s, c, _, rest, _ = dense(v, x, kernels, tau, False)
    order = list(dict.fromkeys(w))
    _, want, r = correction(w, x, s, c, pair[np.ix_(order, order)] if related else np.eye(len(order)), n, n, rest)
    assert abs(c2.first()["c2"] - want) < 2e-3 * want
    assert all(abs(got[f"s{i}"] - e) < 5e-3 * np.abs(r).max() for i, e in zip(order, r))
    # association: dosages less what the rows' covariates explain, by sample
    rows = np.stack([np.ones(len(t)), t], axis=1)
    j = np.eye(n)[who]
    counts = j.sum(0)
    sums = j.T @ rows
    out = spark.read.parquet(written[0]).orderBy(F.col("POS").cast("int")).collect()
    dosage = np.array([g["dosage"] for g in genotypes(spark, str(tmp_path / "g.bed")).orderBy("variant_idx").collect()], float)
    res = (dosage * counts - dosage @ sums @ np.linalg.solve(rows.T @ rows, sums.T)) / counts
    e = np.array([got[f"s{i}"] for i in range(n)])
    res, e = res - res.mean(1, keepdims=True), e - e.mean()
    assert np.allclose([o["y_BETA"] for o in out], res @ e / (res * res).sum(1), rtol=1e-4)


@pytest.mark.parametrize("kind", ["inside", "bound"])
def test_random_slopes_are_the_constrained_maximum(spark, kind):
    """No point near the estimate that keeps |covariance| <= sqrt(intercept * slope) is more likely."""
    rng = np.random.default_rng(21)
    n, times = 50, 6
    who = np.repeat(np.arange(n), times)
    t = rng.normal(size=len(who))
    u = rng.normal(size=n)
    b = 0.6 * rng.normal(size=n) + 0.3 * u if kind == "inside" else 0.9 * u
    y = 1 + t + u[who] + b[who] * t + 0.7 * rng.normal(size=len(who))
    x = np.stack([np.ones(len(t)), t], axis=1)
    rows = spark.createDataFrame([(i, int(w), [float(v)], float(s)) for i, (w, v, s) in enumerate(zip(who, y, t))], "row_idx long, subject long, y array<double>, t double")
    same = (who[:, None] == who[None, :]).astype(float)
    kernels, triples = mixed.with_slopes([entries(spark, same)], rows.select("row_idx", F.col("t").alias("s")))
    fits, _ = mixed.fit_mixed(mixed.Stacks(rows, kernels, ["t"]), [mixed.Trait(0, [0, 1])], triples, tol=1e-6)
    fit, ks = fits[0], [same, same * (t[:, None] + t[None, :]), same * np.outer(t, t)]
    assert fit.converged and fit.rho == ([0] if kind == "inside" else [1])
    top = loglik(y, x, ks, fit.tau)
    limit = lambda v: np.sqrt(v[1] * v[3])
    assert abs(fit.tau[2]) <= limit(fit.tau) * (1 + 1e-9)
    for _ in range(300):
        near = fit.tau * (1 + rng.choice([1e-1, 1e-2, 1e-3]) * rng.normal(size=4))
        if abs(near[2]) > limit(near):
            near[2] = np.sign(near[2]) * limit(near)
        assert loglik(y, x, ks, near) <= top + 1e-6


def test_random_slope_from_the_command_line(spark, tmp_path):
    args, *_ = repeated_files(tmp_path, slope=0.8)
    cli.main([*args, "--step", "step1"], spark)
    largest = lambda: read_corrections(spark, str(tmp_path / "corr"))[1].agg(F.max(F.abs("resid"))).first()[0]
    plain = largest()
    cli.main([*args, "--step", "step1", "--random-slope-name", "t"], spark)
    assert largest() != pytest.approx(plain, rel=1e-2)
    with pytest.raises(ValueError, match="one of the covariates"):
        cli.main([*args, "--step", "step1", "--random-slope-name", "z"], spark)


def test_the_number_of_passes_does_not_follow_the_number_of_traits(spark, monkeypatch):
    cohort, phenotypes, edges, *_ = study_of(spark, 40)
    passes = []
    sums = mixed.Stacks.sums
    monkeypatch.setattr(mixed.Stacks, "sums", lambda self, asked: passes.append(len(asked)) or sums(self, asked))
    one = phenotypes.filter("pheno = 'g'")
    study.fit_null(cohort, one, ["a"], edges)
    alone, many = len(passes), one.crossJoin(spark.range(12)).withColumn("pheno", F.concat("pheno", "id")).drop("id")
    passes.clear()
    _, c2, fits = study.fit_null(cohort, many, ["a"], edges)
    assert len(passes) == alone and max(passes) == 12 == len(c2) and len({round(v, 9) for v in c2.values()}) == 1


def test_a_separated_trait_leaves_the_others_alone(spark):
    cohort = spark.createDataFrame([(str(i), float(i - 20)) for i in range(40)], "sample_id string, a double")
    rows = [(str(i), "apart", float(i > 19)) for i in range(40)] + [(str(i), "mixed", float(i % 3 > 0)) for i in range(40)] + [(str(i), "plain", float(i * i % 11)) for i in range(40)]
    _, c2, fits = study.fit_null(cohort, spark.createDataFrame(rows, "sample_id string, pheno string, y double"), ["a"])
    assert [f.converged for f in fits] == [False, True, True] and all(np.isfinite(v) for v in c2.values())
