import numpy as np
import pytest

from locusmill.operators.assoc import Projector, RepeatedProjector, Traits, test_block as dense_tests
from locusmill.operators.blocked import associate_blocks, cohort_of, dosage_blocks, split_blocks


def study(seed, n=57, m=7, repeats=False):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[rng.random((m, n)) < 0.15] = np.nan
    c = rng.integers(1, 4, n) if repeats else np.ones(n, int)
    at = np.repeat(np.arange(n), c)
    x = np.column_stack([rng.normal(1e4, 5, len(at)), rng.normal(size=len(at))])
    y = rng.normal(size=(n, 2)) + 0.3 * np.nan_to_num(g[0])[:, None]
    return g, at, x, y, c


def tables(spark, g, at, x, y):
    rows = spark.createDataFrame([(int(i), f"s{i}", float(a), float(b)) for i, (a, b) in zip(at, x)], "sample_idx long, sample_id string, `age at` double, sex double")
    resid = spark.createDataFrame([(f"s{i}", p, float(v)) for i, line in enumerate(y) for p, v in zip(("t.1", "u"), line)], "sample_id string, pheno string, resid double")
    return rows, resid


@pytest.mark.parametrize("repeats", [False, True])
def test_blocks_equal_the_dense_kernel(spark, repeats):
    g, at, x, y, c = study(3, repeats=repeats)
    rows, resid = tables(spark, g, at, x, y)
    design = np.column_stack([np.ones(len(at)), x])
    sums = np.zeros((len(c), 3))
    np.add.at(sums, at, design)
    project = RepeatedProjector(sums, design.T @ design, c.astype(float)) if repeats else Projector(design)
    want = dense_tests(g, Traits(["t.1", "u"], y, np.array([1.5, 0.7]), design), project)
    cohort = cohort_of(rows, resid, {"t.1": 1.5, "u": 0.7}, ["age at", "sex"])
    files = spark.createDataFrame([(str(i), [None if np.isnan(d) else float(d) for d in line]) for i, line in enumerate(g)], "variant_id string, dosage array<float>")
    # rows of missing dosages are left out, and samples outside the cohort don't count
    long = spark.createDataFrame([(str(i), j, float(d)) for i, line in enumerate(g) for j, d in enumerate(line) if not np.isnan(d)] + [("0", 1000, 2.0)], "variant_id string, sample_idx long, dosage double")
    for blocks in (split_blocks(files, 10), dosage_blocks(long, 10)):
        got = {(r["variant_id"], r["pheno"]): r for r in associate_blocks(blocks, cohort, 10, 3).collect()}
        assert len(got) == want["beta"].size
        for i in range(len(g)):
            for j, p in enumerate(("t.1", "u")):
                for name in want:
                    assert got[str(i), p][name] == pytest.approx(want[name][i, j], rel=1e-7, abs=1e-9)
    wide = associate_blocks(split_blocks(files, 64), cohort, 64, wide=True)
    assert wide.columns == ["variant_id", "n_samples", "af", "gv", "t.1_BETA", "t.1_SE", "t.1_pvalue", "u_BETA", "u_SE", "u_pvalue"]
    for row in wide.collect():
        i = int(row["variant_id"])
        own = g[i][~np.isnan(g[i])]
        assert row["t.1_BETA"] == pytest.approx(want["beta"][i, 0])
        assert (row["n_samples"], row["af"], row["gv"]) == (len(own), pytest.approx(own.mean() / 2), pytest.approx(own.var(ddof=1)))


def test_blocks_without_dosages_and_without_samples(spark):
    g, at, x, y, _ = study(5, n=12, m=2)
    rows, resid = tables(spark, g, at, x, y)
    cohort = cohort_of(rows, resid, {"u": 1.0}, ["sex"])
    none = spark.createDataFrame([("a", [None] * 12), ("b", []), ("c", None)], "variant_id string, dosage array<float>")
    assert associate_blocks(split_blocks(none, 5), cohort, 5).count() == 0
    assert associate_blocks(split_blocks(none.limit(0), 5), cohort, 5).count() == 0
    with pytest.raises(ValueError, match="no samples"):
        cohort_of(rows.limit(0), resid, {"u": 1.0}, ["sex"])
    with pytest.raises(ValueError, match="c2"):
        cohort_of(rows, resid, {"u": 0.0}, ["sex"])
