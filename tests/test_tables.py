import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.jobs import cli
from locusmill.operators.tallskinny import independent, r_factor
from locusmill.sources.text import numeric_columns, read_covariates, read_delimited, read_phenotypes

from .test_study import write_bed


def test_file_order_over_many_tasks(spark, tmp_path):
    lines = [f"0,s{i % 50},{i}" for i in range(3000)]
    (tmp_path / "p.csv").write_text("FID,IID,t\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_phenotypes(spark, str(tmp_path / "p.csv"), order="o")
        assert rows.select("o.start").distinct().count() > 5
        assert [r["y"] for r in rows.orderBy("o").select("y").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y,\n1,2,3\n2,3,4,\n\n3,4\n4,5,6,7\n5,,\n")
    got = [tuple(r) for r in read_delimited(spark, str(tmp_path / "a.csv"), order="o").orderBy("o").drop("o").collect()]
    assert got == [("1", "2", "3"), ("2", "3", "4"), (None,) * 3, (None,) * 3, ("5", None, None)]
    with pytest.raises(Exception, match="header's 3 cells: 3,4"):
        read_covariates(spark, str(tmp_path / "a.csv"), "id", ["x"]).count()
    (tmp_path / "b.txt").write_text("id|x\n1|2\n")
    assert read_delimited(spark, str(tmp_path / "b.txt"), "|", columns=["x"]).first()["x"] == "2"
    with pytest.raises(ValueError, match="no column z"):
        read_delimited(spark, str(tmp_path / "b.txt"), "|", columns=["z"])


def test_numeric_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("FID,IID,age,town,none,mixed\n0,1,3.5,A,NA,1\n0,2,NA,B,,x\n")
    assert numeric_columns(spark, str(tmp_path / "c.csv"), "IID") == ["FID", "age"]


def test_r_factor_keeps_columns_apart_that_a_gram_matrix_mixes(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=400)
    x = np.column_stack([a, a + 1e-8 * rng.normal(size=400), rng.normal(size=400)])
    x = np.column_stack([x, 2 * x[:, 0] - 3 * x[:, 2], np.zeros(400), np.full(400, 7.0)])
    df = spark.createDataFrame(x.tolist(), [f"v {i}" for i in range(6)]).repartition(40)
    r = r_factor(df, df.columns[:3])
    want = np.linalg.qr(x[:, :3], mode="r")
    want *= np.sign(np.diag(want))[:, None]
    assert np.allclose(r[0], want[0], rtol=1e-12) and abs(r[1, 1] / want[1, 1] - 1) < 1e-6 and abs(r[2, 2] / want[2, 2] - 1) < 1e-9
    assert independent(df, df.columns) == ["v 0", "v 1", "v 2"]
    assert independent(df.limit(0), df.columns) == [] and not r_factor(df.limit(0), df.columns).any()
    holes = df.withColumn("v 0", F.when(F.col("v 2") > 0, F.col("v 0")))
    assert np.allclose(r_factor(holes, ["v 0"]), np.linalg.norm(x[x[:, 2] > 0, 0]))


@pytest.mark.parametrize("names", [["age"], []])
def test_command_line_by_blocks(spark, tmp_path, names):
    rng = np.random.default_rng(4)
    dosage = [[None if rng.random() < 0.1 else int(g) for g in row] for row in rng.integers(0, 3, (9, 40))]
    write_bed(tmp_path / "g.bed", dosage)
    (tmp_path / "p.csv").write_text("FID,IID,t1,t2\n" + "".join(f"0,s{i},{rng.normal()},{i % 2}\n" for i in range(40)))
    (tmp_path / "c.csv").write_text("FID,IID,age,twice\n" + "".join(f"0,s{i},{'NA' if i == 3 else i * i},{i * i * 2}\n" for i in range(40)))
    results = []
    for most in (1 << 20, 0):
        args = ["--covar-names", *names, "--most-bytes", str(most)]
        for name, file in (("--pheno-file", "p.csv"), ("--cov-file", "c.csv"), ("--bed", "g.bed"), ("--corr-file", f"corr{most}"), ("--out", f"out{most}.txt")):
            args += [name, str(tmp_path / file)]
        results.append(spark.read.parquet(cli.main(args, spark)[0]).orderBy(F.col("POS").cast("int")).toPandas())
    one, two = results
    assert list(one.columns) == list(two.columns) and len(one) == 9
    for c in one.columns:
        if one[c].dtype == object:
            assert (one[c] == two[c]).all()
        else:
            assert np.allclose(one[c], two[c], rtol=1e-5, atol=1e-8)
    # the numeric columns explain the dosages also where none are named
    keep = [i for i in range(40) if i != 3]
    x = np.column_stack([np.ones(39), np.array(keep) ** 2])
    g = np.array([[np.nan if d is None else d for d in row] for row in dosage])[:, keep]
    g = np.where(np.isnan(g), np.nanmean(g, axis=1, keepdims=True), g)
    g = g - g @ x @ np.linalg.solve(x.T @ x, x.T)
    y = np.array([float(line.split(",")[2]) for line in (tmp_path / "p.csv").read_text().split("\n")[1:41]])[keep]
    d = x if names else x[:, :1]
    e = (y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) * 39 / (39 - d.shape[1])
    e -= e.mean()
    assert np.allclose(one["t1_BETA"], g @ e / (g * g).sum(axis=1), rtol=1e-4, atol=1e-6)
