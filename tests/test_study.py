import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusmill.functions.stats import neg_log10_two_sided
from locusmill.jobs import cli
from locusmill.jobs import queries as Q
from locusmill.operators import align, mixed, nullmodel, variants
from locusmill.operators.components import connected_components
from locusmill.sources import genotype
from locusmill.sources.text import read_corrections, read_delimited, read_include_list

SF = "/root/testdata/sf0.001"


def same(spark, name, sf=SF):
    ours = Q.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (ours, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, name)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_log_tail_is_continuous_and_finite():
    t = np.array([0.0, 1.96, 34.999, 35.001, 1000.0])
    p = neg_log10_two_sided(t)
    assert p[0] == 0 and abs(p[1] - 1.30103) < 1e-3 and abs(p[3] - p[2]) < 0.05 and np.isfinite(p[4])


def write_bed(path, dosage):
    code = {2: 0, 1: 2, 0: 3, None: 1}
    with open(path, "wb") as f:
        f.write(b"\x6c\x1b\x01")
        for row in dosage:
            bits = [code[g] for g in row]
            bits += [0] * (-len(bits) % 4)
            f.write(bytes(sum(b << 2 * k for k, b in enumerate(bits[i : i + 4])) for i in range(0, len(bits), 4)))
    stem = str(path)[:-4]
    open(f"{stem}.bim", "w").writelines(f"1 v{i} 0 {i + 1} A G\n" for i in range(len(dosage)))
    open(f"{stem}.fam", "w").writelines(f"0 s{j} 0 0 0 -9\n" for j in range(len(dosage[0])))


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    dosage = [[[0, 1, 2, None][x] for x in row] for row in rng.integers(0, 4, (11, 7))]
    write_bed(tmp_path / "x.bed", dosage)
    for parts in (1, 3):
        rows = genotype.genotypes(spark, str(tmp_path / "x.bed"), parts).orderBy("variant_idx").collect()
        assert [r["dosage"] for r in rows] == dosage
    assert rows[3]["effect"] == "A" and rows[3]["pos"] == 4


def rows_of(spark, dosage):
    rows = [(i, f"v{i}", "1", 10 * i + 1, "A", "G", d) for i, d in enumerate(dosage)]
    return spark.createDataFrame(rows, "variant_idx long, rsid string, chr string, pos long, non_effect string, effect string, dosage array<float>")


@pytest.mark.parametrize("kind", ["bed", "bgen"])
@pytest.mark.parametrize("parts", [None, 1, 7])
def test_written_folders_read_back(spark, tmp_path, kind, parts):
    rng = np.random.default_rng(3)
    dosage = [[[0.0, 1.0, 2.0, None][x] for x in row] for row in rng.integers(0, 4, (23, 9))]
    path = f"file://{tmp_path}/x.{kind}"
    genotype.write_genotypes(rows_of(spark, dosage).repartition(5), path)
    (tmp_path / f"x.{kind}" / f"left-over.{kind}").write_bytes(b"a task that was run again")
    rows = genotype.genotypes(spark, path, parts).orderBy("variant_idx").collect()
    assert [r["dosage"] for r in rows] == dosage
    assert [(r["variant_idx"], r["rsid"], r["chr"], r["pos"], r["non_effect"], r["effect"]) for r in rows] == [(i, f"v{i}", "1", 10 * i + 1, "A", "G") for i in range(23)]


def test_written_folders_of_no_rows_and_of_bad_rows(spark, tmp_path):
    for kind in ("bed", "bgen"):
        genotype.write_genotypes(rows_of(spark, []), f"{tmp_path}/none.{kind}")
        assert genotype.genotypes(spark, f"{tmp_path}/none.{kind}").count() == 0
        for bad in ([[0.0, 3.0]], [[0.0], [1.0, 2.0]], [[], []]):
            with pytest.raises(Exception, match="BED files|BGEN files|same samples"):
                genotype.write_genotypes(rows_of(spark, bad).coalesce(1), f"{tmp_path}/bad.{kind}")
    genotype.write_genotypes(rows_of(spark, [[0.0, 0.25, 1.5]]), f"{tmp_path}/part.bgen")
    assert np.allclose(genotype.genotypes(spark, f"{tmp_path}/part.bgen").first()["dosage"], [0, 0.25, 1.5], atol=1e-4)
    with pytest.raises(Exception, match="BED files"):
        genotype.write_genotypes(rows_of(spark, [[0.0, 0.25, 1.5]]), f"{tmp_path}/part.bed")


def test_ranges_of_a_companion_file_with_blank_lines(spark, tmp_path):
    write_bed(tmp_path / "x.bed", [[0, 1, 2]] * 10)
    bim = (tmp_path / "x.bim").read_text().splitlines()
    (tmp_path / "x.bim").write_text("\n\n".join(bim))
    for parts in (1, 3, 10):
        assert [r["rsid"] for r in genotype.genotypes(spark, str(tmp_path / "x.bed"), parts).orderBy("variant_idx").collect()] == [f"v{i}" for i in range(10)]


@pytest.mark.parametrize("layout,compression,bits,phased", [(1, 0, 16, 0), (1, 1, 16, 0), (2, 0, 8, 0), (2, 1, 16, 1), (2, 2, 24, 0), (2, 2, 32, 1)])
def test_bgen_round_trip(spark, tmp_path, layout, compression, bits, phased):
    import zstandard

    n, m = 5, 6
    rng = np.random.default_rng(bits + layout)
    text = lambda s, k: struct.pack(k, len(s)) + s.encode()
    ids = [f"s{j}" for j in range(n)]
    block = b"".join(text(s, "<H") for s in ids)
    block = struct.pack("<2I", 8 + len(block), n) + block
    head = struct.pack("<4I", 20 + len(block), 20, m, n) + b"bgen" + struct.pack("<I", compression | layout << 2 | 1 << 31)
    out, want = head + block, []
    for i in range(m):
        truth = rng.integers(0, 3, n)
        miss = rng.random(n) < 0.2
        out += struct.pack("<I", n) if layout == 1 else b""
        out += text(f"v{i}", "<H") + text(f"rs{i}", "<H") + text("1", "<H") + struct.pack("<I", i + 1) + (struct.pack("<H", 2) if layout == 2 else b"") + text("A", "<I") + text("G", "<I")
        if layout == 1:
            raw = b"".join(struct.pack("<3H", *([0] * 3 if x else [32768 * (g == k) for k in range(3)])) for g, x in zip(truth, miss))
            out += struct.pack("<I", len(zlib.compress(raw))) + zlib.compress(raw) if compression else raw
        else:
            top = 2**bits - 1
            pairs = [((g < 2) * top, (g < 1) * top) if phased else ((g == 0) * top, (g == 1) * top) for g in truth]
            raw = struct.pack("<IHBB", n, 2, 2, 2) + bytes(0x82 if x else 2 for x in miss) + bytes([phased, bits]) + b"".join(int(v).to_bytes(bits // 8, "little") for p in pairs for v in p)
            packed = {0: raw, 1: zlib.compress(raw), 2: zstandard.compress(raw)}[compression]
            out += struct.pack("<I", len(packed) + 4 * bool(compression)) + (struct.pack("<I", len(raw)) if compression else b"") + packed
        want.append([None if x else float(g) for g, x in zip(truth, miss)])
    (tmp_path / "x.bgen").write_bytes(out)
    rows = genotype.genotypes(spark, str(tmp_path / "x.bgen"), 4).orderBy("variant_idx").collect()
    assert [r["dosage"] for r in rows] == want and genotype.bgen_header(str(tmp_path / "x.bgen")).ids == tuple(ids)


def test_text_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"x",y\r\n0001,"1",NA\r\n2,,3\r\n5\r\n')
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "a.csv")).collect()] == [("0001", "1", None), ("2", None, "3"), (None, None, None)]
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.txt").write_text("SNPID\nv1\nv1\n")
    with pytest.raises(ValueError):
        read_include_list(spark, str(tmp_path / "c.txt"))


def dense_reml(y, x, k):
    """Independent dense maximiser of the restricted likelihood over a grid refined around its best point."""
    def loglik(t0, t1):
        s = t0 * np.eye(len(y)) + t1 * k
        si = np.linalg.inv(s)
        xsx = x.T @ si @ x
        e = y - x @ np.linalg.solve(xsx, x.T @ si @ y)
        return -0.5 * (np.linalg.slogdet(s)[1] + np.linalg.slogdet(xsx)[1] + e @ si @ e)
    lo, hi = np.log(1e-3), np.log(10)
    a0, b0, a1, b1 = lo, hi, lo, hi
    for _ in range(8):
        g0, g1 = np.linspace(a0, b0, 15), np.linspace(a1, b1, 15)
        v = [[loglik(np.exp(p), np.exp(q)) for q in g1] for p in g0]
        i, j = np.unravel_index(np.argmax(v), (15, 15))
        w0, w1 = (b0 - a0) / 7, (b1 - a1) / 7
        a0, b0, a1, b1 = g0[i] - w0, g0[i] + w0, g1[j] - w1, g1[j] + w1
    return np.exp(g0[i]), np.exp(g1[j])


def test_reml_equals_dense(spark):
    rng = np.random.default_rng(5)
    n = 160
    k = np.kron(np.eye(n // 4), np.full((4, 4), 0.5) + 0.5 * np.eye(4))
    x = np.stack([np.ones(n), rng.normal(size=n)], axis=1)
    y = x @ [1.0, 0.5] + np.linalg.cholesky(1.2 * k + 0.6 * np.eye(n)) @ rng.normal(size=n)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x[:, 1]))], "row_idx long, y double, x double")
    entries = spark.createDataFrame([(int(i), int(j), float(k[i, j])) for i, j in zip(*np.nonzero(k))], "i long, j long, value double")
    fit, resid = mixed.fit_reml(rows, [entries], ["x"])
    t0, t1 = dense_reml(y, x, k)
    assert fit.converged and np.allclose(fit.tau, [t0, t1], rtol=2e-3)
    s = np.linalg.inv(fit.tau[0] * np.eye(n) + fit.tau[1] * k)
    p = s - s @ x @ np.linalg.inv(x.T @ s @ x) @ x.T @ s
    c1 = np.trace(k) / np.trace(p @ k)
    want = c1 * (p @ y)
    got = np.array([r["resid"] for r in resid.orderBy("row_idx").collect()])
    assert np.allclose(got, want, rtol=1e-6, atol=1e-8)
    assert abs(fit.c2 - c1 * ((p @ y) ** 2).sum() / (n - 1)) < 1e-6


def test_gaussian_identity_c2(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal()) if i % 5 else None) for i in range(60)], "sample_id long, x double, y double")
    fit = nullmodel.fit_gaussian(rows, ["x"])
    _, c2 = nullmodel.correct_traits(rows.withColumn("pheno", F.lit("y")), [fit], ["x"], 60)
    c2 = c2["y"]
    assert abs(c2 - 60 / 59) < 1e-9
    with pytest.raises(ValueError):
        nullmodel.fit_gaussian(rows.limit(0), ["x"])


def test_logistic_against_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-0.3 - 0.8 * x))).astype(float)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, x double, y double")
    fit = nullmodel.fit_logistic(rows, ["x"])
    d, b = np.stack([np.ones(300), x], axis=1), np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-d @ b))
        b += np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]), d.T @ (y - mu))
    assert np.allclose(fit.coef, b, atol=1e-6)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1100)) and 5 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_partition_count_does_not_matter(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    for parts in (1, 8):
        rows = align.with_row_index(df, ["v"], parts=parts).collect()
        assert all(r["v"] == r["row_idx"] for r in rows)


def test_variants_without_samples_go(spark):
    g = spark.createDataFrame([("a", [None, None]), ("b", [1.0, None]), ("c", [0.0, 0.0])], "variant_id string, dosage array<float>")
    assert [r["variant_id"] for r in variants.maf_filter(variants.summarise(g)).collect()] == ["b"]


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(4)
    dosage = rng.integers(0, 3, (9, 40)).tolist()
    write_bed(tmp_path / "g.bed", dosage)
    (tmp_path / "p.csv").write_text("FID,IID,t1,t2\n" + "".join(f"0,s{i},{rng.normal()},{i % 2}\n" for i in range(40)))
    (tmp_path / "c.csv").write_text("FID,IID,age\n" + "".join(f"0,s{i},{'NA' if i == 3 else rng.normal()}\n" for i in range(40)))
    args = ["--pheno-file", "p.csv", "--cov-file", "c.csv", "--covar-names", "age", "--bed", "g.bed", "--corr-file", "corr", "--convert", "--out", "out.txt"]
    written = cli.main([x if x not in ("p.csv", "c.csv", "g.bed", "corr", "out.txt") else str(tmp_path / x) for x in args], spark)
    df = spark.read.parquet(written[0])
    assert df.count() == 9 and {"t1_BETA", "t2_pvalue", "Effect_Allele"} <= set(df.columns)
    # the same numbers from plain least squares with one covariate
    t = df.orderBy(F.col("POS").cast("int")).select("t1_BETA").toPandas().t1_BETA.to_numpy()
    keep = [i for i in range(40) if i != 3]
    y = np.array([float(x.split(",")[2]) for x in (tmp_path / "p.csv").read_text().split("\n")[1:41]])[keep]
    x = np.stack([np.ones(39), [float((tmp_path / "c.csv").read_text().split("\n")[1 + i].split(",")[2]) for i in keep]], axis=1)
    e = (y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) * 39 / 37
    for row, b in zip(np.array(dosage, float)[:, keep], t):
        g = row - x @ np.linalg.lstsq(x, row, rcond=None)[0]
        assert abs(g @ e / (g @ g) - b) < 1e-4


def test_command_line_with_kinship(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 120
    k = np.kron(np.eye(n // 4), np.full((4, 4), 0.5) + 0.5 * np.eye(4))
    age = rng.normal(size=n)
    y = 0.7 * age + np.linalg.cholesky(1.5 * k + 0.5 * np.eye(n)) @ rng.normal(size=n)
    write_bed(tmp_path / "g.bed", rng.integers(0, 3, (3, n)).tolist())
    seen = np.arange(n) % 9 != 4
    (tmp_path / "p.csv").write_text("FID,IID,t1\n" + "".join(f"0,s{i},{y[i] if seen[i] else 'NA'}\n" for i in range(n)))
    (tmp_path / "c.csv").write_text("FID,IID,age,twice\n" + "".join(f"0,s{i},{a},{2 * a}\n" for i, a in enumerate(age)))
    # the diagonal is half from the file and half from the option
    (tmp_path / "k.csv").write_text("id1,id2,v\n" + "".join(f"s{i},s{j},0.5\n" for i, j in zip(*np.nonzero(k)) if i <= j))
    args = ["--step", "step1", "--covar-names", "age", "twice", "--kin-diag", "0.5"]
    for name, file in (("--pheno-file", "p.csv"), ("--cov-file", "c.csv"), ("--kin-file", "k.csv"), ("--bed", "g.bed"), ("--corr-file", "corr")):
        args += [name, str(tmp_path / file)]
    cli.main(args, spark)
    c2, resid = read_corrections(spark, str(tmp_path / "corr"))
    x = np.stack([np.ones(n), age], axis=1)[seen]
    ks, v = k[np.ix_(seen, seen)], y[seen]
    t0, t1 = dense_reml(v, x, ks)
    s = np.linalg.inv(t0 * np.eye(len(v)) + t1 * ks)
    p = s - s @ x @ np.linalg.inv(x.T @ s @ x) @ x.T @ s
    c1 = n / np.trace(p @ ks)
    got = {r["sample_id"]: r["resid"] for r in resid.collect()}
    want = dict(zip(np.flatnonzero(seen), c1 * (p @ v)))
    assert all(abs(got[f"s{i}"] - w) < 2e-2 for i, w in want.items()) and all(got[f"s{i}"] == 0 for i in np.flatnonzero(~seen))
    assert abs(c2.first()["c2"] - c1 * ((p @ v) ** 2).sum() / (n - 1)) < 2e-2
