import pyarrow as pa
import pytest

from locusmill.sources import bgenindex, genotype


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bgen") / "x.bgen")
    rows = [(i, f"r{i}", "1" if i < 12 else "2", 10 * i, "A", "G", [None if (i + j) % 7 == 0 else float((i * j) % 3) for j in range(300)]) for i in range(20)]
    df = spark.createDataFrame(rows, "variant_idx long, rsid string, chr string, pos long, non_effect string, effect string, dosage array<double>")
    genotype.write_genotypes(df, path)
    bgenindex.write_index(spark, path, f"{path}.index")
    return path


def test_indexed_read_equals_the_whole(spark, files):
    want = genotype.genotypes(spark, files).orderBy("variant_idx").collect()
    assert bgenindex.read_indexed(spark, f"{files}.index").orderBy("variant_idx").collect() == want
    region = bgenindex.read_indexed(spark, f"{files}.index", ("1", 30, 80)).orderBy("variant_idx").collect()
    assert region == [r for r in want if r["chr"] == "1" and 30 <= r["pos"] <= 80] and len(region) == 6
    include = spark.createDataFrame([("r4",), ("r17",), ("zz",)], "rsid string")
    assert [r["rsid"] for r in bgenindex.read_indexed(spark, f"{files}.index", include=include).orderBy("pos").collect()] == ["r4", "r17"]
    assert bgenindex.read_indexed(spark, f"{files}.index", ("9", None, None)).count() == 0


def test_only_listed_blocks_are_read(spark, files, monkeypatch):
    listed = bgenindex.read_index(spark, f"{files}.index").filter("variant_idx in (3, 15)").orderBy("file", "at").toArrow()
    header = max(bgenindex.bgen_header(f).first for f in set(listed["file"].to_pylist())) * len(set(listed["file"].to_pylist()))
    read, true_open = [], genotype._open

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            out = self.f.read(n)
            read.append(len(out))
            return out

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

    monkeypatch.setattr(genotype, "_open", lambda path: Counting(true_open(path)))
    got = pa.Table.from_batches(bgenindex.read_blocks(iter(listed.to_batches())))
    assert sorted(got["variant_idx"].to_pylist()) == [3, 15]
    assert sum(read) <= sum(listed["length"].to_pylist()) + header


def test_a_changed_file_is_an_error(spark, files, tmp_path):
    (source,) = genotype._files(files)[:1]
    copy = tmp_path / "y.bgen"
    copy.write_bytes(open(source, "rb").read())
    index = bgenindex.ensure_index(spark, str(copy), str(tmp_path))
    assert bgenindex.ensure_index(spark, str(copy), str(tmp_path)) == index
    assert bgenindex.read_indexed(spark, index).count() == bgenindex.bgen_header(str(copy)).variants
    copy.write_bytes(copy.read_bytes() + b"x")
    with pytest.raises(Exception, match="has changed"):
        bgenindex.read_indexed(spark, index).collect()


def test_command_line_keeps_an_index(spark, files, tmp_path):
    from locusmill.jobs import cli

    source = genotype._files(files)[0]
    (tmp_path / "one.bgen").write_bytes(open(source, "rb").read())
    names = [r["rsid"] for r in genotype.genotypes(spark, str(tmp_path / "one.bgen")).orderBy("variant_idx").collect()]
    (tmp_path / "x.sample").write_text("ID\n0\n" + "".join(f"s{i}\n" for i in range(300)))
    (tmp_path / "p.csv").write_text("FID,IID,t\n" + "".join(f"0,s{i},{i * 7 % 13}\n" for i in range(300)))
    (tmp_path / "c.csv").write_text("IID,age\n" + "".join(f"s{i},{i * 5 % 11}\n" for i in range(300)))
    (tmp_path / "list.txt").write_text(f"rsid\n{next(n for n in names if int(n[1:]) % 3)}\n")
    results = []
    for more in ([], ["--bgen-index", str(tmp_path / "kept")], ["--bgen-index", str(tmp_path / "kept")]):
        args = ["--covar-names", "age", *more]
        for name, file in (("--pheno-file", "p.csv"), ("--cov-file", "c.csv"), ("--bgen", "one.bgen"), ("--sample", "x.sample"), ("--include-snp-file", "list.txt"), ("--corr-file", "corr"), ("--out", "out.txt")):
            args += [name, str(tmp_path / file)]
        results.append(spark.read.parquet(cli.main(args, spark)[0]).collect())
    assert len(results[0]) == 1 and results[0] == results[1] == results[2]
