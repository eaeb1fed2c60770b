import pytest

from locusmill.jobs import cli, study


def test_repeated_samples_need_an_order(spark):
    once, twice = [(str(i), float(i * i % 7)) for i in range(12)], [(str(i % 6), float(i * i % 7)) for i in range(12)]
    for cov, pheno in ((once, twice), (twice, once), (twice, twice)):
        cohort = spark.createDataFrame(cov, "sample_id string, x double")
        phenotypes = spark.createDataFrame([(s, "p", y) for s, y in pheno], "sample_id string, pheno string, y double")
        with pytest.raises(ValueError, match="several rows"):
            study.fit_null(cohort, phenotypes, ["x"])


def test_a_sample_file_of_another_length_is_an_error(tmp_path):
    import struct

    block = b"".join(struct.pack("<H", 2) + x for x in (b"s0", b"s1"))
    block = struct.pack("<2I", 8 + len(block), 2) + block
    (tmp_path / "x.bgen").write_bytes(struct.pack("<4I", 20 + len(block), 20, 0, 2) + b"bgen" + struct.pack("<I", 2 << 2 | 1 << 31) + block)
    (tmp_path / "x.sample").write_text("ID_1 ID_2\n0 0\na 1\nb 2\nc 3\n")
    assert cli.genotype_ids(None, str(tmp_path / "x.bgen"), None) == ["s0", "s1"]
    with pytest.raises(ValueError, match="3 samples"):
        cli.genotype_ids(None, str(tmp_path / "x.bgen"), str(tmp_path / "x.sample"))


def test_families_follow_every_kernel(spark):
    from locusmill.operators import mixed

    rows = spark.createDataFrame([(i, [float(i % 3)]) for i in range(6)], "row_idx long, y array<double>")
    kernels = [spark.createDataFrame([(i, i, 1.0) for i in range(6)] + [edge], "i long, j long, value double") for edge in ((0, 1, 0.5), (2, 3, 0.5), (1, 4, 0.5))]
    found = sorted(len(r["r"]) for r in mixed.blocks(rows, kernels, []).collect())
    assert found == [1, 2, 3]
