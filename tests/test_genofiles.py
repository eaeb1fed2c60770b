import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from locusmill.operators.assoc import Projector, Traits, test_block as dense_tests
from locusmill.streaming.genofiles import GenotypeStreamReader, associate_files, landed, run_files

from .test_study import write_bed


def test_files_are_taken_once_through_a_failure_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 30
    design = np.column_stack([np.ones(n), rng.normal(size=n)])
    traits = Traits(["a", "b"], rng.normal(size=(n, 2)), np.array([1.0, 2.0]), design)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    dosage = {f"part{i}.bed": rng.integers(0, 3, (4 + i, n)) for i in range(3)}
    take = lambda: run_files(associate_files(spark, str(folder), traits), out, state)
    write_bed(folder / "part0.bed", dosage["part0.bed"].tolist())
    take()
    # the next file is broken, so its batch fails after the offset is logged
    write_bed(folder / "part1.bed", dosage["part1.bed"].tolist())
    whole = (folder / "part1.bed").read_bytes()
    (folder / "part1.bed").write_bytes(whole[:-1])
    with pytest.raises(StreamingQueryException):
        take()
    (folder / "part1.bed").write_bytes(whole)
    write_bed(folder / "part2.bed", dosage["part2.bed"].tolist())
    take()
    take()
    got = spark.read.parquet(out).collect()
    assert len(got) == 2 * sum(len(g) for g in dosage.values())
    want = {name: dense_tests(g.astype(float), traits, Projector(design))["beta"] for name, g in dosage.items()}
    for r in got:
        assert r["beta"] == pytest.approx(want[r["file"]][r["variant_idx"], traits.names.index(r["pheno"])])


def test_landing_order(tmp_path):
    reader = GenotypeStreamReader({"path": str(tmp_path)})
    assert reader.latestOffset() == reader.initialOffset() == {"after": "", "files": 0}
    for name in ("b", "d"):
        write_bed(tmp_path / f"{name}.bed", [[0, 1, 2]])
    (tmp_path / "c.bed").write_bytes(b"")
    # c has no companions yet, so d waits
    assert landed(str(tmp_path)) == ["b.bed"]
    offset = reader.latestOffset()
    assert [p.path.rpartition("/")[2] for p in reader.partitions(reader.initialOffset(), offset)] == ["b.bed"]
    write_bed(tmp_path / "a.bed", [[0, 1, 2]])
    write_bed(tmp_path / "c.bed", [[2, 1, 2]])
    with pytest.raises(ValueError, match="names must rise"):
        reader.partitions(offset, reader.latestOffset())
    with pytest.raises(ValueError, match="is gone"):
        reader.partitions(reader.initialOffset(), {"after": "z.bed", "files": 9})
