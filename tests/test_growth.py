"""Steps whose work or memory must not grow faster than the rows."""

import numpy as np
from pyspark.sql import functions as F

from locusmill.jobs import study
from locusmill.operators import align, mixed, nullmodel
from locusmill.sources.text import read_corrections


def test_a_correction_table_is_written_by_many_tasks(spark, tmp_path):
    samples = spark.range(1000).select(F.col("id").alias("sample_id"), F.col("id").alias("sample_idx"))
    resid = samples.filter("sample_id % 3 > 0").select("sample_id", F.lit("a b").alias("pheno"), (F.col("sample_id") / 7).alias("resid"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        study.write_corrections(samples, resid, {"a b": 1.25}, str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted((tmp_path / "c").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and [line.split("\t")[0].strip('"') for line in lines] == ["#", *map(str, range(1000))]
    c2, back = read_corrections(spark, str(tmp_path / "c"))
    assert c2.collect() == [("a b", 1.25)]
    assert {(r["sample_id"], r["resid"]) for r in back.collect()} == {(str(i), i / 7 if i % 3 else 0.0) for i in range(1000)}


def test_logistic_steps_read_their_rows_once_from_the_source(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-x))).astype(float)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").mapInArrow(count, "x double, y double")
    fit = nullmodel.fit_logistic(rows, ["x"])
    assert fit.converged and seen.value == 200
    predicted = nullmodel.with_predictor(nullmodel._one(rows, "y", "y"), [fit], ["x"])
    assert "Broadcast" in predicted._jdf.queryExecution().executedPlan().toString()


def test_the_kernel_of_repeated_rows_is_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    who = [0, 0, 0, 1, 1, 2, 3, 3, 4, 5, 5, 5]
    table = [(i, who.index(s), float(rng.normal()), float(rng.normal())) for i, s in enumerate(who)]
    rows = spark.createDataFrame(table, "row_idx long, subject long, y double, x double")
    # subjects 0 and 2, 1 and 3 are kin; one entry joins rows that are no subject's first
    pairs = [(i, i, 1.0) for i in range(12)] + [(2, 5, 0.25), (5, 2, 0.25), (4, 7, 0.5), (7, 4, 0.5)]
    kin = spark.createDataFrame(pairs, "i long, j long, value double")
    ones = align.repeated_measure_kernel(rows.select(F.col("subject").alias("sample_id"), "row_idx"))
    for own, tau in (([kin], [1.0, 0.5, 0.7]), ([], [1.0, 0.7])):
        (a, left), (b, right) = (mixed.mixed_at(rows, [*own, k], ["x"], tau) for k in (ones, mixed.SAME_SUBJECT))
        assert np.allclose(a.coef, b.coef) and np.isclose(a.c1, b.c1) and np.isclose(a.c2, b.c2)
        left, right = ({r["row_idx"]: r["resid"] for r in t.collect()} for t in (left, right))
        assert left.keys() == right.keys() and np.allclose([left[i] for i in left], [right[i] for i in left])

    def fail(*_):
        raise AssertionError("all pairs of rows")

    monkeypatch.setattr(study, "repeated_measure_kernel", fail)
    cohort = rows.select("subject", "x", F.col("row_idx").alias("order")).withColumnRenamed("subject", "sample_id")
    _, c2, fits = study.fit_null(cohort, rows.select(F.col("subject").alias("sample_id"), F.lit("t").alias("pheno"), "y", F.col("row_idx").alias("order")), ["x"])
    assert len(fits) == 1 and c2["t"] > 0
