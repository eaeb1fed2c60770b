"""A whole study: null models, correction table, association and text output."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.align import binary_traits, kinship_matrix, kinship_pairs, repeated_measure_kernel, with_row_index
from ..operators.assoc import RepeatedProjector, Traits, associate
from ..operators.mixed import SAME_SUBJECT, Trait, fit_mixed, with_slopes
from ..operators.onefamily import stacks_for
from ..operators.nullmodel import Fit, correct_traits, fit_logistic_traits, fit_traits, gram
from ..operators.shared import materialise


@dataclass(frozen=True)
class StudyOptions:
    covariates: tuple[str, ...] = ()
    maf: float = 0.001
    variance: str = "sample"
    missing: str = "NA"
    out: str = "out.txt"

    def __post_init__(self) -> None:
        if not 0 <= self.maf < 0.5:
            raise ValueError("maf must lie in [0, 0.5)")
        if self.variance not in ("sample", "population"):
            raise ValueError("variance is sample or population")


def _several_rows(df: DataFrame, keys: list[str]) -> bool:
    return not df.groupBy(*keys).count().filter("count > 1").isEmpty()


def fit_null(cohort: DataFrame, phenotypes: DataFrame, covariates: list[str], kinship: DataFrame | None = None, diagonal: float = 1.0, slope: str | None = None, largest: int = 4096) -> tuple[DataFrame, dict[str, float], list[Fit]]:
    """(sample_id, pheno, resid), c2 by trait and the fits.

    cohort: (sample_id, covariates...), complete. Every trait has its own samples; its family
    follows from its values. With kinship (id1, id2, edge_idx, value), or with several rows a
    sample, every trait gets a mixed model: the kinship matrix is ``diagonal`` on every sample
    plus the listed entries, and samples with several rows add a kernel of ones over the rows of
    a sample. The k-th row of a sample in the cohort belongs to its k-th value of a trait, in the
    order of the column ``order`` that both tables then need. ``slope`` names the covariate whose
    coefficient varies as the kernels do. Where a family has more than ``largest`` rows, no family is
    inverted and traces are estimated (``operators/onefamily.py``; Gaussian traits only). Fits that don't converge say so; their last step counts.
    """
    repeated = _several_rows(cohort, ["sample_id"]) or _several_rows(phenotypes, ["sample_id", "pheno"])
    if repeated and not ("order" in cohort.columns and "order" in phenotypes.columns):
        raise ValueError("a sample has several rows: both tables need a column order")
    if slope is not None and slope not in covariates:
        raise ValueError(f"the random slope {slope} must be one of the covariates")
    if slope is not None and kinship is None and not repeated:
        raise ValueError("a random slope needs a kinship or several rows a sample")
    kinds = {r["pheno"]: r["family"] for r in binary_traits(phenotypes).orderBy("pheno").collect()}
    if constant := [p for p, kind in kinds.items() if kind == "constant"]:
        raise ValueError(f"{constant[0]} is constant")
    mixed = repeated or kinship is not None
    if mixed:
        cohort = materialise(with_row_index(cohort, ["sample_id", *(["order"] if repeated else [])]), "cohort")
    keys = ["sample_id", "occurrence"] if repeated else ["sample_id"]
    if repeated:
        number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("order"))
        cohort = cohort.withColumn("occurrence", number("sample_id"))
        phenotypes = phenotypes.withColumn("occurrence", number("sample_id", "pheno"))
    # all traits at once: the number of jobs doesn't follow the number of traits
    rows = materialise(cohort.join(phenotypes.filter("y is not null").select(*keys, "pheno", "y"), keys), "traits")
    found = fit_traits(rows, covariates)
    if lost := [p for p in kinds if p not in found]:
        raise ValueError(f"{lost[0]}: no sample of the cohort has a value")
    found |= fit_logistic_traits(rows, covariates, {p: f for p, f in found.items() if kinds[p] == "binomial"})
    fits = [found[p] for p in kinds]
    if not mixed:
        out, c2 = correct_traits(rows, fits, covariates, cohort.count())
        return out, {p: c2[p] for p in kinds}, fits
    index = cohort.select("sample_id", "row_idx")
    kernels = [kinship_matrix(kinship_pairs(kinship, index), index, diagonal, repeated)] if kinship is not None else []
    kernels = [materialise(k, "kernel") for k in kernels]
    if repeated:
        # a random slope changes the entries, so they are listed
        kernels.append(SAME_SUBJECT if slope is None else materialise(repeated_measure_kernel(index), "kernel"))
    triples = []
    if slope is not None:
        kernels, triples = with_slopes(kernels, cohort.select("row_idx", F.col(f"`{slope}`").alias("s")))
        kernels = [materialise(k, "kernel") for k in kernels]
    values = phenotypes.filter("y is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pheno", "y"))).alias("m"))
    y = F.array(*[F.coalesce(F.try_element_at("m", F.lit(p)), F.lit(float("nan"))) for p in kinds])
    # rows without any trait stay: the correction's trace runs over the whole cohort
    wide = cohort.join(values, keys, "left").select("row_idx", F.min("row_idx").over(Window.partitionBy("sample_id")).alias("subject"), y.alias("y"), *covariates)
    every = ["intercept", *covariates]
    traits = []
    for i, f in enumerate(fits):
        columns = [every.index(c) for c in f.names]
        start = np.zeros(len(every))
        start[columns] = f.coef
        traits.append(Trait(i, columns, f.family == "binomial", start))
    fitted, by_row = fit_mixed(stacks_for(wide, kernels, covariates, largest), traits, triples)
    done = [Fit(f.pheno, f.names, m.coef[t.columns], m.cov, float(m.tau[0]), m.n, f.family, f.converged and m.converged, tuple(m.tau.tolist())) for f, m, t in zip(fits, fitted, traits)]
    resid = by_row.join(index, "row_idx").select("sample_id", F.element_at(F.array(*[F.lit(p) for p in kinds]), F.col("trait") + 1).alias("pheno"), "resid")
    return resid, {p: m.c2 for p, m in zip(kinds, fitted)}, done


def traits_of(samples: DataFrame, residuals: DataFrame, c2: dict[str, float], covariates: list[str]) -> Traits:
    """The broadcast side of the association kernel, in sample order.

    samples: (sample_idx, sample_id, covariates...). Its size is samples x (traits + covariates).
    """
    from ..operators.align import zero_filled

    names = list(c2)
    rows = zero_filled(samples.select("sample_idx", "sample_id"), residuals, names).join(samples.select("sample_idx", *covariates), "sample_idx").orderBy("sample_idx").toArrow()
    column = lambda c: rows[c].to_numpy().astype(float)
    resid = np.stack([column(c) for c in names], axis=1)
    design = np.stack([np.ones(len(resid)), *[column(c) for c in covariates]], axis=1)
    return Traits(names, resid, np.array([c2[n] for n in names]), design)


def repeated_setup(rows: DataFrame, covariates: list[str]) -> tuple[DataFrame, RepeatedProjector]:
    """Per-sample covariate sums and the projector for several rows a sample (sample_id, covariates...)."""
    d = rows.withColumn("intercept", F.lit(1.0))
    names = ["intercept", *covariates]
    sums = d.groupBy(*[c for c in ("sample_idx", "sample_id") if c in rows.columns]).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])
    g = gram(d, names)
    local = sums.orderBy(sums.columns[0]).toArrow()
    s = np.stack([local[c].to_numpy().astype(float) for c in names], axis=1)
    return sums, RepeatedProjector(s, g, local["n"].to_numpy().astype(float))


def run_study(geno: DataFrame, samples: DataFrame, phenotypes: DataFrame, covariates: list[str]) -> DataFrame:
    """Association of unrelated samples (sample_idx, sample_id, covariates...) from end to end."""
    cohort = samples.dropna(subset=covariates)
    resid, c2, _ = fit_null(cohort.select("sample_id", *covariates), phenotypes, covariates)
    traits = traits_of(cohort, resid, c2, covariates)
    return associate(geno, traits)


def write_corrections(samples: DataFrame, residuals: DataFrame, c2: dict[str, float], path: str) -> None:
    """The correction table as text: c2 in a row named '#', then one row a sample, 17 digits.

    A folder of files whose names rise with the rows; each starts with the header, as ``read_delimited`` expects.
    """
    from ..operators.align import zero_filled

    names = list(c2)
    text = lambda c: F.format_string("%.17g", c)
    body = zero_filled(samples, residuals, names).select((F.col("sample_idx") + 1).alias("o"), F.col("sample_id").cast("string").alias("sample_id"), *[text(F.col(f"`{n}`")).alias(n) for n in names])
    head = samples.sparkSession.createDataFrame([(0, "#", *[f"{c2[n]:.17g}" for n in names])], body.schema)
    head.unionByName(body).orderBy("o").drop("o").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def to_text(spark: SparkSession, parquet: str, out: str, single_file: bool = False) -> None:
    """Parquet results as tab-separated text with a header."""
    df = spark.read.parquet(parquet)
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(out)


def output_name(genotype_path: str, out: str) -> str:
    """<stem of the genotype file>_<base of out>.parquet, with safe characters only."""
    safe = lambda p: re.sub(r"[^A-Za-z0-9._-]", "_", PurePosixPath(p).stem)
    return f"{safe(genotype_path)}_{safe(out)}.parquet"
