"""Association by sample blocks: no sample is broadcast, collected or put into one list.

A test needs of a variant's dosages only sums: with the covariates, with the residuals, and of
squares. Samples are cut into blocks of ``width`` and variants into chunks of ``chunk``; a
task meets one block of either side, so its memory is bounded by width x chunk dosages and
width x (traits + covariates) values whatever the study's size. It returns one row of sums a
variant, and the sums of a variant's blocks are added by a grouped aggregation. The samples
travel once for each chunk of variants. Only the products of covariates and traits with each
other, a matrix of their number, come to the driver.

Defined cases: a missing dosage, or a sample without a row, takes the variant's mean; dosages
of samples outside the cohort are ignored; a variant without any dosage gives no row; samples
without a residual have 0; an empty cohort is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import neg_log10_two_sided
from .align import zero_filled
from .nullmodel import gram
from .shared import materialise

LONG = "variant_id string, pheno string, beta double, se double, t double, neg_log10_p double"


def dosage_blocks(long: DataFrame, width: int = 2048) -> DataFrame:
    """(variant_id, block, place, dosage) from a row for each variant and sample: lists of at most ``width``."""
    pair = F.struct((F.col("sample_idx") % width).cast("int").alias("place"), F.col("dosage").cast("float").alias("dosage"))
    by = long.groupBy("variant_id", F.floor(F.col("sample_idx") / width).alias("block")).agg(F.collect_list(pair).alias("d"))
    return by.select("variant_id", "block", F.col("d.place").alias("place"), F.col("d.dosage").alias("dosage"))


def split_blocks(geno: DataFrame, width: int = 2048) -> DataFrame:
    """The same from rows (variant_id, dosage array in sample order), as genotype files give them."""
    starts = F.sequence(F.lit(0), F.floor((F.size("dosage") - 1) / width).cast("int"))
    cut = geno.filter(F.size("dosage") > 0).select("variant_id", "dosage", F.explode(starts).alias("block"))
    part = F.slice("dosage", F.col("block") * width + 1, F.lit(width))
    return cut.select("variant_id", F.col("block").cast("long").alias("block"), F.sequence(F.lit(0), F.size(part) - 1).alias("place"), part.cast("array<float>").alias("dosage"))


@dataclass(frozen=True)
class Cohort:
    """Samples as (sample_idx, v): 1, number of rows, covariate sums, covariate means, residuals.

    ``products`` is v'v over all samples and ``inner`` the generalised inverse of the
    covariates' products over all rows.
    """

    samples: DataFrame
    names: list[str]
    c2: np.ndarray
    products: np.ndarray
    inner: np.ndarray


def cohort_of(rows: DataFrame, residuals: DataFrame, c2: dict[str, float], covariates: list[str]) -> Cohort:
    """rows: (sample_idx, sample_id, covariates...), several a sample where measures repeat; residuals: (sample_id, pheno, resid)."""
    names = list(c2)
    if not names or min(c2.values()) <= 0:
        raise ValueError("c2 must be positive")
    # centred and scaled covariates span the same space and keep the products well conditioned
    spread = rows.agg(F.count("*").alias("n"), *[f(F.col(f"`{c}`")).alias(f"{i}{k}") for i, c in enumerate(covariates) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not spread["n"]:
        raise ValueError("no samples")
    scaled = [((F.col(f"`{c}`") - spread[f"{i}m"]) / (spread[f"{i}s"] or 1.0)).alias(f"x{i + 1}") for i, c in enumerate(covariates)]
    z = rows.select("sample_idx", "sample_id", F.lit(1.0).alias("x0"), *scaled)
    design = [f"x{i}" for i in range(len(covariates) + 1)]
    inner = np.linalg.pinv(gram(z, design), hermitian=True)
    by = z.groupBy("sample_idx", "sample_id").agg(F.count("*").cast("double").alias("c"), *[F.sum(x).alias(x) for x in design])
    filled = zero_filled(by.select("sample_idx", "sample_id"), residuals, names)
    filled = filled.select("sample_idx", "sample_id", F.array(*[F.col(f"`{p}`").cast("double") for p in names]).alias("y"))
    sums, means = [F.col(x) for x in design], [F.col(x) / F.col("c") for x in design]
    v = F.concat(F.array(F.lit(1.0), "c", *sums, *means), "y")
    samples = materialise(by.join(filled, ["sample_idx", "sample_id"]).select("sample_idx", v.alias("v")), "cohort-rows")
    return Cohort(samples, names, np.array([c2[p] for p in names]), _products(samples, 2 + 2 * len(design) + len(names)), inner)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _products(samples: DataFrame, size: int) -> np.ndarray:
    """v'v over all samples: a matrix a task, added entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = _matrix(batch.column("v"), size)
            total += v.T @ v
        yield pa.record_batch([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["at", "x"])

    out = samples.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(size * size)
    total[out["at"].to_numpy()] = out["x"].to_numpy()
    return total.reshape(size, size)


def variant_sums(blocks: DataFrame, cohort: Cohort, width: int = 2048, chunk: int = 512, variants: int | None = None) -> DataFrame:
    """(variant_id, sums): v over seen dosages, v times dosage, and the dosages' squares.

    ``variants`` is their number where it is known; otherwise it is counted.
    """
    size = len(cohort.products)
    if variants is None:
        variants = blocks.agg(F.approx_count_distinct("variant_id")).first()[0]
    chunks = max(1, -(-variants // chunk))
    left = blocks.withColumn("chunk", F.pmod(F.xxhash64("variant_id"), F.lit(chunks).cast("long")))
    right = cohort.samples.select(F.floor(F.col("sample_idx") / width).alias("block"), (F.col("sample_idx") % width).cast("int").alias("place"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def run(geno: pa.Table, own: pa.Table) -> pa.Table:
        if not geno.num_rows or not own.num_rows:
            return pa.table({"variant_id": pa.array([], pa.string()), "s": pa.array([], pa.list_(pa.float64()))})
        v = np.zeros((width, size))
        v[own["place"].to_numpy()] = _matrix(own["v"], size)
        place, dosage = geno["place"].combine_chunks(), geno["dosage"].combine_chunks()
        g = np.full((geno.num_rows, width), np.nan)
        line = np.repeat(np.arange(geno.num_rows), np.diff(place.offsets.to_numpy()))
        g[line, place.flatten().to_numpy()] = dosage.flatten().to_numpy(zero_copy_only=False)
        seen = ~np.isnan(g)
        g[~seen] = 0
        sums = np.hstack([seen @ v, g @ v, (g * g) @ v[:, :1]])
        ends = pa.array(np.arange(geno.num_rows + 1) * sums.shape[1], pa.int32())
        return pa.table({"variant_id": geno["variant_id"], "s": pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))})

    keys = ["chunk", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "variant_id string, s array<double>")
    total = parts.groupBy("variant_id").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(2 * size + 1)])
    return total.select("variant_id", F.array(*[f"s{i}" for i in range(2 * size + 1)]).alias("sums"))


def tests_of(sums: np.ndarray, cohort: tuple[int, np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """beta, se, t and -log10 p of shape (variants with a dosage, traits) from rows of sums."""
    traits, c2, products, inner = cohort
    size = len(products)
    k = (size - 2 - traits) // 2
    n = products[0, 0]
    sums = sums[sums[:, 0] > 0]
    # the unseen samples of the cohort carry the mean of the seen ones
    mean = sums[:, size] / sums[:, 0]
    g = sums[:, size : 2 * size] + mean[:, None] * (products[0] - sums[:, :size])
    gg = sums[:, -1] + mean**2 * (n - sums[:, 0])
    left, right, y = slice(2, 2 + k), slice(2 + k, 2 + 2 * k), slice(2 + 2 * k, size)
    a = g[:, left] @ inner
    total = g[:, 0] - a @ products[right, 0]
    rr = gg - 2 * (a * g[:, right]).sum(axis=1) + ((a @ products[right, right]) * a).sum(axis=1) - total**2 / n
    ry = g[:, y] - a @ products[right, y] - np.outer(total, products[0, y]) / n
    yy = np.diag(products)[y] - products[0, y] ** 2 / n
    sd_g = np.maximum(np.sqrt(np.maximum(rr, 0) / n), 1e-8)[:, None]
    sd_y = np.maximum(np.sqrt(np.maximum(yy, 0) / n), 1e-8)[None, :]
    corr = np.clip(ry / n / sd_g / sd_y, -1, 1)
    beta = corr * sd_y / sd_g
    se = np.sqrt(np.maximum(1 - corr**2, 0) / (n - 2)) * sd_y / sd_g / np.sqrt(c2)
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.where(se > 0, beta / se, np.inf * np.sign(beta))
    return {"beta": beta, "se": se, "t": stat, "neg_log10_p": neg_log10_two_sided(stat)}


def associate_blocks(blocks: DataFrame, cohort: Cohort, width: int = 2048, chunk: int = 512, variants: int | None = None, wide: bool = False) -> DataFrame:
    """(variant_id, pheno, beta, se, t, neg_log10_p), or with ``wide`` one row a variant:
    n_samples, af and gv over the cohort, then <pheno>_BETA, <pheno>_SE and <pheno>_pvalue (-log10 p).

    ``width`` must be that of the blocks.
    """
    own = (len(cohort.names), cohort.c2, cohort.products, cohort.inner)
    names, size = cohort.names, 2 * len(cohort.products) + 1
    picked = (("beta", "BETA"), ("se", "SE"), ("neg_log10_p", "pvalue"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = _matrix(batch.column("sums"), size)
            ids = batch.column("variant_id").filter(pa.array(sums[:, 0] > 0))
            res = tests_of(sums, own)
            if wide:
                seen = sums[sums[:, 0] > 0]
                n, total, squares = seen[:, 0], seen[:, size // 2], seen[:, -1]
                gv = np.maximum(squares - total**2 / n, 0) / np.where(n > 1, n - 1, np.nan)
                columns = [("n_samples", pa.array(n.astype(np.int64))), ("af", pa.array(total / n / 2)), ("gv", pa.array(gv, mask=np.isnan(gv)))]
                columns += [(f"{p}_{n}", pa.array(np.ascontiguousarray(res[c][:, i]))) for i, p in enumerate(names) for c, n in picked]
            else:
                ids = pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), len(names)), pa.string())
                columns = [("pheno", pa.array(np.tile(names, len(ids) // len(names)), pa.string())), *((c, pa.array(res[c].ravel())) for c in ("beta", "se", "t", "neg_log10_p"))]
            yield pa.record_batch([ids, *(c for _, c in columns)], ["variant_id", *(n for n, _ in columns)])

    schema = ", ".join(["variant_id string, n_samples long, af double, gv double", *(f"`{p}_{n}` double" for p in names for _, n in picked)]) if wide else LONG
    return variant_sums(blocks, cohort, width, chunk, variants).mapInArrow(run, schema)
