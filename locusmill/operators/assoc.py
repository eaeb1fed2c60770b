"""Association of every variant with every trait.

The kernel maps Arrow batches of dosage arrays: one projection on an orthonormal covariate
basis and one matrix product with all traits for a whole batch, no shuffle. What it
broadcasts has the size samples x (traits + covariates); its bytes are checked first, and
beyond ``most_bytes`` the traits are tested in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import neg_log10_two_sided


@dataclass
class Traits:
    """Corrected residuals in sample order, with c2 of each trait, and the design matrix."""

    names: list[str]
    resid: np.ndarray  # (samples, traits)
    c2: np.ndarray
    design: np.ndarray  # (samples, columns), with intercept

    def block(self, lo: int, hi: int) -> "Traits":
        return Traits(self.names[lo:hi], self.resid[:, lo:hi], self.c2[lo:hi], self.design)


class Projector:
    """g -> g without what the design explains, for dosages of shape (variants, samples)."""

    def __init__(self, design: np.ndarray) -> None:
        self.q = np.linalg.qr(design)[0]

    def __call__(self, g: np.ndarray) -> np.ndarray:
        return g - (g @ self.q) @ self.q.T


class RepeatedProjector:
    """The same for several rows a sample: sums is J'X, gram is X'X, repeats the rows of each sample."""

    def __init__(self, sums: np.ndarray, gram: np.ndarray, repeats: np.ndarray) -> None:
        self.sums, self.repeats = sums, repeats
        self.inner = np.linalg.solve(gram, sums.T)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        return (g * self.repeats - (g @ self.sums) @ self.inner) / self.repeats


def test_block(g: np.ndarray, t: Traits, project) -> dict[str, np.ndarray]:
    """beta, se, t and -log10 p of shape (variants, traits). Missing dosages take the variant's mean."""
    mean = np.nanmean(g, axis=1, keepdims=True)
    r = project(np.where(np.isnan(g), mean, g))
    r = r - r.mean(axis=1, keepdims=True)
    y = t.resid - t.resid.mean(axis=0)
    n = len(y)
    sd_g = np.maximum(np.sqrt((r * r).mean(axis=1)), 1e-8)[:, None]
    sd_y = np.maximum(np.sqrt((y * y).mean(axis=0)), 1e-8)[None, :]
    corr = np.clip((r @ y) / n / sd_g / sd_y, -1, 1)
    beta = corr * sd_y / sd_g
    se = np.sqrt(np.maximum(1 - corr**2, 0) / (n - 2)) * sd_y / sd_g / np.sqrt(t.c2)
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.where(se > 0, beta / se, np.inf * np.sign(beta))
    return {"beta": beta, "se": se, "t": stat, "neg_log10_p": neg_log10_two_sided(stat)}


_LONG = "variant_id string, pheno string, beta double, se double, t double, neg_log10_p double"


def associate(geno: DataFrame, traits: Traits, project=None, most_bytes: int = 512 << 20) -> DataFrame:
    """(variant_id, pheno, beta, se, t, neg_log10_p) for rows (variant_id, dosage array in sample order)."""
    if (traits.c2 <= 0).any():
        raise ValueError("c2 must be positive")
    each = max(1, int((most_bytes // 8 - traits.design.size) // max(1, len(traits.resid))))
    parts = [traits.block(i, min(i + each, len(traits.names))) for i in range(0, len(traits.names), each)]
    return reduce(DataFrame.unionByName, [_associate(geno, t, project or Projector(t.design)) for t in parts])


def _associate(geno: DataFrame, t: Traits, project) -> DataFrame:
    shared = geno.sparkSession.sparkContext.broadcast((t, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, residualise = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("dosage").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            seen = ~np.isnan(g).all(axis=1)
            res = test_block(g[seen], own, residualise)
            ids = batch.column("variant_id").filter(pa.array(seen)).to_numpy(zero_copy_only=False)
            k = len(own.names)
            yield pa.record_batch([pa.array(np.repeat(ids, k), pa.string()), pa.array(np.tile(own.names, len(ids)), pa.string()), *(pa.array(res[c].ravel()) for c in ("beta", "se", "t", "neg_log10_p"))], ["variant_id", "pheno", "beta", "se", "t", "neg_log10_p"])

    return geno.select("variant_id", "dosage").mapInArrow(run, _LONG)


def widen(long: DataFrame, phenos: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row a variant: <pheno>_BETA, <pheno>_SE and <pheno>_pvalue, which holds -log10 p."""
    keys = keys or ["variant_id"]
    pick = lambda p, c: F.max(F.when(F.col("pheno") == p, F.col(c)))
    columns = [pick(p, c).alias(f"{p}_{n}") for p in phenos for c, n in (("beta", "BETA"), ("se", "SE"), ("neg_log10_p", "pvalue"))]
    return long.groupBy(*keys).agg(*columns)


def dosage_arrays(long: DataFrame) -> DataFrame:
    """(variant_id, dosage array in sample order) from a row for each variant and sample; the dosage may be null."""
    row = F.sort_array(F.collect_list(F.struct("sample_idx", F.col("dosage").cast("float").alias("dosage"))))
    return long.groupBy("variant_id").agg(row.alias("d")).select("variant_id", F.col("d.dosage").alias("dosage"))
