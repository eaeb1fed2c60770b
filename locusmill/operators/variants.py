"""Variant summaries and filters over arrays of dosages or over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summaries(dosage: Column, variance: str = "sample") -> dict[str, Column]:
    """n_samples, af and gv of an array of dosages, without exploding it."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    add = lambda acc, g: F.when(g.isNull(), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["s"] + g).alias("s"), (acc["q"] + g.cast("double") * g).alias("q")))
    t = F.aggregate(dosage, zero, add)
    square = t["q"] - t["s"] * t["s"] / F.nullif(t["n"], F.lit(0))
    over = t["n"] - 1 if variance == "sample" else t["n"]
    return {"n_samples": t["n"], "af": t["s"] / F.nullif(t["n"], F.lit(0)) / 2, "gv": F.greatest(square, F.lit(0.0)) / F.nullif(over, F.lit(0))}


def summarise(geno: DataFrame, variance: str = "sample") -> DataFrame:
    return geno.withColumns(summaries(F.col("dosage"), variance))


def summarise_long(long: DataFrame, key: str = "variant_id") -> DataFrame:
    """The same from rows (variant, sample, dosage), both variances."""
    return long.groupBy(key).agg(F.count("dosage").alias("n_samples"), (F.avg("dosage") / 2).alias("af"), F.var_pop("dosage").alias("gv_pop"), F.var_samp("dosage").alias("gv_samp"))


def maf_filter(df: DataFrame, maf: float = 0.001) -> DataFrame:
    """Variants with maf <= af <= 1 - maf; those without any sample go."""
    return df.filter(F.col("af").between(maf, 1 - maf))


def include_filter(df: DataFrame, include: DataFrame, key: str = "variant_id") -> DataFrame:
    return df.join(include.select(key), key, "left_semi")


def check_included(df: DataFrame, include: DataFrame, key: str = "variant_id") -> None:
    """Every listed variant must be there."""
    lost = include.select(key).join(df.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"variant {lost[0][0]} of the include list is not in the genotypes")
