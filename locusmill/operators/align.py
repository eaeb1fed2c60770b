"""Alignment of samples, covariates, phenotypes, kinship and genotypes by ordinary joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise


def with_row_index(df: DataFrame, order: list[str], name: str = "row_idx", parts: int | None = None) -> DataFrame:
    """Dense 0-based numbers in the order of ``order``, without a single sorting task.

    Rows are dealt by range and numbered inside each range; the ranges' sizes, a handful of
    rows, give the offsets. ``parts`` is the session's number of shuffle partitions unless given.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    offsets = dealt.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_i", own).join(F.broadcast(offsets.select("_p", "_before")), "_p").withColumn(name, F.col("_before") + F.col("_i") - 1).drop("_p", "_i", "_before")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every listed column."""
    return df.dropna(subset=columns)


def inner_by_id(genotype_ids: DataFrame, covariates: DataFrame, columns: list[str]) -> DataFrame:
    """Complete covariate rows of genotyped samples: one to many, with the sample's index."""
    return genotype_ids.join(drop_incomplete(covariates, columns), "sample_id")


def with_complete_covariates(samples: DataFrame, covariates: DataFrame, columns: list[str]) -> DataFrame:
    """Samples with at least one complete covariate row."""
    return samples.join(drop_incomplete(covariates, columns).select("sample_id"), "sample_id", "left_semi")


def zip_by_occurrence(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of an id on either side belong together."""
    number = lambda order: F.row_number().over(Window.partitionBy("sample_id").orderBy(order))
    return left.withColumn("occurrence", number(left_order)).join(right.withColumn("occurrence", number(right_order)), ["sample_id", "occurrence"])


def kinship_pairs(edges: DataFrame, cohort: DataFrame) -> DataFrame:
    """(i, j, value), i <= j, of edges with both ends in the cohort (sample_id, row_idx).

    Ends with several rows give all pairs of their rows. Of repeated unordered pairs the
    first in edge order (``edge_idx``) counts.
    """
    a = cohort.select(F.col("sample_id").alias("id1"), F.col("row_idx").alias("i"))
    b = cohort.select(F.col("sample_id").alias("id2"), F.col("row_idx").alias("j"))
    pairs = edges.join(a, "id1").join(b, "id2").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "edge_idx", "value")
    first = pairs.groupBy("i", "j").agg(F.min(F.struct("edge_idx", "value")).alias("m"))
    return first.select("i", "j", F.col("m.value").alias("value"))


def kinship_matrix(pairs: DataFrame, cohort: DataFrame, diagonal: float = 1.0, repeated: bool = False) -> DataFrame:
    """Both triangles of the sparse matrix: ``diagonal`` on every row plus the file's entries.

    repeated: samples may have several rows; all pairs of a sample's rows get ``diagonal``.
    """
    if repeated:
        ones = repeated_measure_kernel(cohort).withColumn("value", F.lit(float(diagonal)))
    else:
        ones = cohort.select(F.col("row_idx").alias("i"), F.col("row_idx").alias("j"), F.lit(float(diagonal)).alias("value"))
    mirror = pairs.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    every = reduce(DataFrame.unionByName, [pairs, mirror, ones])
    return every.groupBy("i", "j").agg(F.sum("value").alias("value"))


def repeated_measure_kernel(rows: DataFrame) -> DataFrame:
    """(i, j, 1.0) for rows (sample_id, row_idx) of the same sample."""
    other = rows.select("sample_id", F.col("row_idx").alias("j"))
    return rows.join(other, "sample_id").select(F.col("row_idx").alias("i"), "j", F.lit(1.0).alias("value"))


def zero_filled(samples: DataFrame, residuals: DataFrame, phenos: list[str]) -> DataFrame:
    """Wide residuals in sample order; a sample without one has 0."""
    wide = residuals.groupBy("sample_id").pivot("pheno", phenos).agg(F.first("resid"))
    out = samples.join(wide, "sample_id", "left")
    return out.select("sample_idx", "sample_id", *[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).alias(p) for p in phenos])


def column_order(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """(sample_id, place, own_idx): where each wanted sample stands in a file; -1 where it is absent."""
    return wanted.join(own.select("sample_id", F.col("sample_idx").alias("own_idx")), "sample_id", "left").select("sample_id", "place", F.coalesce("own_idx", F.lit(-1)).alias("own_idx"))


def sums_by_sample(rows: DataFrame, values: list[str]) -> DataFrame:
    """Incidence products: sums and row counts by sample."""
    return rows.groupBy("sample_id").agg(F.count("*").alias("n_rows"), *[F.sum(v).alias(v) for v in values])


def duplicated_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1")


def first_seen_ids(rows: DataFrame, order: str) -> DataFrame:
    return rows.groupBy("sample_id").agg(F.min(order).alias("first_idx"))


def binary_traits(long: DataFrame) -> DataFrame:
    """(pheno, n_values, family): at most two different values make a trait binomial; one value is an error for the fit."""
    n = long.filter("y is not null").groupBy("pheno").agg(F.count_distinct("y").alias("n_values"))
    return n.withColumn("family", F.when(F.col("n_values") == 2, "binomial").when(F.col("n_values") < 2, "constant").otherwise("gaussian"))


def categorical_columns(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(name, n_values, levels) of columns with at most ``most`` different values, levels in order."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select("s.*").filter("v is not null").distinct()
    few = stacked.groupBy("name").agg(F.count("*").alias("n_values")).filter(F.col("n_values") <= most)
    as_number = F.array_sort(F.collect_list(F.struct(F.col("v").try_cast("double").alias("x"), "v")))
    return stacked.join(few, "name").groupBy("name", "n_values").agg(F.array_join(F.transform(as_number, lambda s: s["v"]), ",").alias("levels"))
