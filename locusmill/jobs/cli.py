"""Command line: null model, association and text conversion, alone or in turn.

python -m locusmill.jobs.cli --step all --pheno-file p.csv --cov-file c.csv --sampleid-name IID
  --covar-names age sex --bed x.bed --out out.txt
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.assoc import associate, widen
from ..operators.blocked import associate_blocks, cohort_of, split_blocks
from ..operators.tallskinny import independent
from ..operators.variants import check_included, include_filter, maf_filter, summarise
from ..sources.bgenindex import ensure_index, read_index, read_indexed
from ..sources.genotype import bgen_header, gather, genotypes
from ..sources.text import numeric_columns, read_corrections, read_covariates, read_fam, read_include_list, read_kinship, read_phenotypes, read_sample_ids
from .study import fit_null, output_name, repeated_setup, to_text, traits_of, write_corrections

log = logging.getLogger("locusmill")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusmill")
    p.add_argument("--step", choices=("all", "step1", "step2", "step3"), default="all")
    for name in ("--pheno-file", "--cov-file", "--corr-file", "--include-snp-file", "--sample", "--kin-file"):
        p.add_argument(name)
    p.add_argument("--random-slope-name", help="covariate whose coefficient varies with the kinship or the sample")
    p.add_argument("--sampleid-name", default="IID")
    p.add_argument("--covar-names", nargs="*", default=[])
    p.add_argument("--pheno-delim", default=",")
    p.add_argument("--cov-delim", default=",")
    p.add_argument("--kin-delim", default=",")
    p.add_argument("--kin-diag", type=float, default=1.0, help="added to the diagonal entries of --kin-file")
    p.add_argument("--missing-value", default="NA")
    geno = p.add_mutually_exclusive_group()
    for name in ("--bed", "--bgen", "--pgen"):
        geno.add_argument(name, nargs="*", default=[])
    p.add_argument("--bgen-index", help="folder that keeps an index of every BGEN file; made where it is missing")
    p.add_argument("--parquet", nargs="*", default=[])
    p.add_argument("--maf", type=float, default=0.001)
    p.add_argument("--most-bytes", type=int, default=512 << 20, help="of traits and covariates to broadcast; larger cohorts are tested by blocks of samples")
    p.add_argument("--convert", action="store_true")
    p.add_argument("--out", default="out.txt")
    return p


def genotype_ids(spark: SparkSession, path: str, sample: str | None) -> list[str]:
    if path.endswith(".bed"):
        return [r["sample_id"] for r in read_fam(spark, path.removesuffix(".bed") + ".fam").collect()]
    head = bgen_header(path)
    ids = read_sample_ids(sample) if sample else list(head.ids)
    if not ids:
        raise ValueError(f"{path} has no sample ids; give --sample")
    if len(ids) != head.samples:
        raise ValueError(f"{sample} lists {len(ids)} samples, {path} has {head.samples}")
    return ids


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(argv)
    if a.pgen:
        raise SystemExit("PGEN files are not supported")
    files = [*a.bed, *a.bgen]
    if a.step != "step3" and not files:
        raise SystemExit("a genotype file is needed")
    spark = spark or SparkSession.builder.getOrCreate()
    written: list[str] = []
    corr = a.corr_file or "correction"
    if a.step in ("all", "step1", "step2"):
        ids = genotype_ids(spark, files[0], a.sample)
        index = spark.createDataFrame(list(enumerate(ids)), "sample_idx long, sample_id string")
        # where no covariates are named, the null model has an intercept and the tests take all numeric columns
        projected = a.covar_names or numeric_columns(spark, a.cov_file, a.sampleid_name, a.cov_delim, a.missing_value)
        cov = read_covariates(spark, a.cov_file, a.sampleid_name, projected, a.cov_delim, a.missing_value, "order").dropna()
        samples = index.join(cov, "sample_id")
        once = samples.select("sample_idx", "sample_id").distinct()
    if a.step in ("all", "step1"):
        pheno = read_phenotypes(spark, a.pheno_file, a.pheno_delim, a.missing_value, "order")
        kinship = read_kinship(spark, a.kin_file, a.kin_delim).withColumn("edge_idx", F.monotonically_increasing_id()) if a.kin_file else None
        resid, c2, fits = fit_null(samples.select("sample_id", "order", *a.covar_names), pheno, a.covar_names, kinship, a.kin_diag, a.random_slope_name)
        write_corrections(once, resid, c2, corr)
        for f in fits:
            if not f.converged:
                log.warning("%s: the null model doesn't converge, its last step counts", f.pheno)
            for row in f.report():
                log.info("%s %s estimate %.6g se %.6g z %.4g p %.4g", *row)
    if a.step in ("all", "step2"):
        c2_rows, resid = read_corrections(spark, corr)
        c2 = {r["pheno"]: r["c2"] for r in c2_rows.collect()}
        projected = independent(samples, projected)
        width = 8 * (len(c2) + len(projected) + 1)
        arrays = width * len(ids) <= a.most_bytes
        if arrays:
            place = sorted(r["sample_idx"] for r in once.select("sample_idx").collect())
            if samples.count() == len(place):
                traits, project = traits_of(samples, resid, c2, projected), None
            else:
                traits, project = traits_of(once, resid, c2, []), repeated_setup(samples, projected)[1]
        for path in files:
            own = {x: i for i, x in enumerate(genotype_ids(spark, path, a.sample))}
            include = read_include_list(spark, a.include_snp_file).withColumnRenamed("variant_id", "rsid") if a.include_snp_file else None
            index = ensure_index(spark, path, a.bgen_index) if a.bgen_index and path.endswith(".bgen") else None
            if include is not None and path.endswith(".bgen"):
                check_included(read_index(spark, index) if index else genotypes(spark, path).select("rsid"), include, "rsid")
            if index:
                g = read_indexed(spark, index, include=include)
            else:
                g = genotypes(spark, path)
                g = g if include is None else include_filter(g, include, "rsid")
            g = g.withColumn("variant_id", F.col("variant_idx").cast("string"))
            if arrays:
                g = maf_filter(summarise(gather(g, [own.get(ids[i], -1) for i in place])), a.maf)
                wide = widen(associate(g, traits, project), traits.names)
            else:
                there = spark.createDataFrame([(i, x) for x, i in own.items()], "sample_idx long, sample_id string")
                cohort = cohort_of(samples.drop("sample_idx").join(there, "sample_id", "left").withColumn("sample_idx", F.coalesce("sample_idx", F.lit(len(own)) + F.pmod(F.xxhash64("sample_id"), F.lit(1 << 40)))), resid, c2, projected)
                wide = maf_filter(associate_blocks(split_blocks(g), cohort, wide=True), a.maf)
                g = g.join(wide.select("variant_id", "n_samples", "af", "gv"), "variant_id")
                wide = wide.drop("n_samples", "af", "gv")
            meta = g.select("variant_id", "variant_idx", F.col("snpid").alias("SNPID"), F.col("rsid").alias("RSID"), F.col("chr").alias("CHR"), F.col("pos").cast("string").alias("POS"), F.col("non_effect").alias("Non_Effect_Allele"), F.col("effect").alias("Effect_Allele"), F.col("n_samples").cast("string").alias("N_Samples"), F.col("af").cast("float").alias("AF"), F.col("gv").cast("float").alias("GV"))
            folder = a.out.rpartition("/")[0]
            out = f"{folder}/{output_name(path, a.out)}" if folder else output_name(path, a.out)
            meta.join(wide, "variant_id").orderBy("variant_idx").drop("variant_id", "variant_idx").write.mode("overwrite").parquet(out)
            written.append(out)
    if a.step == "step3" or a.convert:
        for path in [*written, *a.parquet]:
            to_text(spark, path, path.removesuffix(".parquet") + ".txt", single_file=True)
    return written


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()
