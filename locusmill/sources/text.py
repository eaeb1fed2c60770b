"""Delimited and whitespace tables of a study, read with Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import strip_cell

_DELIMITERS = {"t": "\t", "tab": "\t", "\\t": "\t", "0": " ", "space": " ", "\\0": " "}


def delimiter(name: str) -> str:
    """A delimiter by name (t, tab, 0, space) or itself."""
    return _DELIMITERS.get(name.lower() if len(name) > 1 else name, name)


def _first_line(spark: SparkSession, path: str):
    """The first row of the first file by name that has one; Spark itself reads the largest file of a folder first."""
    table = spark.read.text(path)
    files = sorted(table.inputFiles())
    if len(files) < 2:
        return table.limit(1).first()
    return next((row for row in (spark.read.text(f).limit(1).first() for f in files) if row is not None), None)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", missing: str = "NA", columns: list[str] | None = None, ragged: str = "missing", order: str | None = None) -> DataFrame:
    """All columns as strings; quotes and carriage returns go, missing tokens and empty cells are null.

    A repeated header is an error. Blank lines, and lines equal to the header (a folder's first
    file has one, the others may), are no rows. One empty cell more at a line's end is ignored; a row of any
    other width has all cells missing, or with ``ragged="error"`` stops the read. ``columns``
    keeps those columns, in file order. ``order`` names a column that sorts rows as the file
    does, however many tasks read it: file, first byte of the task's range, line in it.
    """
    if ragged not in ("missing", "error"):
        raise ValueError("ragged is missing or error")
    sep = delimiter(sep)
    head = _first_line(spark, path)
    if head is None:
        raise ValueError(f"{path} is empty")
    names = [c.strip().replace('"', "") for c in head[0].rstrip("\r").split(sep)]
    if len(names) > 1 and not names[-1]:
        names.pop()
    if len(set(names)) != len(names):
        raise ValueError(f"repeated header in {path}")
    if columns is not None:
        lost = [c for c in columns if c not in names]
        if lost:
            raise ValueError(f"{path} has no column {lost[0]}")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", *([place.alias("place")] if order else []))
    lines = lines.filter((F.trim(F.regexp_replace("value", "\r", "")) != "") & (F.col("value") != head[0]))
    cells = lines.withColumn("cells", F.split(F.regexp_replace("value", "\r$", ""), re.escape(sep), -1))
    extra = (F.size("cells") == len(names) + 1) & (F.element_at("cells", -1) == "")
    fits = (F.size("cells") == len(names)) | extra
    if ragged == "error":
        said = F.concat(F.lit(f"a row of {path} has not the header's {len(names)} cells: "), F.substring("value", 1, 80))
        cells = cells.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    kept = [(i, n) for i, n in enumerate(names) if columns is None or n in columns]
    cell = lambda i: strip_cell(F.get("cells", F.lit(i)))
    return cells.select(*[F.when(fits & (cell(i) != "") & (cell(i) != missing), cell(i)).alias(n) for i, n in kept], *([F.col("place").alias(order)] if order else []))


def numeric_columns(spark: SparkSession, path: str, id_column: str, sep: str = ",", missing: str = "NA") -> list[str]:
    """Columns all of whose cells that aren't missing are numbers, and some are; the ids are none of them."""
    raw = read_delimited(spark, path, sep, missing)
    names = [n for n in raw.columns if n != id_column]
    cell = lambda n: F.col(f"`{n}`")
    seen = raw.agg(F.count(F.lit(1)).alias("n"), *[f.alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("a", F.count(cell(n))), ("b", F.count(cell(n).try_cast("double"))))]).first()
    return [n for i, n in enumerate(names) if seen[f"a{i}"] and seen[f"a{i}"] == seen[f"b{i}"]]


def read_covariates(spark: SparkSession, path: str, id_column: str, covariates: list[str], sep: str = ",", missing: str = "NA", order: str | None = None) -> DataFrame:
    """(sample_id string, covariates double...); a cell that isn't a number, or a row of another width than the header, is an error when it is read."""
    raw = read_delimited(spark, path, sep, missing, [id_column, *covariates], "error", order)
    return raw.select(F.col(f"`{id_column}`").alias("sample_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in covariates], *([order] if order else []))


def read_phenotypes(spark: SparkSession, path: str, sep: str = ",", missing: str = "NA", order: str | None = None) -> DataFrame:
    """(sample_id, pheno, y) of every trait column; the first two columns are FID and IID. A ragged row has no values."""
    raw = read_delimited(spark, path, sep, missing, order=order)
    more = [order] if order else []
    names = [c for c in raw.columns if c not in more]
    if len(names) < 3:
        raise ValueError("a phenotype file has FID, IID and at least one trait")
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("pheno"), F.col(f"`{t}`").cast("double").alias("y")) for t in names[2:]])).alias("p")
    return raw.select(F.col(f"`{names[1]}`").alias("sample_id"), pairs, *more).select("sample_id", "p.pheno", "p.y", *more)


def read_kinship(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(id1, id2, value): three columns, whatever their names."""
    raw = read_delimited(spark, path, sep)
    if len(raw.columns) != 3:
        raise ValueError("a kinship file has three columns")
    a, b, v = raw.columns
    return raw.select(F.col(f"`{a}`").alias("id1"), F.col(f"`{b}`").alias("id2"), F.col(f"`{v}`").cast("double").alias("value"))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    t = _tokens(spark, path)
    names = ("chr", "snp", "cm", "pos", "a1", "a2")
    out = t.select(*[F.get("t", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.withColumn("cm", F.col("cm").cast("double")).withColumn("pos", F.col("pos").cast("long"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(fid, sample_id): the second column is the sample's id."""
    return _tokens(spark, path).select(F.get("t", F.lit(0)).alias("fid"), F.get("t", F.lit(1)).alias("sample_id"))


def read_sample_ids(path: str) -> list[str]:
    """Ids of a .sample file in order: the first token of each line after two header lines."""
    from .genotype import _open

    with _open(path) as f:
        lines = f.read().decode().splitlines()
    return [line.split()[0] for line in lines[2:] if line.strip()]


def read_include_list(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id) under a header snpid or rsid of any case; a repeated id is an error."""
    raw = read_delimited(spark, path, "\t")
    if raw.columns[0].lower() not in ("snpid", "rsid"):
        raise ValueError("an include list has the header snpid or rsid")
    out = raw.select(F.col(f"`{raw.columns[0]}`").alias("variant_id")).filter("variant_id is not null")
    if out.groupBy("variant_id").count().filter("count > 1").limit(1).count():
        raise ValueError("repeated variant in the include list")
    return out


def read_corrections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pheno, c2) and (sample_id, pheno, resid) of a correction table in text form."""
    raw = read_delimited(spark, path, "\t", ragged="error")
    traits = raw.columns[1:]
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("pheno"), F.col(f"`{t}`").cast("double").alias("v")) for t in traits])).alias("p")
    long = raw.select("sample_id", pairs).select("sample_id", "p.pheno", "p.v")
    return long.filter("sample_id = '#'").select("pheno", F.col("v").alias("c2")), long.filter("sample_id <> '#'").withColumnRenamed("v", "resid")
