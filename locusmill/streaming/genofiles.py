"""A stream of BED and BGEN files that land in a folder.

The offset is the name of the last file taken and the number of files up to it, so names must
rise as files land (dates or numbers do); a file that lands below the offset is an error, as
it would never be read. A BED file counts once its .bim and .fam are there; files behind one
that isn't complete wait. A micro-batch is planned as a plain read is: ranges of variants,
each task reads its own bytes. With a checkpoint and a file sink a restarted query takes every
file exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.assoc import Traits, associate
from ..sources.genotype import SCHEMA, BedReader, BgenReader, _at

READERS = {"bed": BedReader, "bgen": BgenReader}


def _kind(name: str) -> str:
    return name.rpartition(".")[2].lower()


def landed(folder: str) -> list[str]:
    """Names of the genotype files that can be read, in order, up to the first one that can't be yet."""
    system, at = _at(folder)
    there = {f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File}
    names = []
    for name in sorted(n for n in there if _kind(n) in READERS and n[0] not in "._"):
        if _kind(name) == "bed" and not {f"{name[:-4]}.bim", f"{name[:-4]}.fam"} <= there:
            break
        names.append(name)
    return names


class GenotypeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"after": "", "files": 0}

    def latestOffset(self) -> dict:
        names = landed(self.folder)
        return {"after": names[-1], "files": len(names)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [n for n in landed(self.folder) if n <= end["after"]]
        new = [n for n in names if n > start["after"]]
        if len(names) - len(new) > start["files"] or len(new) > end["files"] - start["files"]:
            raise ValueError(f"a file landed in {self.folder} with a name below {end['after']}; names must rise")
        if len(new) < end["files"] - start["files"]:
            raise ValueError(f"a file of the batch up to {end['after']} is gone from {self.folder}")
        return [p for n in new for p in READERS[_kind(n)]({"path": f"{self.folder}/{n}"}).partitions()]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        name = partition.path.rpartition("/")[2]
        for batch in READERS[_kind(name)]({"path": partition.path}).read(partition):
            yield pa.record_batch([*batch.columns, pa.array([name] * batch.num_rows, pa.string())], [*batch.schema.names, "file"])


class GenotypeStream(DataSource):
    """``spark.readStream.format("genotypes").load(folder)``: genotype rows with the name of their file."""

    @classmethod
    def name(cls) -> str:
        return "genotypes"

    def schema(self) -> str:
        return f"{SCHEMA}, file string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GenotypeStreamReader(self.options)


def genotype_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(GenotypeStream)
    return spark.readStream.format("genotypes").load(folder)


def associate_files(spark: SparkSession, folder: str, traits: Traits) -> DataFrame:
    """Streaming results (file, variant_idx, pheno, beta, se, t, neg_log10_p); the files' samples are in the traits' order."""
    geno = genotype_stream(spark, folder).select(F.concat_ws("/", "file", "variant_idx").alias("variant_id"), "dosage")
    out = associate(geno, traits)
    file, number = F.substring_index("variant_id", "/", 1), F.substring_index("variant_id", "/", -1)
    return out.select(file.alias("file"), number.cast("long").alias("variant_idx"), "pheno", "beta", "se", "t", "neg_log10_p")


def run_files(results: DataFrame, out: str, checkpoint: str) -> None:
    """Take what has landed and stop: a folder ``file=<name>`` for every genotype file."""
    q = results.writeStream.format("parquet").partitionBy("file").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
