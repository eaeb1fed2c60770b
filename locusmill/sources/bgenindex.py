"""A kept index of BGEN files: where each variant's block lies, as a Parquet table.

Blocks are chained by their sizes, so finding them takes a walk over a file's variant headers.
Tasks do that once, one for each file. Later reads start from the table: Spark prunes it by
region (Parquet statistics) or by a join with an include list before any partition of
genotypes is planned, and the tasks seek to the blocks that are left.

Defined cases: no listed variant gives no rows; a file whose size isn't the indexed one is an
error; variants keep their number in the whole path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import genotype
from .genotype import BATCH, RANGE_BYTES, SCHEMA, bgen_header, decode_block

INDEX = "variant_idx long, snpid string, rsid string, chr string, pos long, non_effect string, effect string, file string, bytes long, at long, length long"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def walk(path: str, before: int) -> Iterator[tuple]:
    """Index rows of a file whose first variant has number ``before``."""
    head = bgen_header(path)
    with genotype._open(path) as f:
        size = f.size()
        f.seek(head.first)
        for i in range(head.variants):
            meta, length = genotype._variant(f, head)
            yield (before + i, *meta, path, size, f.tell(), length)
            f.seek(f.tell() + length)


def _walk_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
            rows = []
            for row in walk(path, before):
                rows.append(row)
                if len(rows) == 8192:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The index of a BGEN file, or of a folder of written ones, in the folder ``index``, which must not exist."""
    files, before = [], 0
    for file in genotype._files(path):
        files.append((file, before))
        before += bgen_header(file).variants
    df = spark.createDataFrame(files, "file string, before long")
    df.repartitionByRange(max(1, len(files)), "before").mapInArrow(_walk_files, INDEX).write.mode("error").parquet(index)


def ensure_index(spark: SparkSession, path: str, folder: str) -> str:
    """The index of ``path`` in ``folder``, written where no complete one is there."""
    index = f"{folder.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}.index"
    system, at = genotype._at(index)
    if system.get_file_info(f"{at}/_SUCCESS").type == fs.FileType.NotFound:
        if system.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{index} is not complete; remove it")
        write_index(spark, path, index)
    return index


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(index)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Genotype rows of index rows; a task keeps one file open and seeks to the listed blocks."""
    path, head, f = None, None, None
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                rows, dosages = [], []
                for r in batch.slice(start, BATCH).to_pylist():
                    # a batch of one shape: files may differ in their samples
                    if r["file"] != path:
                        if rows:
                            yield genotype._batch(rows, np.stack(dosages))
                            rows, dosages = [], []
                        if f is not None:
                            f.close()
                        path, head, f = r["file"], bgen_header(r["file"]), genotype._open(r["file"])
                        if f.size() != r["bytes"]:
                            raise ValueError(f"{path} has changed since it was indexed")
                    f.seek(r["at"])
                    rows.append(tuple(r[c] for c in _NAMES[:7]))
                    dosages.append(decode_block(f.read(r["length"]), head))
                yield genotype._batch(rows, np.stack(dosages))
    finally:
        if f is not None:
            f.close()


def read_indexed(spark: SparkSession, index: str, region: tuple[str, int | None, int | None] | None = None, include: DataFrame | None = None, key: str = "rsid") -> DataFrame:
    """Genotype rows of an index, of those in ``region`` (chr, first pos, last pos; None: open) and in ``include`` (a column ``key``)."""
    rows = read_index(spark, index)
    if region is not None:
        chromosome, first, last = region
        rows = rows.filter(F.col("chr") == chromosome)
        rows = rows if first is None else rows.filter(F.col("pos") >= first)
        rows = rows if last is None else rows.filter(F.col("pos") <= last)
    if include is not None:
        rows = rows.join(include.select(key), key, "left_semi")
    # index rows are small whatever their blocks are, so the blocks' bytes decide on the tasks
    size = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(8, -(-size // RANGE_BYTES))
    return rows.select(*_NAMES).repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").mapInArrow(read_blocks, SCHEMA)
