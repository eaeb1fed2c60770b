"""Spark data sources for packed (BED) and probabilistic (BGEN) genotype files.

Partitions are ranges of variants; a task reads only its own bytes and yields Arrow batches
with one row for each variant: its metadata and the dosages in sample order (null: missing).

A path is one file, or a folder that ``df.write.format("bed" or "bgen")`` made: a task writes
a file for every Arrow batch it gets, and the list of the files of the tasks that Spark
accepted, ``committed.tsv``, is written at the end, so a task that was run again leaves no
double rows. Files are ordered by their first ``variant_idx``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "variant_idx long, snpid string, rsid string, chr string, pos long, non_effect string, effect string, dosage array<float>"
_FIELDS = ["variant_idx", "snpid", "rsid", "chr", "pos", "non_effect", "effect", "dosage"]
BATCH = 256
RANGE_BYTES = 1 << 26
COMMITTED = "committed.tsv"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, at = _at(path)
    return system.open_input_file(at)


def _create(path: str):
    system, at = _at(path)
    return system.open_output_stream(at)


def _is_folder(path: str) -> bool:
    system, at = _at(path)
    return system.get_file_info(at).type == fs.FileType.Directory


def _lines(path: str) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line) of the lines of a file that aren't blank, read in blocks."""
    at, rest = 0, b""
    with _open(path) as f:
        while block := f.read(1 << 22):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if line.strip():
                    yield at, line
                at += len(line) + 1
    if rest.strip():
        yield at, rest


def _text_from(path: str, offset: int, rows: int) -> Iterator[list[str]]:
    """Fields of the next ``rows`` lines that aren't blank."""
    rest = b""
    with _open(path) as f:
        f.seek(offset)
        while rows:
            block = f.read(1 << 20)
            *whole, rest = (rest + block).split(b"\n") if block else (rest, b"")
            for line in whole[:]:
                if rows and line.strip():
                    rows -= 1
                    yield line.decode().split()
            if not block:
                return


def _files(path: str) -> list[str]:
    """The genotype files of a path: itself, or those a written folder lists."""
    if not _is_folder(path):
        return [path]
    return [f"{path.rstrip('/')}/{line.decode().split()[1]}" for _, line in _lines(f"{path.rstrip('/')}/{COMMITTED}")]


def _step(variants: int, size: int, wanted: str | None) -> int:
    """Variants in a range: of ``wanted`` ranges, or of about RANGE_BYTES, but 8 ranges at least."""
    ranges = int(wanted) if wanted else max(8, -(-size // RANGE_BYTES))
    return max(1, -(-variants // max(1, ranges)))


def _batch(rows: list[tuple], dosage: np.ndarray) -> pa.RecordBatch:
    """rows: metadata; dosage: (variants, samples), NaN for missing."""
    flat = pa.array(dosage.ravel(), pa.float32(), mask=np.isnan(dosage).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dosage.shape[1], pa.int32()), flat)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([*(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), lists], _FIELDS)


@dataclass
class VariantRange(InputPartition):
    """Variants ``start`` to ``end`` of a file, whose first one is number ``before`` of the whole path."""

    path: str
    start: int
    end: int
    before: int = 0
    samples: int = 0
    offset: int = 0

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.end))


#: Dosage of the first allele for the four pairs of bits of each byte.
_CODES = np.array([[(2.0, np.nan, 1.0, 0.0)[(b >> 2 * k) & 3] for k in range(4)] for b in range(256)], np.float32)


class BedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.wanted = options["path"], options.get("partitions")

    def partitions(self) -> list[InputPartition]:
        """The driver counts the lines of the companion files; the tasks read their own lines of the .bim only."""
        out, before = [], 0
        for path in _files(self.path):
            stem = path.removesuffix(".bed")
            with _open(path) as f:
                if f.read(3) != b"\x6c\x1b\x01":
                    raise ValueError(f"{path} is no variant-major BED file")
                size = f.size()
            n = sum(1 for _ in _lines(stem + ".fam"))
            width = -(-n // 4)
            m, rest = divmod(size - 3, width) if n else (0, 0)
            if not n or not m:
                raise ValueError("no samples or no variants")
            step, starts, lines = _step(m, size, self.wanted), [], 0
            for at, _ in _lines(stem + ".bim"):
                if lines % step == 0:
                    starts.append(at)
                lines += 1
            if rest or lines != m:
                raise ValueError(f"{path} has not {lines} variants of {n} samples")
            out += [VariantRange(path, i, min(m, i + step), before, n, at) for i, at in zip(range(0, m, step), starts)]
            before += m
        return out or [VariantRange(self.path, 0, 0)]

    def read(self, partition: VariantRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        n = partition.samples
        width = -(-n // 4)
        bim = _text_from(partition.path.removesuffix(".bed") + ".bim", partition.offset, partition.end - partition.start)
        with _open(partition.path) as f:
            f.seek(3 + partition.start * width)
            for i in range(partition.start, partition.end, BATCH):
                j = min(i + BATCH, partition.end)
                raw = np.frombuffer(f.read((j - i) * width), np.uint8).reshape(j - i, width)
                dosage = _CODES[raw].reshape(j - i, width * 4)[:, :n]
                # the first allele of the companion file is the one counted
                yield _batch([(partition.before + k, b[1], b[1], b[0], int(b[3]), b[5], b[4]) for k, b in zip(range(i, j), bim)], dosage)


class GenotypeWriter(DataSourceArrowWriter):
    """One file for each Arrow batch of (variant_idx, rsid, chr, pos, non_effect, effect, dosage)."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def put(self, name: str, rows: list[dict], dosage: np.ndarray) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        files = []
        for batch in iterator:
            if not batch.num_rows:
                continue
            lists = batch.column("dosage")
            sizes = np.diff(lists.offsets.to_numpy())
            if lists.null_count or sizes.min() != sizes.max() or not sizes.max():
                raise ValueError("every variant needs the dosages of the same samples")
            dosage = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            rows = batch.drop_columns(["dosage"]).to_pylist()
            name = uuid.uuid4().hex
            self.put(f"{self.path}/{name}", rows, dosage)
            files.append((rows[0]["variant_idx"], f"{name}.{self.kind}"))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        if not self.overwrite and _at(self.path)[0].get_file_info(f"{_at(self.path)[1]}/{COMMITTED}").type != fs.FileType.NotFound:
            old = [line.decode().split() for _, line in _lines(f"{self.path}/{COMMITTED}")]
            files = sorted([*files, *((int(i), name) for i, name in old)])
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        with _create(f"{self.path}/{COMMITTED}") as f:
            f.write("".join(f"{i}\t{name}\n" for i, name in files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing: files that no list names are not read."""


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class BedWriter(GenotypeWriter):
    """Whole dosages; samples are named by their place, as the rows carry no ids."""

    kind = "bed"

    def put(self, name: str, rows: list[dict], dosage: np.ndarray) -> None:
        missing = np.isnan(dosage)
        whole = np.where(missing, 0, dosage).astype(np.int64)
        if (np.where(missing, 0, dosage) != whole).any() or whole.min() < 0 or whole.max() > 2:
            raise ValueError("BED files hold dosages 0, 1 and 2 only")
        n = dosage.shape[1]
        code = np.zeros((len(rows), -(-n // 4) * 4), np.uint8)
        code[:, :n] = np.where(missing, 1, np.array([3, 2, 0])[whole])
        quads = code.reshape(len(rows), -1, 4)
        with _create(f"{name}.bed") as f:
            f.write(b"\x6c\x1b\x01")
            f.write((quads[..., 0] | quads[..., 1] << 2 | quads[..., 2] << 4 | quads[..., 3] << 6).tobytes())
        with _create(f"{name}.bim") as f:
            for r in rows:
                fields = [str(r[c]) for c in ("chr", "rsid", "pos", "effect", "non_effect")]
                if any(len(x.split()) != 1 for x in fields):
                    raise ValueError(f"{fields[1]!r}: empty fields and white space can't stand in a .bim file")
                f.write(f"{fields[0]}\t{fields[1]}\t0\t{fields[2]}\t{fields[3]}\t{fields[4]}\n".encode())
        with _create(f"{name}.fam") as f:
            f.write("".join(f"0 {i} 0 0 0 -9\n" for i in range(n)).encode())


class BgenWriter(GenotypeWriter):
    """Layout 2, zlib, 16 bits a probability, no sample ids; dosages between 0 and 2."""

    kind = "bgen"

    def put(self, name: str, rows: list[dict], dosage: np.ndarray) -> None:
        text = lambda x, size: struct.pack(size, len(x.encode())) + x.encode()
        n = dosage.shape[1]
        missing = np.isnan(dosage)
        d = np.where(missing, 0, dosage)
        if d.min() < 0 or d.max() > 2:
            raise ValueError("BGEN files hold dosages from 0 to 2 only")
        # the two most certain genotypes that give the dosage
        both = np.stack([np.maximum(1 - d, 0), np.where(d <= 1, d, 2 - d)], axis=2)
        values = np.where(missing[:, :, None], 0, np.rint(both * 65535)).astype("<u2")
        with _create(f"{name}.bgen") as f:
            f.write(struct.pack("<4I", 20, 20, len(rows), n) + b"bgen" + struct.pack("<I", 1 | 2 << 2))
            for r, gone, v in zip(rows, missing, values):
                block = struct.pack("<IHBB", n, 2, 2, 2) + np.where(gone, 0x82, 2).astype(np.uint8).tobytes() + bytes([0, 16]) + v.tobytes()
                packed = zlib.compress(block)
                f.write(text(r["rsid"], "<H") * 2 + text(r["chr"], "<H") + struct.pack("<IH", r["pos"], 2) + text(r["non_effect"], "<I") + text(r["effect"], "<I"))
                f.write(struct.pack("<2I", len(packed) + 4, len(block)) + packed)


class BedSource(DataSource):
    """``spark.read.format("bed").load("x.bed")``, with x.bim and x.fam beside it."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BedWriter(self.options, overwrite)


@dataclass(frozen=True)
class BgenHeader:
    first: int  # byte of the first variant
    variants: int
    samples: int
    compression: int  # 0 none, 1 zlib, 2 zstd
    layout: int
    ids: tuple[str, ...]


def bgen_header(path: str) -> BgenHeader:
    with _open(path) as f:
        offset, length, m, n = struct.unpack("<4I", f.read(16))
        magic = f.read(4)
        if magic not in (b"bgen", b"\0\0\0\0"):
            raise ValueError(f"{path} is no BGEN file")
        f.seek(4 + length - 4)
        flags = struct.unpack("<I", f.read(4))[0]
        compression, layout = flags & 3, (flags >> 2) & 15
        if compression == 3 or layout not in (1, 2) or (layout == 1 and compression == 2):
            raise ValueError("unsupported BGEN compression or layout")
        ids = []
        if flags >> 31:
            _, count = struct.unpack("<2I", f.read(8))
            for _ in range(count):
                ids.append(f.read(struct.unpack("<H", f.read(2))[0]).decode())
            if count != n:
                raise ValueError("sample block and header disagree")
    return BgenHeader(4 + offset, m, n, compression, layout, tuple(ids))


def _string(f, size: str) -> str:
    return f.read(struct.unpack(size, f.read(struct.calcsize(size)))[0]).decode()


def _variant(f, h: BgenHeader) -> tuple[tuple, int]:
    """Metadata of the variant at the file's place, and the size of its probability block; the file then stands at the block."""
    if h.layout == 1:
        f.read(4)
    snpid, rsid, chromosome = (_string(f, "<H") for _ in range(3))
    pos = struct.unpack("<I", f.read(4))[0]
    alleles = 2
    if h.layout == 2:
        alleles = struct.unpack("<H", f.read(2))[0]
    if alleles != 2:
        raise ValueError("only variants with two alleles are supported")
    first, second = _string(f, "<I"), _string(f, "<I")
    size = 6 * h.samples if h.layout == 1 and not h.compression else struct.unpack("<I", f.read(4))[0]
    return (snpid or "NA", rsid or "NA", chromosome or "NA", pos, first, second), size


def unpack_bits(raw: bytes, bits: int) -> np.ndarray:
    """Little-endian unsigned values of 8, 16, 24 or 32 bits."""
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.uint32)
        return b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    if bits not in (8, 16, 32):
        raise ValueError("probabilities of 8, 16, 24 or 32 bits are supported")
    return np.frombuffer(raw, f"<u{bits // 8}")


def decode_block(block: bytes, h: BgenHeader) -> np.ndarray:
    """Dosages of the second allele; NaN for missing."""
    if h.layout == 1:
        raw = zlib.decompress(block) if h.compression else block
        p = np.frombuffer(raw, "<u2").reshape(-1, 3).astype(np.float64)
        total = p.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            # probabilities of first-first, first-second and second-second
            return np.where(total > 0, (p[:, 1] + 2 * p[:, 2]) / total, np.nan).astype(np.float32)
    if h.compression:
        size = struct.unpack("<I", block[:4])[0]
        if h.compression == 1:
            block = zlib.decompress(block[4:])
        else:
            import zstandard

            block = zstandard.ZstdDecompressor().decompress(block[4:], max_output_size=size)
    n, alleles, low, high = struct.unpack("<IHBB", block[:8])
    if n != h.samples or alleles != 2 or (low, high) != (2, 2):
        raise ValueError("a block of other than diploid samples with two alleles")
    missing = np.frombuffer(block, np.uint8, n, 8) >> 7 == 1
    phased, bits = block[8 + n], block[9 + n]
    if phased > 1:
        raise ValueError("a phase flag other than 0 or 1")
    v = unpack_bits(block[10 + n : 10 + n + 2 * n * bits // 8], bits).reshape(-1, 2).astype(np.float64) / (2**bits - 1)
    dosage = 2 - v.sum(axis=1) if phased else v[:, 1] + 2 * (1 - v[:, 0] - v[:, 1])
    return np.where(missing, np.nan, dosage).astype(np.float32)


class BgenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.wanted = options["path"], options.get("partitions")

    def partitions(self) -> list[InputPartition]:
        """One pass over the variant headers finds where each range starts; blocks are skipped."""
        out, before = [], 0
        for path in _files(self.path):
            h = bgen_header(path)
            with _open(path) as f:
                step = _step(h.variants, f.size(), self.wanted)
                if h.variants <= step:
                    out.append(VariantRange(path, 0, h.variants, before, h.samples, h.first))
                else:
                    f.seek(h.first)
                    for i in range(h.variants):
                        if i % step == 0:
                            out.append(VariantRange(path, i, min(h.variants, i + step), before, h.samples, f.tell()))
                        _, size = _variant(f, h)
                        f.seek(f.tell() + size)
            before += h.variants
        return out or [VariantRange(self.path, 0, 0)]

    def read(self, partition: VariantRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        h = bgen_header(partition.path)
        with _open(partition.path) as f:
            f.seek(partition.offset)
            for i in range(partition.start, partition.end, BATCH):
                rows, dosages = [], []
                for k in range(i, min(i + BATCH, partition.end)):
                    meta, size = _variant(f, h)
                    rows.append((partition.before + k, *meta))
                    dosages.append(decode_block(f.read(size), h))
                yield _batch(rows, np.stack(dosages))


class BgenSource(DataSource):
    """``spark.read.format("bgen").load("x.bgen")``."""

    @classmethod
    def name(cls) -> str:
        return "bgen"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BgenReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BgenWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(BedSource)
    spark.dataSource.register(BgenSource)


def genotypes(spark, path: str, partitions: int | None = None):
    """A genotype file, or a folder of written ones, by its extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("bed", "bgen"):
        raise ValueError(f"genotype files of kind {kind} are not supported")
    register(spark)
    reader = spark.read.format(kind)
    return (reader.option("partitions", partitions) if partitions else reader).load(path)


def write_genotypes(geno, path: str) -> None:
    """Rows (variant_idx, rsid, chr, pos, non_effect, effect, dosage) as a folder <path>, by its extension, in the order of variant_idx."""
    register(geno.sparkSession)
    columns = ["variant_idx", "rsid", "chr", "pos", "non_effect", "effect", "dosage"]
    rows = geno.select(*columns).repartitionByRange("variant_idx").sortWithinPartitions("variant_idx")
    rows.write.format(path.rstrip("/").rsplit(".", 1)[-1].lower()).mode("append").save(path)


def gather(geno, at: np.ndarray):
    """Dosages in another order: place i takes the file's sample at[i], or is missing where that is -1."""
    shared = geno.sparkSession.sparkContext.broadcast(np.asarray(at, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("dosage").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.where(at >= 0, own[:, at], np.float32(np.nan))
            flat = pa.array(out.ravel(), pa.float32(), mask=np.isnan(out).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(at), pa.int32()), flat)
            names = batch.schema.names
            yield pa.record_batch([lists if c == "dosage" else batch.column(c) for c in names], names)

    return geno.mapInArrow(run, geno.schema)
