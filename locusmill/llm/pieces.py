"""Offset-preserving SentencePiece encoding and decoding (operator 5).

Texts are normalised here: at each place the longest prefix found in the model's compiled
character map (a double-array trie) is replaced, and every normalised byte keeps the place
of its source byte. The normalised text is cut before each run of word marks; no piece of
the vocabulary crosses such a cut (checked when the model is loaded), so merges on either
side are independent and each distinct stretch of a chunk is segmented only once, by the
sentencepiece library with its own normaliser switched off. Piece lengths and the
alignment give the source span of every piece.

Output columns: ``n_tokens``, ``ids``, ``starts`` and ``ends`` (little-endian unsigned
32-bit integers, one for each id; spans are UTF-8 byte offsets into the source text, empty
at its ends for the begin and end ids) and ``decoded``.

Defined cases: null counts as empty, which has the begin and end ids only and decodes to
the empty text; repeated rows are encoded alike; an empty table gives an empty result;
other columns pass through, and columns that clash with the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textbatch import span_hashes, text_column

CHUNK_BYTES = 1 << 20
MARK = "▁".encode()


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, whole encoding) of a protocol buffer message's fields."""
    i = 0
    while i < len(b):
        at = i
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value, b[at:i]


class CharacterMap:
    """The compiled map: byte strings to replacements, found by longest prefix."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = [int(x) for x in np.frombuffer(blob, "<u4", size // 4, 4)] if size else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest mapped prefix of text[at:]."""
        if not self.units:
            return None
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf = (units[node] >> 8) & 1
            node ^= offset(units[node])
            if leaf:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.texts[start : self.texts.index(b"\0", start)], found[1]


def _char_length(text: bytes, at: int) -> int:
    lead = text[at]
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@dataclass
class Normaliser:
    chars: CharacterMap
    dummy_prefix: bool = True
    squeeze: bool = True  # drop spaces at the ends and all but one between words
    escape: bool = True  # write spaces as word marks

    def one(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the source byte."""
        space = MARK if self.escape else b" "
        step = lambda at: self.chars.longest(text, at) or (text[at : at + _char_length(text, at)], _char_length(text, at))
        at = 0
        while self.squeeze and at < len(text):
            new, n = step(at)
            if new != b" ":
                break
            at += n
        if at >= len(text):
            return b"", np.zeros(1, np.int64)
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += space
            source += [at] * len(space)
        after_space = self.squeeze
        while at < len(text):
            new, n = step(at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", space)
                out += new
                source += [at] * len(new)
            at += n
        end = at
        while self.squeeze and out.endswith(space):
            end = source[-len(space)]
            del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, end], np.int64)

    def many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, their text offsets, and the source byte (in data) of each normalised byte."""
        if self.chars.units or self.squeeze or not (self.escape and self.dummy_prefix):
            return self._each(data, offsets)
        # without a map only spaces change: three bytes for one, and a mark before each text
        index = np.int32 if len(data) < 1 << 28 else np.int64
        width = np.ones(len(data), np.int8)
        is_space = data == 32
        width[is_space] = 3
        lead = offsets[:-1][offsets[1:] > offsets[:-1]]
        width[lead] += 3
        place = np.zeros(len(data) + 1, index)
        np.cumsum(width, out=place[1:])
        source = np.repeat(np.arange(len(data), dtype=index), width)
        out = data[source]
        for starts in (place[lead], (place[1:] - 3)[is_space]):
            for i, byte in enumerate(MARK):
                out[starts + i] = byte
        return out, place[offsets].astype(np.int64), source

    def _each(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts, sources = [], []
        for a, b in zip(offsets, offsets[1:]):
            text, source = self.one(data[a:b].tobytes())
            texts.append(text)
            sources.append(source[:-1] + a)
        ends = np.cumsum([0, *map(len, texts)])
        return np.frombuffer(b"".join(texts), np.uint8), ends, np.concatenate([np.zeros(0, np.int64), *sources])


@dataclass(frozen=True)
class PieceModel:
    """A SentencePiece model of BPE kind with byte fallback, by its serialised bytes."""

    raw: bytes

    def __hash__(self) -> int:
        return hash(len(self.raw))

    @cached_property
    def normaliser(self) -> Normaliser:
        spec = {n: v for n, v, _ in _fields(next((v for n, v, _ in _fields(self.raw) if n == 3), b""))}
        return Normaliser(CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    @cached_property
    def plain(self) -> sentencepiece.SentencePieceProcessor:
        """The same pieces behind a normaliser that changes nothing."""
        spec = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"
        kept = b"".join(whole for n, _, whole in _fields(self.raw) if n != 3)
        return sentencepiece.SentencePieceProcessor(model_proto=kept + b"\x1a" + bytes([len(spec)]) + spec)

    @cached_property
    def full(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.raw)

    @cached_property
    def lengths(self) -> np.ndarray:
        """Normalised bytes of each piece."""
        pieces = [self.full.id_to_piece(i) for i in range(self.full.vocab_size())]
        if not any(self.full.is_byte(i) for i in range(len(pieces))):
            raise ValueError("the model must have byte fallback")
        if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not (self.full.is_control(i) or self.full.is_unknown(i))):
            raise ValueError("a piece of this model crosses a word mark")
        return np.array([1 if self.full.is_byte(i) else 0 if self.full.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, start and end (source bytes in data) of all texts, and the texts' bounds in them."""
        text, ends, source = self.normaliser.many(data, offsets)
        if not len(text):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint32), none, none, np.zeros(len(offsets), np.int64)
        mark = np.zeros(len(text) + 3, bool)
        mark[: len(text) - 2] = (text[:-2] == MARK[0]) & (text[1:-1] == MARK[1]) & (text[2:] == MARK[2])
        follows = np.zeros(len(text), bool)
        follows[3:] = mark[: max(0, len(text) - 3)]
        cut = mark[: len(text)] & ~follows
        cut[ends[:-1][ends[1:] > ends[:-1]]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(text))
        _, first, which = np.unique(span_hashes(text, starts, stops), return_index=True, return_inverse=True)
        raw = text.tobytes()
        found = self.plain.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), stops[first].tolist())], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        total = np.cumsum(n)
        ids = flat[np.repeat(begin[which] - (total - n), n) + np.arange(int(n.sum()))]
        after = np.cumsum(self.lengths[ids])
        before = after - self.lengths[ids]
        bounds = np.append(0, total)[np.searchsorted(starts, ends)]
        align = np.append(source, source.dtype.type(len(data)))
        # the end of a text's last piece is the end of its source, not the start of the next text's
        stop = align[after]
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        stop = np.where(after == ends[text_of + 1], offsets[text_of + 1], stop)
        return ids.astype(np.uint32), align[before], stop, bounds


@lru_cache(maxsize=4)
def _loaded(raw: bytes) -> PieceModel:
    return PieceModel(raw)


_OUT = "n_tokens long, ids binary, starts binary, ends binary, decoded string"


def encode_documents(docs: DataFrame, model_bytes: bytes, text: str = "text") -> DataFrame:
    """docs with column ``pieces``: the outputs for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes)
    own = docs.drop("pieces")
    place = own.columns.index(text)
    names = [x.split()[0] for x in _OUT.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        bos, eos = model.full.bos_id(), model.full.eos_id()
        for batch in batches:
            data, offsets = text_column(batch.column(place))
            i, n = 0, len(offsets) - 1
            # a batch leaves in chunks, so that a task holds the outputs of one chunk only
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
                starts_of = offsets[i : j + 1] - offsets[i]
                ids, start, stop, bounds = model.encode_chunk(data[offsets[i] : offsets[j]], starts_of)
                out: list[list] = [[], [], [], [], []]
                for k in range(j - i):
                    a, b, base, size = bounds[k], bounds[k + 1], starts_of[k], starts_of[k + 1] - starts_of[k]
                    full = np.concatenate([[bos], ids[a:b], [eos]]).astype("<u4")
                    out[0].append(len(full))
                    out[1].append(full.tobytes())
                    out[2].append(np.concatenate([[0], start[a:b] - base, [size]]).astype("<u4").tobytes())
                    out[3].append(np.concatenate([[0], stop[a:b] - base, [size]]).astype("<u4").tobytes())
                    out[4].append(model.full.decode(full.tolist()))
                arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.StructArray.from_arrays(arrays, names)], [*batch.schema.names, "pieces"])
                i = j

    kind = StructType.fromDDL(f"pieces struct<{_OUT.replace(', ', ',').replace(' ', ':')}>")
    return own.mapInArrow(encode, StructType([*own.schema.fields, *kind.fields]))


def model_bytes(path: str | None = None) -> bytes:
    """The model file at ``path``; by default the public 32k BPE model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op5_offset_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    p = encode_documents(docs, model_bytes(path)).select("doc_id", "pieces")
    return p.select(
        "doc_id",
        F.col("pieces.n_tokens").alias("n_tokens"),
        F.sha2(F.col("pieces.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("pieces.starts", "pieces.ends"), 256).alias("spans_sha256"),
    )
