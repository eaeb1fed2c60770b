"""Byte-level BPE encoding and decoding through a table of distinct words (operator 12).

Texts are split into words in the tasks. A block of texts keeps each of its words once and a
number for every place. The blocks' words meet by one shuffle on the word, packed, where each
distinct word of the corpus is encoded once; its ids go back to the blocks that hold it and are laid out
by the numbers of the places. Ids are decoded through the vocabulary's table of pieces by id. A
frequent word is shuffled once a block, never once an occurrence. Blocks are written in buckets, so
their places stay where they were written and only words and ids are shuffled.

Output: the other columns and ``bpe``, a struct of n_tokens, ids and decoded.

Words are split by the tokenizer's usual pattern where every character has the class there that
the library gives it, which is asked once for each character met; other texts are split by the
library's own pre-tokenizer. Added tokens are cut out of a text first, the longest at each place.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded alike; an empty table gives an empty result; columns of any name are kept, an own column
``bpe`` is replaced. Any length of text or word is encoded whole. Truncation and padding of the
file are unused. A tokenizer of another kind (a normaliser, a prefix space, words split
otherwise, added tokens that strip) is an error.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from tokenizers import Tokenizer

from ..operators.shared import materialise, materialise_by
from .textbatch import span_hashes, text_column

BLOCK_CHARS = 8 << 20
PART_TOKENS = 1 << 18
TABLE_WORDS = 1 << 19
#: The pattern of byte-level BPE: fixed, as words must be the library's.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CLASSES = [("A", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")), ("#", regex.compile(r"[^\s\p{L}\p{N}]"))]


@dataclass(frozen=True)
class ByteBpe:
    """A byte-level BPE tokenizer, by its JSON text."""

    raw: str
    classes: dict[str, bool] = field(default_factory=dict, compare=False)

    @cached_property
    def library(self) -> Tokenizer:
        spec = json.loads(self.raw)
        split = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("the tokenizer must be a byte-level BPE without normaliser and prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or need a word of their own are left out")
        t = Tokenizer.from_str(self.raw)
        t.no_truncation()
        t.no_padding()
        return t

    @cached_property
    def added(self) -> regex.Pattern | None:
        every = sorted((t["content"] for t in json.loads(self.raw).get("added_tokens") or []), key=len, reverse=True)
        return regex.compile(f"({'|'.join(map(regex.escape, every))})") if every else None

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(WORDS)

    def agrees(self, c: str) -> bool:
        """Whether the pattern gives a character the library's class."""
        if c not in self.classes:
            split = self.library.pre_tokenizer.pre_tokenize_str
            self.classes[c] = all((len(split(beside + c + beside)) == 1) == bool(p.match(c)) for beside, p in _CLASSES)
        return self.classes[c]

    def words(self, text: str, plain: bool = True) -> list[str]:
        """The words of a text in order; together they are the text. plain: by the pattern."""
        parts = self.added.split(text) if self.added else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part:
                out += self.pattern.findall(part) if plain else [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def vocabulary(self) -> list[tuple[int, bytes]]:
        """(id, bytes) of every token: the visible letters of byte-level BPE back to bytes."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        tokens = self.library.get_vocab(with_added_tokens=True)
        return [(i, bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()) for t, i in tokens.items()]


    @cached_property
    def pieces(self) -> pa.Array:
        """The vocabulary's bytes by id."""
        known = dict(self.vocabulary())
        return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())


@lru_cache(maxsize=4)
def _loaded(raw: str) -> ByteBpe:
    return ByteBpe(raw)


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, byte plane by byte plane, compressed."""
    return zlib.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(cell: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(cell), np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of ``counts`` places, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(counts.sum()))


def blocks_of(docs: DataFrame, tokenizer: str, text: str, parts: int) -> DataFrame:
    """Written blocks of texts.

    ``rows`` holds the other columns, ``sizes`` the words of each text, ``places`` the rank of
    every word by frequency. The distinct words are dealt to ``parts`` by a hash and sorted in
    each: ``words`` (part, sizes, text), with their ``ranks`` in that order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    own = [c for c in docs.columns if c not in (text, "bpe")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        held: list[tuple[pa.Array, list[int], pa.Array]] = []
        held_chars = 0

        def block() -> pa.RecordBatch:
            rows, sizes = pa.concat_arrays([h[0] for h in held]), [n for h in held for n in h[1]]
            coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
            held.clear()
            data, offsets = text_column(coded.dictionary)
            part = (span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(parts)).astype(np.int32)
            order = pc.sort_indices(pa.table({"p": part, "w": coded.dictionary}), [("p", "ascending"), ("w", "ascending")])
            # places count by frequency, so that they compress
            places = coded.indices.to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[np.argsort(-np.bincount(places, minlength=len(order)), kind="stable")] = np.arange(len(order))
            part, data, offsets = part[order.to_numpy()], *text_column(coded.dictionary.take(order))
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            words = [{"part": int(part[i]), "sizes": pack(np.diff(offsets[i : j + 1])), "text": zlib.compress(data[offsets[i] : offsets[j]].tobytes(), 1)} for i, j in zip(cuts, cuts[1:])]
            one = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([one, pa.array([sizes], pa.list_(pa.int32())), pa.array([words], _WORDS), pa.array([pack(rank[order.to_numpy()])], pa.binary()), pa.array([pack(rank[places])], pa.binary())], ["rows", "sizes", "words", "ranks", "places"])

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
            odd = [c for c in set().union(*texts) if not c.isascii() and not bpe.agrees(c)]
            first, sizes, words = 0, [], []
            for i, t in enumerate(texts):
                found = bpe.words(t, not any(c in t for c in odd))
                sizes.append(len(found))
                words.append(pa.array(found, pa.string()))
                held_chars += len(t)
                if held_chars >= BLOCK_CHARS or i + 1 == len(texts):
                    held.append((batch.column(1).slice(first, i + 1 - first), sizes, pa.concat_arrays(words)))
                    first, sizes, words = i + 1, [], []
                if held_chars >= BLOCK_CHARS:
                    held_chars = 0
                    yield block()
        if held:
            yield block()

    packed = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in own] or [F.lit(0).alias("_")]).alias("rows"))
    rest = StructType.fromDDL("sizes array<int>, words array<struct<part:int,sizes:binary,text:binary>>, ranks binary, places binary")
    kind = StructType([StructField("rows", ArrayType(packed.schema["rows"].dataType)), *rest.fields])
    # in buckets of the block, where its words' ids will come back to: the places, most of the bytes, are never shuffled
    return materialise_by(packed.mapInArrow(run, kind).withColumn("block", F.monotonically_increasing_id()), "bpe_blocks", "block", parts)


_WORDS = pa.list_(pa.struct([("part", pa.int32()), ("sizes", pa.binary()), ("text", pa.binary())]))


def encode_words(blocks: DataFrame, tokenizer: str, parts: int) -> DataFrame:
    """(block, part, lengths, ids): the ids of the blocks' words, in the order of their numbers.

    All of a word's occurrences in blocks meet in one partition, whose table of distinct words
    is encoded once; a table that grows beyond ``TABLE_WORDS`` words is begun anew.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = _loaded(shared.value).library
        table: dict[bytes, list[int]] = {}
        for batch in batches:
            for block, part, sizes, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw, ends = zlib.decompress(text), np.cumsum(unpack(sizes)).tolist()
                words = [raw[i:j] for i, j in zip([0, *ends], ends)]
                if len(table) > TABLE_WORDS:
                    table.clear()
                new = [w for w in words if w not in table]
                table.update(zip(new, (e.ids for e in library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False))))
                found = [table[w] for w in words]
                length = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.int64, int(length.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), pa.array([pack(length)], pa.binary()), pa.array([pack(flat)], pa.binary())], ["block", "part", "lengths", "ids"])

    return blocks.select("block", F.inline("words")).repartition(parts, "part").mapInArrow(run, "block long, part int, lengths binary, ids binary")


def id_bytes(rows: DataFrame, key: str, ids: str, tokenizer: str) -> DataFrame:
    """(key, bytes): every id's bytes by a join with the vocabulary, in order. Keys are distinct; an unknown id has no bytes.

    The vocabulary is the broadcast side: a tokenizer's file bounds it, whatever the corpus.
    """
    pieces = rows.sparkSession.createDataFrame(_loaded(tokenizer).vocabulary(), "id int, piece binary")
    each = rows.select(key, F.posexplode(ids).alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("piece", F.lit(b"")).alias("piece"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["piece"])), ""))
    return each.groupBy(key).agg(joined.alias("bytes"))


def _assemble(tokenizer: Broadcast):
    """Blocks (rows, sizes, places, found) to rows with ids and bytes in the order of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(tokenizer.value).pieces
        for batch in batches:
            for b in range(batch.num_rows):
                sizes = batch.column("sizes")[b].values.to_numpy().astype(np.int64)
                found = sorted(batch.column("found")[b].as_py() or [], key=lambda f: f["part"])
                length, ids = (np.concatenate([np.zeros(0, np.int64), *(unpack(f[c]) for f in found)]) for c in ("lengths", "ids"))
                ranks = unpack(batch.column("ranks")[b].as_py())
                at = np.empty(len(ranks), np.int64)
                at[ranks] = np.arange(len(ranks))
                place = at[unpack(batch.column("places")[b].as_py())]
                counts = length[place]
                ids = ids[spans((np.cumsum(length) - length)[place], counts)]
                ends = np.cumsum(counts)
                bounds = np.append(0, ends)[np.concatenate([[0], np.cumsum(sizes)])]
                # texts leave in parts, so that the ids and pieces of one part are held at a time
                i = 0
                while i < len(sizes):
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PART_TOKENS, "right")) - 1)
                    own, cut = ids[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                    text = pieces.take(pa.array(own))
                    _, offsets, data = text.buffers()
                    byte_at = np.frombuffer(offsets, np.int64)[text.offset + cut].tolist() if len(text) else [0] * len(cut)
                    raw = memoryview(data) if data else b""
                    decoded = pa.array([str(raw[x:y], "utf-8", "replace") for x, y in zip(byte_at, byte_at[1:])], pa.string())
                    out = pa.StructArray.from_arrays([pa.array(np.diff(cut)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(own.astype(np.int32))), decoded], ["n_tokens", "ids", "decoded"])
                    yield pa.RecordBatch.from_arrays([batch.column("rows")[b].values.slice(i, j - i), out], ["rows", "bpe"])
                    i = j

    return run


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The other columns of docs and ``bpe`` for each whole text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks_of(docs, tokenizer, text, parts)
    # a block's words are bounded by its bytes, so its group is too
    found = encode_words(blocks, tokenizer, parts).groupBy("block").agg(F.collect_list(F.struct("part", "lengths", "ids")).alias("found"))
    kind = StructType().add("rows", blocks.schema["rows"].dataType.elementType).add(StructType.fromDDL("bpe struct<n_tokens:bigint,ids:array<int>,decoded:string>")["bpe"])
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    laid = blocks.drop("words").join(found, "block", "left").mapInArrow(_assemble(shared), kind)
    own = [c for c in docs.columns if c not in (text, "bpe")]
    return laid.select(*[F.col(f"rows.`{c}`").alias(c) for c in own], "bpe")


def decode_documents(docs: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """docs with ``decoded``: any ids, by the join with the vocabulary; null ids decode to null."""
    keyed = materialise(docs.drop("decoded").withColumn("_key", F.monotonically_increasing_id()), "bpe-ids")
    found = id_bytes(keyed, "_key", f"`{ids}`", tokenizer).select("_key", F.try_validate_utf8(F.col("bytes").cast("string")).alias("_valid"), F.make_valid_utf8(F.col("bytes").cast("string")).alias("_text"))
    text = F.when(F.col(f"`{ids}`").isNotNull(), F.coalesce("_valid", "_text", F.lit("")))
    return keyed.join(found, "_key", "left").withColumn("decoded", text).drop("_key", "_valid", "_text")


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file at ``path``; by default the public 50k byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op12_word_table(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, tokenizer_text(path))
    return out.select("doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("bpe.ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))
