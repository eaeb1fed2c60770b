"""Phrase collocations counted by broadcast double-array tries (operator 11).

1. A pass hashes all n-grams of one and two words, the next those of three and four, and so on, to
   36 bits. Tasks count their own ones, and their sorted hashes travel as packed differences to
   the slices of the hash's range, which add the counts. What is left is the set of hashes that
   reached ``min_count``, one bit a hash in a bitmap eight times as wide as there are such hashes.
   From the second pass on, only n-grams whose known parts are in the set are counted.
2. One pass gathers the distinct n-grams whose own bit and those of all n-grams inside them are
   set. No n-gram with ``min_count`` occurrences is missed, as an n-gram occurs no more often
   than its parts; collisions only add candidates.
3. The candidates are cut into shards of ``shard`` phrases and each shard becomes a double-array
   trie over its words' numbers. The tries of as many shards as hold ``together`` phrases are
   broadcast as one forest; in the tasks a text position starts at the root of the trie that holds
   its word's phrases, numpy moves the states of all positions one word further at a time, and the
   states that accept are counted by bincount. The sums of all tasks and passes are the exact counts.
4. Scores, nesting and ranks are joins, aggregates and a window over the counted phrases.

The work of step 3 is a pass over a language's texts for each ``together`` of its phrases, so it
doesn't grow with the number of shards inside; a task's memory is bounded by ``together`` (some 30
bytes a phrase, and four for each word and trie of a language) and by the bitmaps, which grow with the number of frequent n-grams (a byte
each, 2^bucket_bits bits at least) and not with that of all n-grams.

Defined cases: null texts have no words, a null language is ``und``; a text without words gives
nothing; repeated rows count each; an empty table gives an empty result; other columns are
ignored. Words and texts of any length are used whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.align import with_row_index
from ..operators.shared import materialise
from .shards import SLICE, held_sums, slice_batch, slices_of
from .textbatch import mix, span_hashes, text_column


@dataclass(frozen=True)
class PhraseParams:
    min_count: int = 30
    most_words: int = 4
    scale: int = 2_000_000
    inside_percent: int = 80  # a phrase goes if a longer one around it has this share of its count
    top: int = 2000
    bucket_bits: int = 24  # bits of the least bitmap of frequent hashes, for each length of n-grams
    shard: int = 1 << 18  # phrases of a trie
    together: int = 1 << 22  # phrases of the tries that one pass over the texts counts

    @property
    def counter(self) -> np.dtype:
        return np.min_scalar_type(self.min_count)


_CLASS = np.zeros(256, np.int8)  # 0: of a word, 1: between words, 2: between pieces
_CLASS[[32, 9]] = 1
_CLASS[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.default_rng(11_029).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_FEW_HASHES = 1 << 20
_FEW_VISITS = 1 << 20
_CELLS = 1 << 16  # counts of a slice
_KEY_BITS, _SLICE_BITS, _COUNT_BITS = 26, 10, 28  # of a hash inside its slice, of its slice, of a count beside both
_HASH_BITS = _KEY_BITS + _SLICE_BITS
_HELD = 1 << 21  # hashes that a task adds up before they travel


@dataclass
class Tokens:
    """The words of a batch's texts of one language: numbers into distinct lower-cased words, and the piece each is in."""

    lang: str
    words: pa.Array
    ids: np.ndarray
    piece: np.ndarray

    def inside(self, k: int) -> np.ndarray:
        """Whether k words from each place on lie in one piece."""
        out = np.zeros(len(self.piece), bool)
        if len(self.piece) >= k:
            out[: len(out) - k + 1] = self.piece[: len(out) - k + 1] == self.piece[k - 1 :]
        return out

    def hashes(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, hashes of the k words from each place on); the last k - 1 places are left out."""
        data, offsets = text_column(self.words.cast(pa.string()))
        salt = np.uint64(int.from_bytes(hashlib.blake2b(self.lang.encode(), digest_size=8).digest(), "little"))
        own = mix(span_hashes(data, offsets[:-1], offsets[1:]) ^ salt)[self.ids]
        total = np.zeros(len(own), np.uint64)
        for k in range(1, most + 1):
            total = total[: max(0, len(own) - k + 1)] + own[k - 1 :] * _ODD[k]
            yield k, mix(total)


def tokens_of(batch: pa.RecordBatch) -> Iterator[Tokens]:
    """The words of (text, lang) batches, language by language."""
    langs = batch.column(1).cast(pa.string()).fill_null("und")
    texts = batch.column(0).cast(pa.string()).fill_null("")
    for lang in pc.unique(langs).to_pylist():
        data, offsets = text_column(texts.filter(pc.equal(langs, lang)))
        data = data[: offsets[-1]]
        kind = _CLASS[data]
        solid = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (edge[:-1] | ~np.append(False, solid[:-1])))
        ends = np.flatnonzero(solid & (edge[1:] | ~np.append(solid[1:], False))) + 1
        if not len(starts):
            continue
        piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int64)[starts]
        packed = _LOWER[data[solid]]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        yield Tokens(lang, found.dictionary, found.indices.to_numpy().astype(np.int64), piece)


def safe_places(t: Tokens, bits: list[np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, whether a safe n-gram starts at each place): in one piece, and its bit and its parts' set where known."""
    safe = None
    for k, h in t.hashes(most):
        now = t.inside(k)
        if safe is not None:
            now &= safe & np.append(safe[1:], False)
        if k <= len(bits):
            at = np.flatnonzero(now)
            bucket = (h[at] >> np.uint64(64 - (len(bits[k - 1]) * 8).bit_length() + 1)).astype(np.int64)
            now[at] = (bits[k - 1][bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1
        safe = now
        yield k, h, now


def added(values: np.ndarray, cap: int) -> np.ndarray:
    """Each hash once with the sum of its counts, at most cap: sorted values hash << 28 | count."""
    values = np.sort(values)
    key = values >> np.uint64(_COUNT_BITS)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(first):
        return values
    n = np.add.reduceat(values & np.uint64((1 << _COUNT_BITS) - 1), first)
    return key[first] << np.uint64(_COUNT_BITS) | np.minimum(n, np.uint64(cap))


def pack_counts(values: np.ndarray, counter: np.dtype) -> Iterator[tuple[int, bytes]]:
    """(slice, packed counts) of ``added`` values: differences of the hashes by byte, high bytes first, then the counts."""
    hashes = values >> np.uint64(_COUNT_BITS)
    key = (hashes & np.uint64((1 << _KEY_BITS) - 1)).astype(np.int64)
    n = (values & np.uint64((1 << _COUNT_BITS) - 1)).astype(counter)
    cuts = np.searchsorted(hashes, np.arange((1 << _SLICE_BITS) + 1, dtype=np.uint64) << np.uint64(_KEY_BITS))
    for i in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[i], cuts[i + 1])
        steps = np.diff(key[own], prepend=0).astype(">u4").view(np.uint8).reshape(-1, 4)
        yield int(i), zlib.compress(steps.T.tobytes() + n[own].tobytes(), 1)


def unpack_counts(cells: bytes, counter: np.dtype) -> np.ndarray:
    """Values hash in the slice << 28 | count of one packed slice."""
    raw = np.frombuffer(zlib.decompress(cells), np.uint8)
    n = len(raw) // (4 + counter.itemsize)
    key = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(">u4").ravel(), dtype=np.uint64)
    return key << np.uint64(_COUNT_BITS) | raw[4 * n :].view(counter).astype(np.uint64)


_TALLY = "slice int, cells binary, lang string, n long"


def tally(docs: DataFrame, p: PhraseParams, full: list[bytes], levels: list[int]) -> DataFrame:
    """Rows (slice, cells) of the hashes of ``levels`` words that reached min_count, and rows (lang, n) of the words of every task.

    ``full``: the bitmaps of all shorter n-grams. A slice is the hash's first 10 bits behind the
    level; its cells are the other 26 bits of the frequent hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(full)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(found: list[tuple[int, bytes]], words: dict[str, int]) -> pa.RecordBatch:
        cells, n = slice_batch(found), len(words)
        totals = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())]
        none = [pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip([*cells.columns, *none], totals)], ["slice", "cells", "lang", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b, np.uint8) for b in shared.value]
        held = {k: np.zeros(0, np.uint64) for k in levels}
        waiting: dict[int, list[np.ndarray]] = {k: [] for k in levels}
        words: dict[str, int] = {}

        def settle(k: int) -> None:
            held[k] = added(np.concatenate([held[k], *waiting[k]]), p.min_count)
            waiting[k].clear()

        def leave(k: int) -> pa.RecordBatch:
            found = [(k << _SLICE_BITS | i, c) for i, c in pack_counts(held[k], p.counter)]
            held[k] = np.zeros(0, np.uint64)
            return rows(found, {})

        for batch in batches:
            for t in tokens_of(batch):
                words[t.lang] = words.get(t.lang, 0) + len(t.ids)
                for k, h, safe in safe_places(t, bits, levels[-1]):
                    if k not in waiting:
                        continue
                    waiting[k].append(h[safe[: len(h)]] >> np.uint64(64 - _HASH_BITS) << np.uint64(_COUNT_BITS) | np.uint64(1))
                    if sum(map(len, waiting[k])) >= _FEW_HASHES:
                        settle(k)
                        if len(held[k]) >= _HELD:
                            yield leave(k)
        for k in levels:
            settle(k)
            yield leave(k)
        yield rows([], words)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def frequent() -> list[tuple[int, bytes]]:
            if now is None:
                return []
            values = added(np.concatenate(parts), p.min_count)
            found = values[values & np.uint64((1 << _COUNT_BITS) - 1) >= p.min_count] >> np.uint64(_COUNT_BITS)
            return [(now, found.astype(np.uint32).tobytes())] if len(found) else []

        for batch in batches:
            found, words = [], {}
            for s, cells, lang, n in zip(*[c.to_pylist() for c in batch.columns]):
                if s is None:
                    words[lang] = words.get(lang, 0) + n
                    continue
                if s != now:
                    found += frequent()
                    now, parts = s, []
                parts.append(unpack_counts(cells, p.counter))
            yield rows(found, words)
        yield rows(frequent(), {})

    # a slice's rows come one after the other, so a task holds one slice at a time
    dealt = docs.mapInArrow(count, _TALLY).repartition(tasks, "slice").sortWithinPartitions("slice")
    return materialise(dealt.mapInArrow(add, _TALLY), "tally")


def full_bits(counted: DataFrame, p: PhraseParams, level: int) -> bytes:
    """The bitmap of the frequent hashes of ``level`` words: a power of two of bits, eight times the hashes or more."""
    own = counted.filter(F.shiftright("slice", _SLICE_BITS) == level)
    n = own.agg(F.sum(F.length("cells")) / 4).first()[0] or 0
    # bytes of a slice are whole
    width = min(_HASH_BITS, max(_SLICE_BITS + 3, p.bucket_bits, int(8 * n).bit_length()))
    out, size = bytearray((1 << width) // 8), 1 << (width - _SLICE_BITS)
    for row in own.select("slice", "cells").toLocalIterator():
        flags = np.zeros(size, bool)
        flags[np.frombuffer(row["cells"], np.uint32) >> np.uint32(_HASH_BITS - width)] = True
        at = (row["slice"] & ((1 << _SLICE_BITS) - 1)) * size // 8
        out[at : at + size // 8] = np.packbits(flags).tobytes()
    return bytes(out)


def frequent_hashes(docs: DataFrame, p: PhraseParams) -> tuple[list[bytes], DataFrame]:
    """The bitmaps of all lengths of n-grams, two lengths a pass, and (lang, n)."""
    full: list[bytes] = []
    totals = None
    while len(full) < p.most_words:
        levels = list(range(len(full) + 1, min(len(full) + 2, p.most_words) + 1))
        counted = tally(docs, p, full, levels)
        totals = totals or counted.filter("slice is null").groupBy("lang").agg(F.sum("n").alias("n"))
        full = [*full, *[full_bits(counted, p, k) for k in levels]]
    return full, totals


def candidates(docs: DataFrame, full: list[bytes], p: PhraseParams) -> DataFrame:
    """Distinct (lang, phrase): n-grams that are safe by their own and all their parts' bits."""
    shared = docs.sparkSession.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b, np.uint8) for b in shared.value]
        for batch in batches:
            for t in tokens_of(batch):
                n, code = len(t.ids), None
                for k, _, now in safe_places(t, bits, p.most_words):
                    at = np.flatnonzero(now)
                    if not len(at):
                        break
                    # an n-gram is its first k - 1 words' number and its last word's: no two share a number
                    key = t.ids[at] if k == 1 else code[at] * len(t.words) + t.ids[at + k - 1]
                    _, first, which = np.unique(key, return_index=True, return_inverse=True)
                    code = np.zeros(n, np.int64)
                    code[at] = which
                    columns = [t.words.take(pa.array(t.ids[at[first] + j])) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if k > 1 else columns[0]
                    yield pa.RecordBatch.from_arrays([pa.array([t.lang] * len(phrase), pa.string()), phrase.cast(pa.string())], ["lang", "phrase"])

    return docs.mapInArrow(run, "lang string, phrase string").distinct()


_FREE = -2


def digits(ids: np.ndarray, side: int) -> np.ndarray:
    """Both digits of each word number."""
    return np.stack([ids // side + 1, ids % side + 1], axis=-1)


def build_trie(phrases: pa.Array) -> dict:
    """A double array over the numbers of the phrases' words, and each state's phrase.

    State 0 is the root. From state s, digit d (from 1 on) leads to base[s] + d, if check there is
    s. A word is two digits of base ``side``, so rows are narrow and pack well.
    """
    parts = pc.split_pattern(phrases.cast(pa.string()), " ")
    flat = parts.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids = flat.indices.to_numpy().astype(np.int64)
    order = np.argsort(-np.bincount(ids, minlength=len(flat.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    words, side = flat.dictionary.take(pa.array(order)), int(np.sqrt(len(order))) + 1
    ids, offsets, width = digits(rank[ids], side).ravel(), 2 * offsets, side + 2
    check = np.full(2 * width, _FREE, np.int64)
    check[0] = -1
    base = np.zeros(len(check), np.int64)
    end = width  # first slot behind all used ones

    def room(size: int) -> None:
        nonlocal check, base
        if size > len(check):
            more = max(size, len(check) * 3 // 2) - len(check)
            check, base = np.append(check, np.full(more, _FREE, np.int64)), np.append(base, np.zeros(more, np.int64))

    depth = np.diff(offsets)
    state = np.zeros(len(depth), np.int64)
    rng = np.random.default_rng(0)
    for level in range(int(depth.max(initial=0))):
        rows = np.flatnonzero(depth > level)
        edges = np.unique(state[rows] * width + ids[offsets[rows] + level])
        parent, child = edges // width, edges % width
        heads, first, degree = np.unique(parent, return_index=True, return_counts=True)
        if level == 0:
            check[child] = 0
        else:
            for turn, i in enumerate(np.argsort(-degree, kind="stable")):
                if degree[i] == 1:
                    break
                c = child[first[i] : first[i] + degree[i]]
                room(end + width)
                if turn % 512 == 0:
                    free = np.flatnonzero(check[:end] == _FREE)
                # rows are displaced to a sample of the free slots, then to the array's end
                tries = free[rng.integers(0, max(len(free), 1), min(len(free), 64))] - c[0]
                tries = tries[tries + c[0] > 0]
                fits = np.flatnonzero((check[np.clip(tries[:, None] + c, 0, len(check) - 1)] == _FREE).all(1) & (tries + c[-1] < len(check))) if len(tries) else tries
                b = int(tries[fits[0]]) if len(fits) else end - int(c[0])
                check[b + c], base[heads[i]] = heads[i], b
                end = max(end, b + int(c[-1]) + 1)
            ones = degree == 1
            single, c = heads[ones], child[first[ones]]
            room(end + len(single))
            slots = np.flatnonzero(check == _FREE)[: len(single)]
            check[slots], base[single] = single, slots - c
            end = max(end, int(slots.max(initial=0)) + 1)
        state[rows] = base[state[rows]] + ids[offsets[rows] + level]
    accept = np.full(end, -1, np.int32)
    accept[state] = np.arange(len(state))
    return {"words": words, "side": side, "base": base[:end].astype(np.int32), "check": check[:end].astype(np.int32), "accept": accept}


_TRIE = "lang string, shard long, first long, side int, words array<string>, base binary, check binary, accept binary"


def tries(numbered: DataFrame) -> DataFrame:
    """Written tries of (row_idx, lang, phrase, shard): one a shard and language; a group is at most a shard."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_idx").combine_chunks()
        t = build_trie(table["phrase"].combine_chunks())
        cell = lambda a: pa.array([a.tobytes()], pa.binary())
        words = pa.ListArray.from_arrays(pa.array([0, len(t["words"])], pa.int32()), t["words"])
        return pa.table([table["lang"].slice(0, 1), table["shard"].slice(0, 1), table["row_idx"].slice(0, 1), pa.array([t["side"]], pa.int32()), words, cell(t["base"]), cell(t["check"]), cell(t["accept"])], names=[x.split()[0] for x in _TRIE.split(", ")])

    return materialise(numbered.groupBy("shard", "lang").applyInArrow(build, _TRIE), "tries")


@dataclass
class Forest:
    """Tries of one pass in one pair of arrays: a trie's states begin at its root, and accept holds a phrase's place among those of the pass."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    langs: dict[str, LangTries]

    def visits(self, own: LangTries, ids: np.ndarray, piece: np.ndarray) -> Iterator[np.ndarray]:
        """The accepting states' phrases that all places reach, a word further at a time. ids: numbers in own.words from 1 on, 0 is no word of the tries."""
        at = np.flatnonzero(own.lo[ids] >= 0)
        which, more = own.lo[ids[at]], own.hi[ids[at]] - own.lo[ids[at]]
        if more.any():
            # phrases of one first word lie in several tries: such a place starts in each
            first = np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            at, which = np.repeat(at, more + 1), np.repeat(which, more + 1) + np.arange(len(first)) - first
        state, depth = own.roots[which], 0
        while len(at):
            number = own.local[which, ids[at + depth]]
            ok = number > 0
            at, which, state, number = at[ok], which[ok], state[ok], number[ok]
            steps = digits(number, own.sides[which])
            for i in range(2):
                to = self.base[state] + steps[:, i]
                to = np.where((to > 0) & (to < len(self.check)), to, 0)
                ok = self.check[to] == state
                at, which, state, steps = at[ok], which[ok], to[ok], steps[ok]
            found = self.accept[state]
            yield found[found >= 0]
            depth += 1
            ok = at + depth < len(ids)
            at, which, state = at[ok], which[ok], state[ok]
            ok = (ids[at + depth] > 0) & (piece[at + depth] == piece[at])
            at, which, state = at[ok], which[ok], state[ok]


@dataclass
class LangTries:
    """The tries of one language: roots, digits' bases, each word's number in each trie, and its first and last trie as a phrase's first word."""

    words: pa.Array
    roots: np.ndarray
    sides: np.ndarray
    local: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def forest(shards: pa.Table) -> Forest:
    """The tries of ``tries``' rows, put together."""
    shards = shards.sort_by("first").combine_chunks()
    base, check, accept, at = [], [], [], 0
    roots: dict[str, list[tuple[int, int, pa.Array]]] = {}
    for lang, first, side, words, *cells in zip(*[shards[c].to_pylist() for c in ("lang", "first", "side")], *[shards[c] for c in ("words", "base", "check", "accept")]):
        b, c, a = (np.frombuffer(x.as_buffer(), np.int32) for x in cells)
        base.append(b + np.int32(at))
        check.append(np.where(c >= 0, c + np.int32(at), c))
        accept.append(np.where(a >= 0, a + np.int32(first - shards["first"][0].as_py()), a))
        roots.setdefault(lang, []).append((at, side, words.values.cast(pa.large_string())))
        at += len(b)
    out = Forest(np.concatenate(base), np.concatenate(check), np.concatenate(accept), {})
    for lang, own in roots.items():
        every = pa.concat_arrays([w for _, _, w in own]).dictionary_encode()
        ids = np.split(every.indices.to_numpy() + 1, np.cumsum([len(w) for _, _, w in own])[:-1])
        n = len(every.dictionary) + 1
        local, lo, hi = np.zeros((len(own), n), np.int32), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for i, (root, side, _) in enumerate(own):
            local[i, ids[i]] = np.arange(1, len(ids[i]) + 1)
            state = np.full(len(ids[i]), root)
            starts = np.ones(len(state), bool)
            for digit in digits(local[i, ids[i]].astype(np.int64), side).T:
                to = np.clip(out.base[state] + digit, 0, len(out.check) - 1)
                starts &= out.check[to] == state
                state = to
            heads = ids[i][starts]
            hi[heads] = i
            lo[heads] = np.where(lo[heads] < 0, i, lo[heads])
        out.langs[lang] = LangTries(every.dictionary, np.array([x for x, _, _ in own]), np.array([x for _, x, _ in own]), local, lo, hi)
    return out


def count_tries(docs: DataFrame, shards: pa.Table) -> DataFrame:
    """(row_idx, f) of the phrases of some shards' tries. The tasks' counts travel as packed slices, not as a row for each task and phrase."""
    built, start = forest(shards), min(shards["first"].to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(built)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(int(known.accept.max()) + 1, np.int64)
        waiting: list[np.ndarray] = []

        def settle() -> None:
            if waiting:
                counts[:] += np.bincount(np.concatenate(waiting), minlength=len(counts))
                waiting.clear()

        for batch in batches:
            for t in tokens_of(batch):
                if own := known.langs.get(t.lang):
                    number = pc.fill_null(pc.index_in(t.words, value_set=own.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                    for found in known.visits(own, number[t.ids], t.piece):
                        waiting.append(found)
                        if sum(map(len, waiting)) >= _FEW_VISITS:
                            settle()
        settle()
        yield slice_batch(list(slices_of(counts, 0, _CELLS)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, f in held_sums(batches, np.dtype(np.int64)).items():
            at = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([pa.array(at + (start + s * _CELLS)), pa.array(f[at])], ["row_idx", "f"])

    parts = docs.filter(F.col("lang").between(min(built.langs), max(built.langs))).mapInArrow(run, SLICE)
    return parts.repartition(tasks, "slice").mapInArrow(add, "row_idx long, f long")


def count_phrases(docs: DataFrame, p: PhraseParams, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to most_words words with min_count occurrences, and (lang, n)."""
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    full, totals = frequent_hashes(docs, p)
    safe = with_row_index(candidates(docs, full, p), ["lang", "phrase"])
    numbered = materialise(safe.withColumn("shard", F.expr(f"row_idx div {p.shard}")), "candidates")
    built = tries(numbered)
    parts = [docs.sparkSession.createDataFrame([], "row_idx long, f long")]
    shards = sorted(r["shard"] for r in built.select("shard").distinct().collect())
    # as many shards' tries in one pass as have ``together`` phrases: their size follows from the parameters
    step = max(1, p.together // p.shard)
    for own in (shards[i : i + step] for i in range(0, len(shards), step)):
        parts.append(materialise(count_tries(docs, built.filter(F.col("shard").between(own[0], own[-1])).toArrow()), "shard-counts"))
    f = reduce(DataFrame.unionByName, parts).filter(F.col("f") >= p.min_count)
    return materialise(numbered.select("row_idx", "lang", "phrase").join(f, "row_idx").drop("row_idx"), "phrases"), totals


def mine_phrases(docs: DataFrame, p: PhraseParams = PhraseParams(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every kept phrase of two words or more."""
    f, totals = count_phrases(docs, p, text, lang)
    split = f.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right")
    )
    side = lambda name, value: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    wide = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr(f"({wide('a')} * {p.scale}) div {wide('l + r')}"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # every phrase of two words or more inside a longer one, with the largest count around it
    spans = split.filter(F.size("w") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    around = spans.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR {wide('longer')} * 100 < {wide('a')} * {p.inside_percent}"))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(mined: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; strings are compared by their UTF-8 bytes."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return mined.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def op11_trie_collocations(spark: SparkSession, sf_dir: str, params: PhraseParams = PhraseParams()) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return top_phrases(mine_phrases(docs, params), params.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) s(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
split AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, f, c, array_to_string(w[1 : c], ' ') AS a1, array_to_string(w[c + 1 : k], ' ') AS a2 FROM (SELECT *, unnest(range(1, k)) AS c FROM split)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, c, x.f AS l, y.f AS r, ((cuts.f::HUGEINT * 2000000) // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = a1 JOIN f y ON y.lang = cuts.lang AND y.phrase = a2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
spans AS (SELECT lang, f, w, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM split)),
around AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS longer FROM spans GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR longer::HUGEINT * 100 < a::HUGEINT * 80)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
