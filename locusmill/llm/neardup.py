"""MinHash-style near-duplicate classes with SetSketch registers (operator 4).

A document's set holds its distinct shingles of ``k`` words. Each of ``m`` registers is the
exponentially spaced, truncated minimum ``floor(1 - log_b(min of exponential variates))``
of one hash of the set: registers of a union are the larger of the two, and two sets agree
in a register with a probability close to their similarity. ``bands`` groups of ``rows``
registers are the buckets.

1. Documents with equal sets are one class at once; only its smallest id goes on.
2. In every bucket each class is paired with one leader, so a bucket of any size gives as
   many pairs as it has members. Pairs are screened with the joint likelihood of the two
   sketches (far below the threshold only) and confirmed on the full sets.
3. Buckets that hold a single component are done. The others get further leaders. What is
   still mixed then is compared in full, so no link is missed that the buckets hold: small
   buckets by their pairs from different components; larger ones are merged into clusters
   whose members meet block by block, where a block pair counts all its intersections at
   once and returns only links that join components, never more than it has members.

The number of bands follows from the threshold: a pair that just reaches it shares no
bucket with probability ``miss`` at most (35 bands of 5 at 0.8, 24 at 0.85). The screen
lies six standard errors below the threshold.

Defined cases: null, empty and blank texts have empty sets and link with nothing; a null
doc_id is returned with a null component and kept; rows that share a doc_id are one node
with the links of any of them, each row returned; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.shared import materialise
from .textbatch import mix, shingles, words_of


@dataclass(frozen=True)
class SketchParams:
    """``k`` words a shingle, linked from ``percent`` similarity; ``miss``: chance that such a pair shares no bucket."""

    k: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-6
    base: float = 1.001
    rate: float = 20.0
    limit: int = (1 << 16) - 2
    lead_rounds: int = 2
    small_bucket: int = 64
    block: int = 256

    @property
    def bands(self) -> int:
        return ceil(log(self.miss) / log1p(-((self.percent / 100) ** self.rows)))

    @property
    def m(self) -> int:
        return self.bands * self.rows

    @property
    def screen(self) -> float:
        j = self.percent / 100
        return j - 6 * (j * (1 - j) / self.m) ** 0.5


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct shingle hashes; a shorter text is one shingle."""
    for words in words_of(column):
        hashes = words.hashes(lower=True)
        grams, at = shingles(hashes, words.text_of_word, k)
        cut = np.searchsorted(at, words.bounds)
        for i in range(words.n_texts):
            lo, hi = words.bounds[i], words.bounds[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[cut[i] : cut[i + 1]])
            elif hi > lo:
                yield mix(mix(hashes[lo:hi]).cumsum()[-1:] * np.uint64(2 * (hi - lo) + 1) + hashes[lo : lo + 1])
            else:
                yield np.zeros(0, np.uint64)


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(99_991)
    return rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, m, dtype=np.uint64)


def registers(values: np.ndarray, p: SketchParams) -> np.ndarray:
    """SetSketch registers of a non-empty set; merge two sketches by np.maximum."""
    factor, shift = _multipliers(p.m)
    least = np.full(p.m, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 16) // p.m)
    for i in range(0, len(values), step):
        np.minimum(least, (values[i : i + step, None] * factor + shift).min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(u, 1 - 1e-16)) / p.rate
    return np.clip(np.floor(1 - np.log(exponential) / np.log(p.base)), 0, p.limit + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray, p: SketchParams) -> np.ndarray:
    key = np.arange(p.bands, dtype=np.uint64) + np.uint64(1)
    for column in sketch.reshape(p.bands, p.rows).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key.view(np.int64)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Likelihood estimate of the similarity of sketched pairs (rows) of known set sizes.

    Counts of registers that are larger, smaller and equal are multinomial in the
    similarity; the log likelihood is concave, so a ternary search finds its maximum.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary, keys array<long>"


def sketch_documents(docs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """One row for each document: set size, a 128-bit hash of the set, registers and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, regs, keys = [], [], [], [], []
            for values in text_sets(batch.column("text"), p.k):
                n.append(len(values))
                if len(values):
                    sketch = registers(values, p)
                    sums = np.array([values.sum(), mix(values).sum()], np.uint64)
                    a.append(sums.view(np.int64)[0])
                    b.append(sums.view(np.int64)[1])
                    regs.append(sketch.tobytes())
                    keys.append(band_keys(sketch, p))
                else:
                    a.append(0)
                    b.append(0)
                    regs.append(None)
                    keys.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary()), lists], [x.split()[0] for x in _SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH)


def _screen(pairs: DataFrame, classes: DataFrame, p: SketchParams) -> DataFrame:
    """(a, b, ok): whether the sketches leave open that the pair reaches the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = lambda x: np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, p.m)
            j = joint_similarity(rows("s_a"), rows("s_b"), batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float), p.base)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(j >= p.screen)], ["a", "b", "ok"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(run, "a long, b long, ok boolean")


def _confirm(pairs: DataFrame, texts: DataFrame, p: SketchParams) -> DataFrame:
    """Pairs (a, b) that reach the threshold on their full sets; texts: rep, text of all that can be in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(text_sets(batch.column("t_a"), p.k), text_sets(batch.column("t_b"), p.k)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t_{x}"))
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long"), "links")


def _intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y, exactly."""
    out = np.zeros((len(x), len(y)))
    flat_x, flat_y = (np.concatenate([np.zeros(0, np.uint64), *v]) for v in (x, y))
    row_x, row_y = (np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (x, y))
    both = np.intersect1d(flat_x, flat_y)
    for i in range(0, len(both), columns):
        part = both[i : i + columns]
        sides = []
        for flat, row, n in ((flat_x, row_x, len(x)), (flat_y, row_y, len(y))):
            at = np.searchsorted(part, flat)
            at[at == len(part)] = 0
            hit = part[at] == flat
            bits = np.zeros((n, len(part)), np.float32)
            bits[row[hit], at[hit]] = 1
            sides.append(bits)
        out += sides[0] @ sides[1].T
    return out


def _joining_links(a: list[tuple], b: list[tuple], p: SketchParams) -> list[tuple[int, int]]:
    """Links between (rep, component, set) of two blocks that join components; a forest of them."""
    x, y = [r[2] for r in a], [r[2] for r in b]
    both = _intersections(x, y)
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
    apart = np.array([r[1] for r in a])[:, None] != np.array([r[1] for r in b])[None, :]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(apart & (both > 0) & (100 * both >= p.percent * union))):
        s, t = root(a[i][1]), root(b[j][1])
        if s != t:
            parent[max(s, t)] = min(s, t)
            out.append((a[i][0], b[j][0]))
    return out


def _block_links(hot: DataFrame, texts: DataFrame, p: SketchParams) -> DataFrame:
    """Links across components among (key, rep, component), by clusters of buckets in blocks."""
    first = materialise(hot.groupBy("key").agg(F.min("rep").alias("first")), "firsts")
    clusters = connected_components(hot.join(first, "key").select("rep", "first"), "rep", "first").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = materialise(clusters.join(hot.select("rep", "component").distinct(), "rep"), "cluster-members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    wanted = members.join(materialise(sizes, "cluster-sizes"), "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = materialise(texts.join(materialise(wanted, "wanted"), "rep"), "cluster-texts").withColumn("other", other)
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        sets = list(text_sets(table.column("text").combine_chunks(), p.k))
        own, lo = table.column("own").to_pylist(), table.column("lo")[0].as_py()
        items = list(zip(table.column("rep").to_pylist(), table.column("component").to_pylist(), sets))
        left = [r for r, o in zip(items, own) if o == lo]
        right = [r for r, o in zip(items, own) if o != lo] if table.column("hi")[0].as_py() != lo else left
        links = _joining_links(left, right, p) if left and right else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return materialise(rows.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long"), "block-links")


def near_duplicate_links(docs: DataFrame, sketches: DataFrame, p: SketchParams = SketchParams()) -> tuple[DataFrame, DataFrame]:
    """(members, labels): doc_id to the smallest id of its equal sets, and rep to component where it has links."""
    sets = sketches.filter("n_shingles > 0 and doc_id is not null")
    # equal sets have equal sketches, so any of them does
    classes = materialise(sets.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "classes")
    members = sets.select("doc_id", "set_a", "set_b", "n_shingles").join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep")
    fits = lambda x, y: 100 * F.least(x, y) >= p.percent * F.greatest(x, y)

    slots = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    texts, tried, labels = None, None, None

    def joined(found: DataFrame) -> DataFrame:
        """Components with the links found so far: the old ones are stars already."""
        old = [labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))] if labels is not None else []
        return connected_components(found.unionByName(*old) if old else found)

    def test(pairs: DataFrame) -> None:
        nonlocal tried, labels
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(_screen(pairs, classes, p), "screened")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _confirm(pairs.filter("ok"), texts, p)
        if not found.isEmpty():
            labels = joined(found)

    for turn in range(p.lead_rounds + 1):
        if turn:
            slots = slots.select("rep", "n_shingles", "key")
        if labels is not None:
            slots = slots.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        else:
            slots = slots.withColumn("component", F.col("rep"))
        order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n_shingles", "component")
        mixed = slots.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(order).alias("lead"))
        slots = materialise(slots.join(materialise(mixed.filter("lo < hi").select("key", "n", "lead"), "leads"), "key"), "slots")
        if slots.isEmpty():
            break
        if not turn:
            ends = materialise(slots.select("rep").distinct(), "ends")
            texts = materialise(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(ends, "rep", "left_semi"), "texts")
        if turn < p.lead_rounds:
            test(slots.filter((F.col("component") != F.col("lead.component")) & fits(F.col("n_shingles"), F.col("lead.n_shingles"))).select(F.col("rep").alias("x"), F.col("lead.rep").alias("y")))
        else:
            small, large = slots.filter(F.col("n") <= p.small_bucket), slots.filter(F.col("n") > p.small_bucket).select("key", "rep", "component")
            other = small.select("key", F.col("rep").alias("y"), F.col("n_shingles").alias("n_y"), F.col("component").alias("c_y"))
            test(small.join(other, "key").filter((F.col("component") < F.col("c_y")) & fits(F.col("n_shingles"), F.col("n_y"))).select(F.col("rep").alias("x"), "y"))
            if not large.isEmpty():
                labels = joined(_block_links(large, texts, p))
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, component long")
    return members, labels


def _moved(docs: DataFrame, sketches: DataFrame, p: SketchParams) -> DataFrame:
    """(doc_id, component_id) of the documents that are not the smallest of their component, once each."""
    members, labels = near_duplicate_links(docs, sketches, p)
    chosen = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id"), F.coalesce("component", "rep").alias("c"))
    chosen = materialise(chosen, "chosen")
    # a repeated doc_id is in as many components as it has texts: it joins them
    several = chosen.groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    several = materialise(several, "several")
    if not several.isEmpty():
        joins = connected_components(chosen.join(several, "doc_id").select("c", "lo"), "c", "lo").withColumnRenamed("node", "c")
        chosen = chosen.join(joins, "c", "left").select("doc_id", F.coalesce("component", "c").alias("c"))
    return materialise(chosen.filter("c <> doc_id").groupBy("doc_id").agg(F.min("c").alias("component_id")), "moved")


def near_duplicates(docs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    sketches = materialise(sketch_documents(docs, p), "sketches")
    out = sketches.select("doc_id", "n_shingles").join(_moved(docs, sketches, p), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """One row of docs of each component: the smallest doc_id, a null one last.

    Rows are compared by written keys of their own, so copies that share a doc_id or have
    none are dropped too, and different texts of one doc_id are judged each on its own.
    """
    # own columns lie in a struct, so none clashes with the key
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("_row")), "near-rows")
    keyed = rows.select(F.col("_row").alias("doc_id"), F.col("own.text").alias("text"))
    members, labels = near_duplicate_links(keyed, materialise(sketch_documents(keyed, p), "sketches"), p)
    found = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("_row"), F.coalesce("component", "rep").alias("c"))
    found = materialise(found.join(rows.select("_row", F.col("own.doc_id").cast("long").alias("_id")), "_row"), "near-members")
    best = found.groupBy("c").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("m"))
    best = materialise(best.select("c", F.col("m._row").alias("first")), "near-first")
    gone = materialise(found.join(best, "c").filter("_row <> first").select("_row"), "near-gone")
    return rows.join(gone, "_row", "left_anti").select("own.*")


def op4_setsketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), SketchParams(k=3, percent=85))
