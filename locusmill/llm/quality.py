"""Quality rules with an n-gram perplexity band per language (operator 1).

Spark counts the 5-grams of code points of every text, by language: tasks pre-aggregate,
then counts are summed by n-gram. Counts and continuation counts become an interpolated
modified Kneser-Ney model, level by level, as joins of n-grams with their contexts and
suffixes. The model has no bound: it grows with the scripts, languages and texts it sees.

Scoring meets the model twice. The most frequent n-grams, ``head`` at most, are sent to the
tasks as sorted arrays of hashes beside log probabilities (12 bytes an n-gram, so a bounded
broadcast). What a text has besides goes as (row, n-gram, count) through a join with the
whole model, sorted by n-gram, where unseen n-grams back off. Log probabilities are
whole millionths of a nat, so sums don't depend on any order.

A text is rejected where its mean negative log probability a letter, under the model of
its own language, lies outside ``median +- width * spread`` of that language, with spread
the scaled median absolute deviation over all texts that pass the base rules.

Letters are code points; white space, ASCII digits, capitals (of the first plane) and the
symbols ``#*$%&|<>`` are one letter each, and U+0000 is U+FFFD. So shouting and rows of
symbols are too easy to predict, and meet the lower band.

Defined cases: a null or empty text has no words and fails the base rules; a text of under
5 code points has no perplexity and meets no band; a null language is a language of its
own, and so is every other value, whatever their number; repeated rows are judged alike,
each on its own; an empty table gives an empty result; further columns pass through, and
a column of a clashing name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.shared import materialise
from .textbatch import Words, mix, shingles, span_hashes, words_of

ORDER = 5
#: Log probabilities are whole numbers of 1 / UNIT nats.
UNIT = 1_000_000
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_IS_SYMBOL = np.isin(np.arange(256), _SYMBOLS)
_SPACES = [32, 9, 10, 11, 12, 13]
#: First bytes of code points other than white space.
_IN_WORD = (np.arange(256) & 0xC0) != 0x80
_IN_WORD[_SPACES] = False
#: Letters of the first plane: white space, digits, capitals of any script and symbols are one letter each.
_FOLD = np.arange(1 << 16, dtype=np.uint32)
_FOLD[[i for i in range(1 << 16) if chr(i).isupper()]] = 65
_FOLD[_SPACES] = 32
_FOLD[48:58] = 48
_FOLD[_SYMBOLS] = 35
_FOLD[0] = 0xFFFD


@dataclass(frozen=True)
class QualityParams:
    """``width``: half the band in spreads; ``least_spread``: a floor, in nats a letter; ``head``: n-grams held by each task."""

    min_words: int = 50
    max_repeat_percent: int = 50
    width: float = 5.0
    least_spread: float = 0.02
    head: int = 1 << 20


def model_name(lang: Column) -> Column:
    """The model of a language; null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-"))


def letters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk's texts, folded, and the text of each."""
    raw = words.data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.diff(np.searchsorted(np.flatnonzero((words.data & 0xC0) != 0x80), words.offsets))
    if len(codes) != sizes.sum():  # bytes that are no UTF-8: text by text
        texts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(words.offsets, words.offsets[1:])]
        codes, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    plain = codes < len(_FOLD)
    codes = np.where(plain, _FOLD[np.where(plain, codes, 0)], codes)
    return codes, np.repeat(np.arange(words.n_texts, dtype=np.int32), sizes)


def _windows(text: np.ndarray) -> np.ndarray:
    """Places where ORDER letters of one text begin."""
    n = len(text) - ORDER + 1
    return np.flatnonzero(text[:n] == text[ORDER - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _strings(codes: np.ndarray) -> pa.Array:
    """Rows of ORDER code points as strings."""
    return pa.array(np.ascontiguousarray(codes, np.uint32).reshape(-1, ORDER).view(f"<U{ORDER}")[:, 0].tolist(), pa.string())


_COUNTED = ["model", "gram", "n"]


class GramCounter:
    """Counts of (model, n-gram) of a task: at most ``most`` of them at a time, then they leave as partial counts.

    An n-gram is packed into 64 bits by the places of its letters and its model in lists
    that the task keeps; when a list is full the counts leave and the lists begin anew.
    """

    SYMBOL_BITS, MODELS = 11, 1 << (64 - 11 * ORDER)

    def __init__(self, most: int = 1 << 19, buffer: int = 1 << 21) -> None:
        self.most, self.buffer = most, buffer
        self.place = np.zeros(0x110000, np.uint16)
        self.reset()

    def reset(self) -> None:
        self.place[:] = 0
        self.symbols: list[int] = [0]
        self.models: dict[str, int] = {}
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw: list[np.ndarray] = []

    def _merge(self) -> None:
        if self.raw:
            fresh = np.sort(np.concatenate(self.raw))
            self.raw = []
            first = np.flatnonzero(np.append(True, fresh[1:] != fresh[:-1])) if len(fresh) else np.zeros(0, np.int64)
            keys = np.concatenate([self.keys, fresh[first]])
            counts = np.concatenate([self.counts, np.diff(np.append(first, len(fresh)))])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        symbols, names = np.array(self.symbols, np.uint32), np.array([*self.models, ""], object)
        mask, bits = np.uint64((1 << self.SYMBOL_BITS) - 1), self.SYMBOL_BITS
        for i in range(0, len(self.keys), 1 << 16):
            k = self.keys[i : i + (1 << 16)]
            codes = np.stack([symbols[((k >> np.uint64(bits * j)) & mask).astype(np.int64)] for j in range(ORDER - 1, -1, -1)], axis=1)
            yield pa.record_batch([pa.array(names[(k >> np.uint64(bits * ORDER)).astype(np.int64)], pa.string()), _strings(codes), pa.array(self.counts[i : i + (1 << 16)])], _COUNTED)
        self.reset()

    def add(self, codes: np.ndarray, text: np.ndarray, models: list[str]) -> Iterator[pa.RecordBatch]:
        at = _windows(text)
        if not len(at):
            return
        known = np.unique(codes)
        names = dict.fromkeys(models)
        fresh, new = known[self.place[known] == 0], [m for m in names if m not in self.models]
        if len(self.symbols) + len(fresh) > 1 << self.SYMBOL_BITS or len(self.models) + len(new) > self.MODELS or len(self.keys) > self.most:
            yield from self.flush()
            fresh, new = known, list(names)
        if len(fresh) >= 1 << self.SYMBOL_BITS or len(new) > self.MODELS:
            yield self._apart(codes, text, at, models)
            return
        self.place[fresh] = np.arange(len(self.symbols), len(self.symbols) + len(fresh))
        self.symbols += fresh.tolist()
        self.models |= {m: len(self.models) + i for i, m in enumerate(new)}
        ranks = self.place[codes].astype(np.uint64)
        key = np.array([self.models[m] for m in models], np.uint64)[text[at]]
        for j in range(ORDER):
            key = (key << np.uint64(self.SYMBOL_BITS)) | ranks[at + j]
        self.raw.append(key)
        if sum(map(len, self.raw)) >= self.buffer:
            self._merge()

    def _apart(self, codes: np.ndarray, text: np.ndarray, at: np.ndarray, models: list[str]) -> pa.RecordBatch:
        """A chunk of more letters or models than the lists hold, counted by itself."""
        names, which = np.unique(np.array(models, object), return_inverse=True)
        rows = np.stack([which[text[at]].astype(np.uint32), *[codes[at + j] for j in range(ORDER)]], axis=1)
        rows, n = np.unique(rows, axis=0, return_counts=True)
        return pa.record_batch([pa.array(names[rows[:, 0]], pa.string()), _strings(rows[:, 1:]), pa.array(n)], _COUNTED)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = GramCounter()
    for batch in batches:
        models = batch.column("model").to_pylist()
        for words in words_of(batch.column("text")):
            yield from counter.add(*letters(words), models[words.first : words.first + words.n_texts])
    yield from counter.flush()


def count_grams(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(model, gram, n): counts of the n-grams of every whole text."""
    partial = docs.select(model_name(F.col(lang_column)).alias("model"), F.col(text_column).cast("string").alias("text")).mapInArrow(_count_batches, "model string, gram string, n long")
    return partial.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Levels 1 to ORDER of the interpolated modified Kneser-Ney model: (model, gram, context, n, p, gamma).

    The highest order takes raw counts, each lower one the number of different letters
    seen before the n-gram. Discounts come from the counts of counts of each order; gamma is
    the weight that the n-gram's context leaves to the order below. Under the lowest order
    all letters of the model and one unknown one are equally likely.
    """
    levels, level = {}, counts
    for size in range(ORDER, 0, -1):
        levels[size] = level
        if size > 1:
            level = materialise(level.groupBy("model", F.substring("gram", 2, size - 1).alias("gram")).agg(F.count("*").alias("n")), f"kn-counts{size - 1}")
    out: list[DataFrame] = []
    for size in range(1, ORDER + 1):
        c = levels[size]
        k = [F.greatest(F.sum((F.col("n") == i).cast("double")), F.lit(0.5)) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        cap = lambda x, most: F.greatest(F.lit(0.05), F.least(x, F.lit(most)))
        discounts = c.groupBy("model").agg(cap(1 - 2 * y * k[1] / k[0], 0.95).alias("d1"), cap(2 - 3 * y * k[2] / k[1], 1.9).alias("d2"), cap(3 - 4 * y * k[3] / k[2], 2.85).alias("d3"), F.count("*").alias("letters"))
        c = c.join(discounts, "model").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        c = c.withColumn("context", F.substring("gram", 1, size - 1))
        # a context has at most as many continuations as there are letters: this window is bounded
        w = Window.partitionBy("model", "context")
        c = c.withColumn("total", F.sum("n").over(w)).withColumn("gamma", F.sum("d").over(w) / F.col("total"))
        own = (F.col("n") - F.col("d")) / F.col("total")
        if size == 1:
            c = c.withColumn("p", own + F.col("gamma") / (F.col("letters") + 1))
        else:
            low = out[-1].select("model", F.col("gram").alias("tail"), F.col("p").alias("low"))
            c = c.withColumn("tail", F.substring("gram", 2, size - 1)).join(low, ["model", "tail"]).withColumn("p", own + F.col("gamma") * F.col("low"))
        out.append(materialise(c.select("model", "gram", "context", "n", "p", "gamma", "letters"), f"kn{size}"))
    return out


def _log(p: Column) -> Column:
    return F.round(F.log(p) * UNIT).cast("long")


def gram_hashes(codes: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Hashes of rows of ORDER code points, model: a hash of each row's model."""
    h = model
    for j in range(ORDER):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, j].astype(np.uint64)
    return mix(h)


def _model_hash(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class HashArrays:
    """Sorted n-gram hashes beside log probabilities, with a directory of the hashes' first bits."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.logp = hashes[order], logp[order].astype(np.int32)
        self.bits = max(1, int(len(hashes)).bit_length())
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.longest = int(np.diff(np.append(self.first, len(self.hashes))).max(initial=0))

    def find(self, want: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where they aren't held."""
        out = np.full(len(want), -1, np.int32)
        if not len(self.hashes):
            return out
        at = self.first[(want >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.arange(len(want))
        for step in range(self.longest):
            place = np.minimum(at[open_] + step, len(self.hashes) - 1)
            hit = self.hashes[place] == want[open_]
            out[open_[hit]] = place[hit]
            open_ = open_[self.hashes[place] < want[open_]]
        return out


@dataclass
class NgramModel:
    levels: list[DataFrame]  # 1 to ORDER
    head: HashArrays

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """wanted (key, model, gram, n) -> (key, nats): sums of n times the n-grams' log probabilities, in units.

        Unseen n-grams back off: the weight of the context, then the n-gram without its
        first letter; an unknown letter takes the share of one letter of the model.
        """
        parts, todo = [], wanted.withColumn("back", F.lit(0).cast("long"))
        for size in range(ORDER, 0, -1):
            level = self.levels[size - 1]
            joined = materialise(todo.join(level.select("model", "gram", _log(F.col("p")).alias("logp")), ["model", "gram"], "left"), "kn-asked")
            parts.append(joined.filter("logp is not null").select("key", (F.col("n") * (F.col("logp") + F.col("back"))).alias("nats")))
            todo = joined.filter("logp is null").drop("logp")
            if todo.isEmpty():
                break
            weights = level.groupBy("model", "context").agg(_log(F.first("gamma")).alias("g"), F.first("letters").alias("letters"))
            todo = todo.withColumn("context", F.substring("gram", 1, size - 1)).join(weights, ["model", "context"], "left")
            todo = todo.withColumn("back", F.col("back") + F.coalesce("g", F.lit(0).cast("long"))).withColumn("gram", F.substring("gram", 2, size - 1))
            if size == 1:
                # neither the letter nor, where letters is null, the model is known
                parts.append(todo.select("key", (F.col("n") * (F.col("back") + _log(1 / (F.coalesce("letters", F.lit(0)) + 1)))).alias("nats")))
            todo = todo.select("key", "model", "gram", "n", "back")
        return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("nats").alias("nats"))


def most_frequent(level: DataFrame, most: int) -> DataFrame:
    """The n-grams from a frequency on, with at most ``most`` of them: whole classes of an eighth of an octave."""
    octave = F.floor(8 * F.log2(F.col("n"))).cast("int")
    classes = level.groupBy(octave.alias("o")).agg(F.count("*").alias("k")).orderBy(F.desc("o")).collect()  # some hundreds at most
    total, least = 0, None
    for r in classes:
        total += r["k"]
        if total > most:
            break
        least = r["o"]
    return level.filter(octave >= least) if least is not None else level.limit(0)


def train(docs: DataFrame, params: QualityParams = QualityParams(), text_column: str = "text", lang_column: str = "lang") -> NgramModel:
    """Count, estimate and store; only the bounded head reaches the driver."""
    levels = kneser_ney(materialise(count_grams(docs, text_column, lang_column), "grams"))
    rows = most_frequent(levels[-1], params.head).select("model", "gram", _log(F.col("p")).cast("int").alias("logp")).toArrow()
    names, which = np.unique(np.array(rows["model"].to_pylist(), object), return_inverse=True)
    seeds = np.array([_model_hash(n) for n in names], np.uint64)
    codes = np.frombuffer("".join(rows["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    return NgramModel(levels, HashArrays(gram_hashes(codes, seeds[which] if len(seeds) else np.zeros(0, np.uint64)), rows["logp"].to_numpy()))


def base_counts(words: Words) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a chunk."""
    n_words = np.diff(words.bounds)
    o = words.offsets
    chars = np.diff(np.searchsorted(np.flatnonzero(_IN_WORD[words.data]), o))
    symbols = np.diff(np.searchsorted(np.flatnonzero(_IS_SYMBOL[words.data]), o))

    # lines: cut at \n and at text ends; those with a word count
    cuts = np.flatnonzero(words.data == 10)
    starts = np.union1d(o[:-1][o[1:] > o[:-1]], cuts[np.isin(cuts + 1, o, invert=True)] + 1)
    ends = np.minimum(np.append(cuts, len(words.data))[np.searchsorted(cuts, starts)], o[np.searchsorted(o, starts, "right")] if len(starts) else starts)
    solid = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[solid], ends[solid]
    line_text = np.searchsorted(o, starts, "right") - 1
    dup_lines = _repeats(line_text, span_hashes(words.data, starts, ends), words.n_texts)

    text = words.text_of_word
    windows, at = shingles(words.hashes(), text, 3)
    own = mix(windows + (text[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    twice = at[counts[inverse] >= 2]
    covered = np.zeros(len(text), bool)
    for i in range(3):
        covered[twice + i] = True
    repeat_words = np.bincount(text[covered], minlength=words.n_texts)
    return n_words, chars, symbols, dup_lines, repeat_words


def _repeats(text: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Items of each text that equal an earlier item of that text."""
    keys = mix(hashes + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(text, minlength=n_texts) - np.bincount(text[first], minlength=n_texts)


_SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, head long, rare array<struct<gram:string,n:long>>"


def _scorer(shared, place: int, model_place: int):
    """Batches with their columns and ``_scores``; ``rare`` lists the n-grams that the task doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: HashArrays = shared.value
        seeds: dict[str, int] = {}
        fields = [x.split()[0] for x in _SCORES.split(", ")]
        for batch in batches:
            names = batch.column(model_place).to_pylist()
            for words in words_of(batch.column(place)):
                i, n = words.first, words.n_texts
                codes, text = letters(words)
                at = _windows(text)
                own = text[at]
                seed = np.array([seeds.setdefault(m, _model_hash(m)) for m in names[i : i + n]], np.uint64)
                h = gram_hashes(np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at] if len(at) else np.zeros((0, ORDER), np.uint32), seed[own])
                found = known.find(h)
                hit = found >= 0
                head = np.bincount(own[hit], known.logp[found[hit]], n).astype(np.int64)  # whole numbers under 2**53
                miss = np.flatnonzero(~hit)
                _, first, times = np.unique(mix(h[miss] + own[miss].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True, return_counts=True)
                order = np.argsort(own[miss[first]], kind="stable")
                rare, times = miss[first][order], times[order]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[rare], np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([_strings(codes[rare_at(at, rare)]), pa.array(times, pa.int64())], ["gram", "n"]))
                arrays = [*(pa.array(x.astype(np.int64)) for x in (*base_counts(words), np.bincount(own, minlength=n), head)), lists]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, n).columns, pa.StructArray.from_arrays(arrays, fields)], [*batch.schema.names, "_scores"])

    return run


def rare_at(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the letters of the n-grams."""
    return at[which][:, None] + np.arange(ORDER)


def score_documents(docs: DataFrame, model: NgramModel, text_column: str = "text", lang_column: str = "lang", keep_text: bool = True) -> DataFrame:
    """docs, written, with column ``quality``: the counts, the model's name and mean nats a letter (null: too short).

    ``keep_text``: whether the text is a column of the result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.head)
    rows = docs.drop("quality").withColumn("_row", F.monotonically_increasing_id()).withColumn("_model", model_name(F.col(lang_column))).withColumn("_text", F.col(text_column).cast("string"))
    kind = StructType().add("_scores", StructType.fromDDL(_SCORES))
    scored = rows.mapInArrow(_scorer(shared, rows.columns.index("_text"), rows.columns.index("_model")), StructType([*rows.schema.fields, *kind.fields]))
    scored = materialise(scored.drop("_text", *([] if keep_text else [text_column])), "scored")
    s = lambda c: F.col(f"_scores.{c}")
    rare = scored.filter(F.size(s("rare")) > 0).select(F.col("_row").alias("key"), F.col("_model").alias("model"), F.explode(s("rare")).alias("r")).select("key", "model", "r.gram", "r.n")
    total = s("head")
    if not rare.isEmpty():
        scored = scored.join(materialise(model.log_probs(rare), "rare").withColumnRenamed("key", "_row"), "_row", "left")
        total = total + F.coalesce("nats", F.lit(0).cast("long"))
    nats = F.when(s("n_letters") > 0, -total / UNIT / s("n_letters"))
    counts = [s(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return scored.withColumn("quality", F.struct(*counts, F.col("_model").alias("model"), nats.alias("nats"))).drop("_scores", "_row", "_model", "nats")


def base_failed(params: QualityParams = QualityParams()) -> Column:
    q = lambda x: F.col(f"quality.{x}")
    return (q("n_words") < params.min_words) | (100 * q("n_repeat_words") > params.max_repeat_percent * q("n_words"))


def bands(scored: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(model, low, high): median +- width spreads over all scored texts that pass the base rules.

    Both medians are read from counts of thousandths of a nat, so they are exact to that
    step and the same for any partitioning; no text or score is gathered.
    """
    q = scored.filter(~base_failed(params) & F.col("quality.nats").isNotNull())
    bins = materialise(q.groupBy(F.col("quality.model").alias("model"), F.round(F.col("quality.nats") * 1000).cast("int").alias("bin")).agg(F.count("*").alias("n")), "bins")
    middle = bins.groupBy("model").agg(F.percentile("bin", 0.5, F.col("n")).alias("median"))
    away = bins.join(middle, "model").withColumn("away", F.abs(F.col("bin") - F.col("median")))
    both = away.groupBy("model").agg(F.first("median").alias("median"), F.percentile("away", 0.5, F.col("n")).alias("mad"))
    spread = F.greatest(1.4826 * F.col("mad") / 1000, F.lit(params.least_spread))
    return materialise(both.select("model", (F.col("median") / 1000 - params.width * spread).alias("low"), (F.col("median") / 1000 + params.width * spread).alias("high")), "bands")


def judge(scored: DataFrame, limits: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """scored with base_failed, low, high and kept; one band a language."""
    limits = limits.select(F.col("model").alias("_model"), "low", "high")
    nats = F.col("quality.nats")
    outside = (nats < F.col("low")) | (nats > F.col("high"))
    joined = scored.drop("low", "high", "base_failed", "kept", "_model").join(limits, F.col("quality.model") == F.col("_model"), "left").drop("_model")
    return joined.withColumn("base_failed", base_failed(params)).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False)))


def quality_report(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row for each document: counts, perplexity, band and verdict."""
    model = train(docs, params)
    scored = score_documents(docs.select("doc_id", "text", "lang"), model, keep_text=False)
    return judge(scored, bands(scored, params), params)


def filter_quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Scores are written beside the documents once, for the bands and the verdicts.
    """
    named = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    model = train(inner, params, named["text"], named["lang"])
    scored = score_documents(inner, model, named["text"], named["lang"])
    verdict = judge(scored, bands(scored, params), params).filter("kept")
    return verdict.select(*[F.col(n).alias(c) for c, n in named.items()])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = quality_report(docs)
    counts = [F.col(f"quality.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return r.select("doc_id", *counts, "base_failed", "kept", "lang", F.exp("quality.nats").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"))
