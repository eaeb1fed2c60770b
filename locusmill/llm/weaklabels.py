"""Quality classifier from weak labels (operator 8).

Nine overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on each text.
Spark counts the vote patterns of all documents; there are at most 3**9 of them whatever
the input, so expectation-maximisation of the class share and of every labeller's vote
probabilities in each class runs on exact counts of the whole corpus. The posterior of a
pattern labels its documents, and posterior labels train a logistic scorer over hashed
letter trigrams. Training takes the ``train_rows`` documents of smallest hash of id and text, a
fixed bound; counting, posteriors and scores cover every document.

Defined cases: null and empty texts have no trigram and score by the posterior alone; rows
with a null doc_id are judged too (their hash is that of the text); repeated rows are judged
alike and each count; with no documents there is no model and the result is empty; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import base_counts, letters
from ..operators.shared import materialise
from .textbatch import Words, mix, words_of

FEATURE_BITS = 13
LABELLERS = ("length", "word_length", "symbols", "repeats", "lines", "capitals", "stops", "tables", "shouts")


@dataclass(frozen=True)
class WeakParams:
    """``slip``, ``catch``, ``weights``: prior of the label model, see ``estimate``; ``threshold``: a score above it is good.

    The driver gets ``train_rows`` lists of at most 2**FEATURE_BITS features, 200 MB at most.
    """

    train_rows: int = 4096
    em_steps: int = 500
    train_steps: int = 150
    ridge: float = 1e-4
    slip: float = 0.002
    catch: float = 0.2
    weights: tuple[float, float] = (1.0, 3.0)
    threshold: float = 0.5


def _count(words: Words, wanted: bytes | range) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(np.isin(words.data, np.array(list(wanted), np.uint8))), words.offsets))


def votes(words: Words) -> np.ndarray:
    """(texts, labellers): 1 good, 0 bad, -1 no opinion."""
    n, chars, symbols, dup_lines, repeats = base_counts(words)
    some = np.maximum(n, 1)
    lines = _count(words, b"\n") + 1
    letters = np.maximum(_count(words, range(97, 123)) + _count(words, range(65, 91)), 1)
    capitals = _count(words, range(65, 91)) / letters
    stops = _count(words, b".,;:?") / some
    tables, shouts = _count(words, b"|\t") / some, _count(words, b"!") / some

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    mean = chars / some
    out = np.stack(
        [
            vote(n >= 50, n < 20),
            vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 15)),
            vote(symbols < 0.02 * some, symbols > 0.1 * some),
            vote(repeats < 0.1 * some, repeats > 0.4 * some),
            vote(dup_lines == 0, dup_lines > 0.3 * lines),
            vote(capitals < 0.15, capitals > 0.4),
            vote((stops > 0.04) & (stops < 0.5), (stops < 0.01) | (stops > 1)),
            vote(tables < 0.01, tables > 0.2),
            vote(shouts < 0.05, shouts > 0.3),
        ],
        axis=1,
    )
    out[n == 0, 1:] = -1
    return out.astype(np.int8)


def vote_table(docs: DataFrame) -> DataFrame:
    """doc_id and votes, written as digits 0, 1 and '-'."""
    signs = np.frombuffer(b"01-", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [signs[votes(w)] for w in words_of(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array([r.tobytes().decode() for x in rows for r in x], pa.string())], ["doc_id", "votes"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes string")


@dataclass
class LabelModel:
    share: float  # of good documents
    tables: np.ndarray  # (labeller, class, vote): probabilities, votes in the order 0, 1, -

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability of good for each pattern."""
        if not patterns:
            return np.zeros(0)
        bad, good = self.logs(_places(patterns))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))

    def logs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of each row of votes together with the bad and the good class."""
        t = np.log(self.tables)
        each = [np.log(share) + sum(t[k, c, v[:, k]] for k in range(v.shape[1])) for c, share in ((0, 1 - self.share), (1, self.share))]
        return each[0], each[1]

    def accuracies(self) -> dict[str, float]:
        """Probability of a right vote, where the labeller votes."""
        t = self.tables
        right = self.share * t[:, 1, 1] + (1 - self.share) * t[:, 0, 0]
        return dict(zip(LABELLERS, (right / (right + self.share * t[:, 1, 0] + (1 - self.share) * t[:, 0, 1])).round(6).tolist()))


def _places(patterns: list[str]) -> np.ndarray:
    return np.array([["01-".index(c) for c in p] for p in patterns])


def _step(v: np.ndarray, counts: np.ndarray, good: np.ndarray, prior: np.ndarray, weight: np.ndarray) -> LabelModel:
    """The most probable model for the given class of each pattern (maximisation)."""
    weights = np.stack([counts * (1 - good), counts * good])
    n = weights.sum(axis=1)
    tables = np.stack([[np.bincount(v[:, k], w, 3) for w in weights] for k in range(v.shape[1])]) + (weight * n)[None, :, None] * prior + 1e-3
    return LabelModel(float(np.clip((n[1] + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)), tables / tables.sum(axis=2, keepdims=True))


def estimate(patterns: list[str], counts: np.ndarray, steps: int = 500, p: WeakParams | None = None) -> LabelModel:
    """Expectation-maximisation over pattern counts, the best of several starts.

    With ``p``, labellers are taken to be precise: a vote against a good document is rare (``slip``), while
    a bad document need only be seen by some of them (``catch``). Without that, two labellers
    that see the same kind of bad document are explained by a class of that kind alone, and
    all other bad documents count as good. The prior weighs as much as so many documents of
    the class (``weights``), so its share of the evidence is the same for any input. Without ``p``
    nothing is known beforehand, but that labellers are right more often than not.
    """
    p = p or WeakParams(weights=(0.0, 0.0))
    v = _places(patterns)
    abstain = np.stack([np.bincount(v[:, k], counts, 3) for k in range(v.shape[1])])[:, 2] / counts.sum()
    mean = np.array([[p.catch, 1 - p.catch], [p.slip, 1 - p.slip]])
    prior = np.concatenate([mean[None] * (1 - abstain)[:, None, None], np.repeat(abstain[:, None, None], 2, axis=1)], axis=2)
    weight = np.array(p.weights)
    best = None
    for against in (1, 2, 3):
        good = np.where((v == 0).sum(axis=1) >= against, 0.1, 0.9)
        for _ in range(steps):
            model = _step(v, counts, good, prior, weight)
            new = model.posterior(patterns)
            if np.abs(new - good).max() < 1e-10:
                break
            good = new
        n = np.array([(counts * (1 - good)).sum(), (counts * good).sum()])
        value = float((counts * np.logaddexp(*model.logs(v))).sum() + ((weight * n)[None, :, None] * prior * np.log(model.tables)).sum())
        # the mirror image of a model, with its classes exchanged, fits as well
        mirrored = np.mean(list(model.accuracies().values())) < 0.5
        if best is None or (not mirrored, value) > best[:2]:
            best = (not mirrored, value, model)
    return best[2]


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a chunk's letters and the text of each."""
    codes, text = letters(words)
    n = max(len(codes) - 2, 0)
    key = codes[:n].astype(np.uint64)
    for j in (1, 2):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[j : n + j]
    whole = text[:n] == text[2:]
    return (mix(key[whole]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), text[:n][whole]


def train_scorer(sample: list[tuple[np.ndarray, np.ndarray, float]], p: WeakParams) -> np.ndarray:
    """Logistic weights (bias last) for mean trigram weights, by full-batch Adam on posterior labels."""
    size = 1 << FEATURE_BITS
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not sample:
        return w
    row = np.repeat(np.arange(len(sample)), [len(f) for f, _, _ in sample])
    col = np.concatenate([f for f, _, _ in sample]).astype(np.int64)
    val = np.concatenate([n / n.sum() if len(n) else n for _, n, _ in sample]).astype(np.float64)
    y = np.array([t for _, _, t in sample])
    # both classes weigh the same
    each = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    for step in range(1, p.train_steps + 1):
        z = np.bincount(row, w[col] * val, len(y)) + w[-1]
        error = each * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.append(np.bincount(col, val * error[row], size), error.sum()) + p.ridge * w / len(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def classify(docs: DataFrame, p: WeakParams = WeakParams()) -> DataFrame:
    """doc_id, votes, posterior, score, kept: one row for each document."""
    spark = docs.sparkSession
    voted = materialise(vote_table(docs), "votes")
    table = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3**9 rows
    patterns, counts = [r["votes"] for r in table], np.array([r["n"] for r in table], float)
    model = estimate(patterns, counts, p.em_steps, p) if patterns else None
    posterior = dict(zip(patterns, model.posterior(patterns).tolist())) if model else {}

    # the bounded training sample
    share = min(1.0, 1.3 * p.train_rows / max(counts.sum(), 1))
    # a row's place in it follows from its id and text together; rows equal in both count once, so no id and no copy fills it
    picked = docs.select(F.col("text").cast("string"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("h"))
    picked = picked.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.frombuffer(b"01-", np.uint8)
        for batch in batches:
            rows = ([], [], [])
            for words in words_of(batch.column("text")):
                key, text = _features(words)
                bounds = np.searchsorted(text, np.arange(words.n_texts + 1))
                for i, v in enumerate(votes(words)):
                    f, n = np.unique(key[bounds[i] : bounds[i + 1]], return_counts=True)
                    rows[0].append(signs[v].tobytes().decode())
                    rows[1].append(f.astype(np.uint16).tobytes())
                    rows[2].append(n.astype(np.int32).tobytes())
            yield pa.record_batch([batch.column("h"), *(pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.binary(), pa.binary())))], ["h", "votes", "f", "n"])

    sample = picked.select("text", "h").mapInArrow(features, "h long, votes string, f binary, n binary").orderBy("h", "votes", "f").limit(p.train_rows).toArrow().to_pylist()
    weights = train_scorer([(np.frombuffer(r["f"], np.uint16), np.frombuffer(r["n"], np.int32), posterior[r["votes"]]) for r in sample], p)
    shared = spark.sparkContext.broadcast((posterior, weights.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        signs = np.frombuffer(b"01-", np.uint8)
        for batch in batches:
            rows, scores = [], []
            for words in words_of(batch.column("text")):
                key, text = _features(words)
                n = np.bincount(text, minlength=words.n_texts)
                z = np.bincount(text, w[key], words.n_texts) / np.maximum(n, 1) + w[-1]
                own = [signs[v].tobytes().decode() for v in votes(words)]
                rows += own
                scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), [known[x] for x in own]))
            good = pa.array([known[x] for x in rows], pa.float64())
            s = np.concatenate([np.zeros(0), *scores])
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.string()), good, pa.array(s), pa.array(s >= p.threshold)], ["doc_id", "votes", "posterior", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {kind}, votes string, posterior double, score double, kept boolean")


def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
