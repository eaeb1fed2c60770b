import math
from collections import Counter
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusmill.llm import quality

N = quality.ORDER


def prose(seed, n, stock):
    rng = np.random.default_rng(seed)
    return " ".join(stock[int(i)] for i in rng.integers(0, len(stock), n))


RU = ["и", "в", "Москва", "слово", "дом", "речка", "говорит", "новый", "год", "мир"]
EN = ["and", "the", "words", "River", "speaks", "new", "year", "of", "42", "house", "| #"]
ROWS = [(i, prose(i, 60 + i, RU if i % 3 == 0 else EN), [None, "ru"][i % 2] if i % 3 == 0 else "en") for i in range(24)] + [(50, None, "en"), (51, "ab", "en"), (52, "日本語の文章です\x00ｱ𝄞" * 9, "ja"), (52, "日本語の文章です\x00ｱ𝄞" * 9, "ja"), (None, "", None)]


def fold(t):
    return "".join(chr(int(quality._FOLD[ord(c)])) if ord(c) < 1 << 16 else c for c in t)


class KneserNey:
    """Dictionaries, straight from the definition."""

    def __init__(self, texts):
        self.counts = {N: Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1))}
        for size in range(N - 1, 0, -1):
            self.counts[size] = Counter(g[1:] for g in self.counts[size + 1])
        self.discounts = {}
        for size, c in self.counts.items():
            k = [max(sum(v == i for v in c.values()), 0.5) for i in (1, 2, 3, 4)]
            y = k[0] / (k[0] + 2 * k[1])
            self.discounts[size] = [min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.05), m) for i, m in enumerate((0.95, 1.9, 2.85))]
        self.totals, self.weights = {}, {}
        for size, c in self.counts.items():
            t, w = Counter(), Counter()
            for g, n in c.items():
                t[g[:-1]] += n
                w[g[:-1]] += self.discounts[size][min(n, 3) - 1]
            self.totals[size], self.weights[size] = t, w

    def p(self, gram):
        size = len(gram)
        if not size:
            return 1 / (len(self.counts[1]) + 1)
        t = self.totals[size][gram[:-1]]
        if not t:
            return self.p(gram[1:])
        n = self.counts[size][gram]
        return max(n - self.discounts[size][min(n, 3) - 1], 0) / t * (n > 0) + self.weights[size][gram[:-1]] / t * self.p(gram[1:])


def models(rows):
    return {lang: KneserNey([fold(t) for _, t, x in rows if x == lang and t]) for lang in {x for *_, x in rows}}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_perplexity_and_bands_equal_brute_force(spark, docs, head):
    p = quality.QualityParams(head=head, width=2.0)
    model = quality.train(docs, p)
    assert len(model.head.hashes) <= head
    scored = quality.score_documents(docs, model)
    own = models(ROWS)
    want = {}
    for i, t, lang in ROWS:
        t = fold(t or "")
        grams = [t[k : k + N] for k in range(len(t) - N + 1)]
        want[i] = -sum(math.log(own[lang].p(g)) for g in grams) / len(grams) if grams else None
    rows = scored.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        got = r["quality"]["nats"]
        assert (got is None) == (want[r["doc_id"]] is None) and (got is None or abs(got - want[r["doc_id"]]) < 2e-6)
    limits = {r["model"]: (r["low"], r["high"]) for r in quality.bands(scored, p).collect()}
    verdicts = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(scored, quality.bands(scored, p), p).collect()}
    good = {i for i, (failed, _) in verdicts.items() if not failed}
    for lang in ("en", "ru", None):
        bins = [round(want[i] * 1000) for i, _, x in ROWS if x == lang and i in good and want[i] is not None]
        m = median(bins)
        spread = max(1.4826 * median(abs(b - m) for b in bins) / 1000, p.least_spread)
        low, high = limits["-" if lang is None else "=" + lang]
        assert abs(low - (m / 1000 - 2 * spread)) < 2e-3 and abs(high - (m / 1000 + 2 * spread)) < 2e-3
        assert all(verdicts[i][1] == (low <= want[i] <= high) for i, _, x in ROWS if x == lang and i in good)


def test_texts_that_the_model_has_not_seen(spark, docs):
    model = quality.train(docs)
    own = models(ROWS)
    for lang, t in (("en", "the words of zebra Ω quickly"), ("xx", "abcdef")):
        other = spark.createDataFrame([(1, t, lang)], "doc_id long, text string, lang string")
        got = quality.score_documents(other, model).first()["quality"]["nats"]
        t = fold(t)
        grams = [t[k : k + N] for k in range(len(t) - N + 1)]
        want = -sum(math.log(own[lang].p(g)) for g in grams) / len(grams) if lang in own else 0.0
        assert abs(got - want) < 5e-6


def test_probabilities_of_a_context_sum_to_one(docs):
    rows = quality.train(docs).levels[-1].groupBy("model", "context").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] < 1 + 1e-9 for r in rows)


@pytest.mark.parametrize("most, symbol_bits, buffer", [(1 << 19, 11, 1 << 21), (100, 11, 64), (1 << 19, 4, 64)])
def test_counting_tasks_with_full_lists(monkeypatch, most, symbol_bits, buffer):
    monkeypatch.setattr(quality.GramCounter, "SYMBOL_BITS", symbol_bits)
    counter = quality.GramCounter(most, buffer)
    out = []
    for _ in range(2):
        for words in quality.words_of(pa.array([t for _, t, _ in ROWS]), 700):
            out += counter.add(*quality.letters(words), [str(x) for *_, x in ROWS][words.first : words.first + words.n_texts])
    got = Counter()
    for b in [*out, *counter.flush()]:
        for m, g, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            got[m, g] += n
    want = Counter((str(x), fold(t)[i : i + N]) for _, t, x in ROWS * 2 if t for i in range(len(t) - N + 1))
    assert got == want


def test_no_bound_on_languages_and_labelled_junk(spark):
    many = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)), f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    assert quality.bands(quality.score_documents(many, quality.train(many))).count() == 40
    sf = "/root/testdata/sf0.01"
    r = quality.op1_quality_rules(spark, sf).filter("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = {(x["quality"], x["kept"]): x["count"] for x in r.groupBy("quality", "kept").count().collect()}
    assert kept.get((0, False), 0) >= kept.get((0, True), 0) * 0.5 and kept.get((1, False), 0) <= 0.02 * kept[1, True]
