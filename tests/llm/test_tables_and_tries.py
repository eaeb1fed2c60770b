import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from locusmill.llm import collocations, whitening, wordtable
from locusmill.llm.collocations import PhraseParams

NASTY = [
    None, "", " ", "\n\n  x", "don't can't 'tis 's 'S ''s we'll  they've\t\tI'm", "<|endoftext|>a<|endoftext|><|endoftext|> b", "<|endoftext", "  lead and trail  ", "a\r\n \n b\x0b\x0c\x85  c᠎d",
    "Ünïcödé ñ 日本語 テスト 🙂🙂 é ½ Ⅷ ١٢٣", "՘x꟎1 ՠ \U0003fc3b࢏z", "x" * 5000, "1234567890" * 40, "a b " * 3000, "don't can't 'tis", "!!!??? ... -- __", "\x00\x01 \x7f", "it's<|endoftext|>'s 're",
]


def test_bpe_equals_the_library(spark, monkeypatch):
    lib = Tokenizer.from_str(wordtable.tokenizer_text())
    rows = [(i, t, "clash", i, "own") for i, t in enumerate(NASTY)] + [(None, "null id", None, 1, None), (3, NASTY[3], "again", 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows string, block int, bpe string")
    for size in (8 << 20, 40):
        monkeypatch.setattr(wordtable, "BLOCK_CHARS", size)
        out = wordtable.encode_documents(docs, wordtable.tokenizer_text())
        assert out.columns == ["doc_id", "rows", "block", "bpe"]
        found = Counter((r["doc_id"], r["rows"], r["block"], r["bpe"]["n_tokens"], tuple(r["bpe"]["ids"]), r["bpe"]["decoded"]) for r in out.collect())
        want = Counter()
        for key, text, a, b, _ in rows:
            ids = lib.encode(text or "", add_special_tokens=False).ids
            want[key, a, b, len(ids), tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
        assert found == want
    only = wordtable.encode_documents(docs.select("text"), wordtable.tokenizer_text())
    assert only.columns == ["bpe"] and only.count() == len(rows)
    assert wordtable.encode_documents(docs.limit(0), wordtable.tokenizer_text()).count() == 0


def test_decoding_of_any_ids(spark):
    lib = Tokenizer.from_str(wordtable.tokenizer_text())
    ids = [[], [50256, 220], lib.encode("日本語 🙂").ids[1:], lib.encode("🙂").ids[:1] * 3, list(range(0, 50257, 997)), None]
    out = wordtable.decode_documents(spark.createDataFrame([(x, "own") for x in ids], "ids array<int>, decoded string"), wordtable.tokenizer_text())
    want = Counter((tuple(x), lib.decode(x, skip_special_tokens=False)) if x is not None else None for x in ids)
    assert Counter((tuple(r["ids"]), r["decoded"]) if r["ids"] is not None else None for r in out.collect()) == want
    assert out.filter("ids is null").first()["decoded"] is None


def test_characters_without_the_usual_class_are_found():
    bpe = wordtable.ByteBpe(wordtable.tokenizer_text())
    assert all(bpe.agrees(c) for c in "aÜ日١½  🙂'_") and not bpe.agrees("՘")


def test_other_tokenizers_are_an_error():
    with pytest.raises(ValueError, match="byte-level"):
        wordtable.ByteBpe('{"model": {}, "pre_tokenizer": {"type": "Whitespace"}}').library


def brute_phrases(rows, p):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, p.most_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {g: c for g, c in f.items() if c >= p.min_count}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        score, k = min((p.scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        around = [c for (g, v), c in f.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * c >= p.inside_percent * a for c in around):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    ranked, rank = set(), Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= p.top:
            ranked.add((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return ranked


@pytest.mark.parametrize("p", [PhraseParams(min_count=3, bucket_bits=6, shard=150, top=25), PhraseParams(min_count=2, bucket_bits=16, shard=1 << 18, most_words=5)])
def test_phrases_equal_brute_force(spark, p):
    rng = np.random.default_rng(5)
    stock = ["alpha", "Beta", "b", "ü", "日本", "x" * 70, "c-d", "A", "<b>"]
    rows = [(None, "en"), ("", None), (" \t\n.;", "en"), ("a a a a a a a a a a", "aa"), ("A a a.A", None), ("word " * 500, "en")]
    for i in range(60):
        rows.append(("".join(stock[int(x)] + [" ", "  ", "\t", " ", " ", ". ", "\n"][int(y)] for x, y in zip(rng.zipf(1.6, 40) % len(stock), rng.integers(0, 7, 40))), ["en", "fr", None][i % 3]))
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, phrase int, f string").repartition(3)
    out = collocations.top_phrases(collocations.mine_phrases(docs, p), p.top)
    found = [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_phrases(rows, p)
    assert collocations.mine_phrases(docs.limit(0), p).count() == 0


def test_rare_phrases_are_no_candidates_however_many_there_are(spark, monkeypatch):
    rng = np.random.default_rng(29)
    rows = [(" ".join(f"w{int(x)}" for x in rng.integers(0, 200, 100)) + " . three words together",) for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string").selectExpr("text", "'en' AS lang").repartition(3)
    seen, tries = [], collocations.tries
    monkeypatch.setattr(collocations, "tries", lambda numbered: seen.append(numbered.count()) or tries(numbered))
    out = collocations.mine_phrases(docs, PhraseParams(min_count=12, bucket_bits=6)).collect()
    # some 200 words and the three words' parts are frequent; 10 thousand n-grams are not
    assert [r["phrase"] for r in out] == ["three words together"] and seen[0] <= 400


def test_shards_are_counted_together(spark, monkeypatch):
    """As many tries as ``together`` allows take one pass over the texts, also where one word's phrases lie in several."""
    rng = np.random.default_rng(37)
    rows = [(" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) % 12), ["en", "fr"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    written, materialise = [], collocations.materialise
    monkeypatch.setattr(collocations, "materialise", lambda df, name: written.append((name, df.count() if name == "tries" else 0)) or materialise(df, name))
    for p, most in ((PhraseParams(min_count=3, bucket_bits=8, shard=7), 1), (PhraseParams(min_count=3, bucket_bits=8, shard=60, together=150), 8)):
        written.clear()
        out = collocations.top_phrases(collocations.mine_phrases(docs, p), p.top).collect()
        assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out} == brute_phrases(rows, p)
        built = next(n for name, n in written if name == "tries")
        passes = sum(name == "shard-counts" for name, _ in written)
        assert passes <= most and built > passes, (passes, built)


def test_packed_counts_come_back(spark):
    rng = np.random.default_rng(31)
    values = np.append(rng.integers(0, 1 << 36, 5000, dtype=np.uint64), [0, (1 << 36) - 1]).astype(np.uint64)
    found = collocations.added(np.concatenate([values, values[:100], values[:50]]) << np.uint64(28) | np.uint64(1), 2)
    assert len(found) == len(np.unique(values)) and (found & np.uint64(3) == 2).sum() == 100
    for counter in (np.dtype(np.uint8), np.dtype(np.uint16)):
        back = [(np.uint64(s) << np.uint64(26 + 28)) + collocations.unpack_counts(c, counter) for s, c in collocations.pack_counts(found, counter)]
        assert np.array_equal(np.concatenate(back), found)


def test_trie_holds_exactly_its_phrases():
    rng = np.random.default_rng(3)
    phrases = sorted({" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(k)) % 300) for k in rng.integers(1, 5, 4000)})
    t = collocations.build_trie(pa.array(phrases))
    words = t["words"].to_pylist()
    number = {w: i + 1 for i, w in enumerate(words)}
    base, check = t["base"].astype(np.int64), t["check"]
    for i, phrase in enumerate(phrases):
        state = 0
        for w in phrase.split():
            for d in collocations.digits(np.array(number[w]), t["side"]):
                to = base[state] + d
                assert check[to] == state
                state = to
        assert t["accept"][state] == i
    assert (t["accept"] >= 0).sum() == len(phrases)


def dense(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    _, sd, w = np.linalg.svd((n * fit - s) / n)
    e, w = np.pad(sd, (0, x.shape[1] - len(sd))) ** 2 / n, w.T
    keep = [i for i in range(min(16, len(e))) if e[i] > 1e-20 * e[0]]
    z = ((n * x - s) / n) @ w[:, keep] / np.sqrt(e[keep])
    squares = [sum(int(a) ** 2 for a in row) for row in n * x - s]
    return n, [a if a < 1 << 63 else None for a in squares], z, e[keep] / e.sum()


@pytest.mark.parametrize("kind", ["plain", "narrow", "rank"])
def test_whitening_equals_dense_algebra(spark, kind):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 20)) * np.linspace(3, 1, 20)
    if kind == "narrow":
        m = m * np.logspace(5, -1, 20)
    if kind == "rank":
        m[:, 4], m[:, 7] = 0.25, m[:, 9]
    m = m.astype(np.float32).tolist() + m[:5].astype(np.float32).tolist()
    bad = [None, [], [None] * 20, [float("nan")] + [0.0] * 19, [float("inf")] + [0.0] * 19, [0.0] * 19, [1e30] * 20]
    df = spark.createDataFrame([(i, v, "x", 2) for i, v in enumerate(m)] + [(100 + i, v, "x", 2) for i, v in enumerate(bad)], "vec_id long, embedding array<float>, x string, n int")
    rows = sorted(whitening.whiten_embeddings(df).collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, deviation, z, explained = dense(m)
    k = z.shape[1]
    assert k == (16 if kind != "narrow" else k) and len(rows) == len(m) * k
    got = np.array([r["whitened"] for r in rows]).reshape(len(m), k)
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in rows)
    assert [r["component"] for r in rows[:k]] == list(range(1, k + 1))
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-6)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9
    assert np.allclose(got * np.sign((got * z).sum(0)), z, atol=1e-5 if kind == "narrow" else 1e-9)


def test_whitening_of_few_and_equal_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten_embeddings(table(rows)).count() == 0
    two = whitening.whiten_embeddings(table([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted(abs(r["whitened"]) for r in two) == pytest.approx([1, 1, 1]) and {r["component"] for r in two} == {1}
    far = whitening.whiten_embeddings(table([(i, [2.0**40 * i, 1.0]) for i in range(3)])).collect()
    assert {r["vec_id"]: r["deviation"] for r in far} == {0: None, 1: 0, 2: None}


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in wordtable.op12_word_table(spark, str(tmp_path)).collect()}
    ids = Tokenizer.from_str(wordtable.tokenizer_text()).encode("a b", add_special_tokens=False).ids
    assert rows[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and rows[1]["n_tokens"] == len(ids)
    assert rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["n_tokens"] == 0
