import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest

from locusmill.llm import pii


def spans(text, kind):
    return [text[a:b] for a, b, k in pii.find_spans(text) if k == kind]


@pytest.mark.parametrize(
    "text, want",
    [
        ("pay DE89 3704 0044 0532 0130 00 now", "DE89 3704 0044 0532 0130 00"),
        ("IBAN no. DE89370400440532013000", "DE89370400440532013000"),
        ("IBANGB82WEST12345698765432", "GB82WEST12345698765432"),
        ("IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "ES91 2100 0418 4502 0005 1332"),
        ("Überweisung ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332"),
    ],
)
def test_ibans_with_and_without_a_cue(text, want):
    assert spans(text, "iban") == [want]
    assert want not in pii.redact(text, pii.find_spans(text))


@pytest.mark.parametrize("text", ["DE88 3704 0044 0532 0130 00", "XDE89370400440532013000", "DE893704004405320130001", "DE89 3704 0044"])
def test_no_iban(text):
    assert spans(text, "iban") == []


@pytest.mark.parametrize("cue", ["API Key", "Api Key", "API_Key", "PassWord", "apiKey", "ToKen", "é İ Api_Key"])
def test_cues_in_any_case(cue):
    assert spans(f"{cue}: abcdef0123456789abcd", "secret") == ["abcdef0123456789abcd"]
    assert spans("AcCount No. 12345678", "account") == ["12345678"]


def brute_base(text):
    """The four base patterns of the contract, applied as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_of_all_documents_and_of_noise_equal_brute_force(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = pii.op9_anchor_expansion(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r["doc_id"]])
        n = Counter(k for k, *_ in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    rng = np.random.default_rng(4)
    for _ in range(1500):
        t = "".join("0123459.@+- (a%é"[int(i)] for i in rng.integers(0, 16, int(rng.integers(1, 60))))
        assert [(k, a, b) for a, b, k in pii.find_spans(t) if k in pii.BASE_KINDS] == brute_base(t)


@pytest.mark.parametrize("t", ["1" * 1_000_000, "1." * 500_000, "a." * 500_000, "+1" * 500_000])
def test_very_long_runs_take_linear_time(t):
    began = time.time()
    pii.find_spans(t)
    assert time.time() - began < 2


def test_own_columns_of_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "own", "r", 3), (1, "mail a@b.org", "own", "r", 3), (2, None, None, None, None)], "doc_id long, text string, pii string, row string, n_chars int")
    out = pii.redact_documents(docs)
    assert out.schema == docs.schema
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "mail [EMAIL]", "own", "r", 12)] * 2 + [(2, None, None, None, None)]))
