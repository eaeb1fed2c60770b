"""Personal data by anchor expansion (operator 9).

One Aho-Corasick automaton finds at-signs, schemes and identifier cues; small deterministic
parsers expand each anchor to the boundaries of an email, an address or an account and
validate it. Runs of digits (ip, card, phone) are anchored on digits and plus signs.

Base kinds: email, ip, card, phone, as leftmost non-overlapping matches that are dropped
where they fail validation. Added kinds, which never remove or change a base span:
``url`` (scheme to the last url character, with a host), ``iban`` (two letters and two
digits at a word boundary, after a cue or not, of its country's length and valid modulo 97;
a country without a known length needs the cue), ``account`` (digits after an account cue)
and ``secret`` (a long token after a credential cue).

Spans are code point offsets, end exclusive, ordered by start, then kind as listed.
Defined cases: null and empty texts have no spans; a very long text is scanned as a whole,
once; repeated rows are scanned alike; an empty table gives an empty result; other columns
pass through, and columns that clash with the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "account", "secret")
KINDS = BASE_KINDS + MORE_KINDS
_RANK = {k: i for i, k in enumerate(KINDS)}

# Cues that announce an identifier, in any case of their ASCII letters.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key")
#: Length of an account number by its country, as the IBAN registry has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# possessive and from the start of a run of digits, so that a long run is read once; the matches are the same
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?i)(?:(?:https?|ftp)://[a-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"'|]*)?|mailto:[^\s<>\"'|]+)")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_CUE = re.compile(r"(?i)iban[^a-z0-9]*(?:(?:no|nr|num|number|code)[^a-z0-9]+)?$")
_IBAN = re.compile(r"[A-Z0-9](?: ?[A-Z0-9]){14,33}")
_ACCOUNT = re.compile(r"(?i)(?:\s*(?:number|no\.?|nr\.?|#))?\s*[:=#]?\s*([0-9](?:[ -]?[0-9]){4,18})(?![0-9])")
_SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/]{16,}={0,2})")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


_LOWER = {i: i + 32 for i in range(65, 91)}
_ANCHORS: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """End of the account number that starts at ``at``; 0 where none does.

    A known country has one length; for others every end of a group is tried, the longest first.
    """
    m = _IBAN.match(text, at)
    if not m:
        return 0
    cue = _IBAN_CUE.search(text[max(at - 24, 0) : at])
    inside = at > 0 and re.match("[A-Za-z0-9]", text[at - 1])
    places = [i for i in range(at, m.end()) if text[i] != " "]
    known = IBAN_LENGTHS.get(text[at : at + 2])
    if not cue and (inside or not known):
        return 0
    for n in [known] if known else range(len(places), 14, -1):
        if n > len(places):
            continue
        end = places[n - 1] + 1
        if not re.match("[A-Za-z0-9]", text[end : end + 1]) and iban_valid(text[at:end]):
            return end
    return 0


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), ordered."""
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    spans, taken = [], 0  # taken: end of the last email match
    more: dict[str, int] = {}
    for last, (kind, size) in _ANCHORS[0].iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        at = last - size + 1
        if kind == "email":
            if at < taken:
                continue
            start = at
            while start > taken and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at)
            if m and start < at:
                spans.append((start, m.end(), "email"))
                taken = m.end()
            continue
        if at < more.get(kind, 0):
            continue
        if kind == "url":
            m = _URL.match(text, at)
            if m:
                end = m.end()
                while text[end - 1] in ".,;:!?)]}":
                    end -= 1
                spans.append((at, end, kind))
                more[kind] = m.end()
            continue
        m = {"account": _ACCOUNT, "secret": _SECRET}[kind].match(text, last + 1)
        if m:
            spans.append((m.start(1), m.end(1), kind))
            more[kind] = m.end()
    taken = 0
    for m in _IBAN_START.finditer(text):
        end = iban_end(text, m.start()) if m.start() >= taken else 0
        if end:
            spans.append((m.start(), end, "iban"))
            taken = end
    for m in _IP.finditer(text):
        # a part of any length is compared as a number without building one
        if all(len(x.lstrip("0")) < 3 or (len(x.lstrip("0")) == 3 and x.lstrip("0") <= "255") for x in m[0].split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), m.end(), "phone"))
    spans.sort(key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every span, or union of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean string"


def _scan(column: pa.Array, clean: bool) -> pa.StructArray:
    rows: list[list] = [[] for _ in range(7)]
    for value in column:
        own = value.as_py() or ""
        spans = find_spans(own)
        base = [s for s in spans if s[2] in BASE_KINDS]
        for i, kind in enumerate(BASE_KINDS):
            rows[i].append(sum(s[2] == kind for s in base))
        rows[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
        rows[5].append(joined(spans))
        rows[6].append(redact(own, spans) if clean else None)
    types = [pa.int64()] * 4 + [pa.string()] * 3
    return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], [x.split()[0] for x in _OUT.split(", ")])


def scan_documents(docs: DataFrame, text: str = "text", clean: bool = True, each: int = 256) -> DataFrame:
    """docs with column ``pii``: counts, spans and, if asked for, the redacted text; ``each`` rows leave a task at a time."""
    own = docs.drop("pii").withColumn(text, F.col(text).cast("string"))
    place = own.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, each):
                part = batch.slice(i, each)
                yield pa.RecordBatch.from_arrays([*part.columns, _scan(part.column(place), clean)], [*part.schema.names, "pii"])

    return own.mapInArrow(run, StructType([*own.schema.fields, *StructType().add("pii", StructType.fromDDL(_OUT)).fields]))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in ``text`` (null stays null) and ``n_chars`` of the new text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    out = scan_documents(rows)
    clean = F.when(F.col("text").isNotNull(), F.col("pii.clean"))
    new = {"text": clean, "n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_documents(docs, clean=False)
    return out.select("doc_id", *[F.col(f"pii.{c}").alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])
