"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

``find_pii`` adds a ``spans`` column: array of (kind, start, end, score, base) in code points, ``end`` exclusive,
ordered by kind as in KINDS, then by start. The four base kinds are always kept once their own check holds. The
further kinds are proposed by looser patterns and kept only if a checksum or a nearby context word lifts their
score to ``min_score``.

Defined cases: null text counts as empty (no spans); repeated rows and ties are scanned one by one; very long
texts are scanned whole in linear time; a column named ``spans`` is replaced, all others are kept; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.llm.common import named

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_spaced", "ip6", "national_id", "local_phone")

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False),
    T.StructField("score", T.DoubleType(), False), T.StructField("base", T.BooleanType(), False),
]), False)

# Patterns with possessive repeats and a look-behind, so that no run of characters is scanned twice.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_CARD_SPACED = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])|(?<![0-9 -])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(). -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

# Lengths of account numbers by country, and the context words of each kind.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "address", "server", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "card_spaced": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "ip6": ("ip", "ipv6", "host", "address"),
    "national_id": ("ssn", "social", "security", "national", "identity"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
}
#: Score before context, and what a context word within WINDOW characters adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "card_spaced": 0.4, "ip6": 0.6, "national_id": 0.3, "local_phone": 0.3}
BONUS, WINDOW = 0.3, 40
_CONTEXT_WORD = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z])") for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """True if the account number's check digits hold (remainder 1)."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # nothing before it can belong to a further match
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, m.start() + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + length
            at += length + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        want = IBAN_LENGTHS.get(m[0][:2], 0)
        end, seen = m.start(), 0
        while seen < want and end < m.end():
            seen += text[end] != " "
            end += 1
        if want and seen == want and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end


def _spaced_cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD_SPACED.finditer(text):
        if luhn(_digits(m[0])):
            yield m.span()


def _plain(pattern: re.Pattern) -> object:
    return lambda text: (m.span() for m in pattern.finditer(text))


_PROPOSE = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "card_spaced": _spaced_cards, "ip6": _plain(_IP6),
    "national_id": _plain(_NATIONAL), "local_phone": _plain(_LOCAL_PHONE),
}


def spans_of(text: str, min_score: float = 0.5) -> list[dict]:
    found, taken = [], []
    for kind in KINDS:
        base = kind in BASE_KINDS
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for start, end in _PROPOSE[kind](text):
            if not base and any(s < end and start < e for s, e in taken):
                continue  # a confirmed span has these characters already
            near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
            score = min(1.0, PRIOR[kind] + (BONUS if _CONTEXT_WORD[kind].search(near) else 0.0))
            if base or score >= min_score:
                found.append({"kind": kind, "start": start, "end": end, "score": score, "base": base})
                taken.append((start, end))
    return found


def find_pii(df: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """All columns but the text, with ``spans`` added; the texts stay in their tasks."""
    others = [f for f in df.schema.fields if f.name not in ("spans", text_col)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([spans_of(t.as_py() or "", min_score) for t in batch.column(0)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], spans], [*(f.name for f in others), "spans"])

    texts_first = df.select(F.col(text_col), *(named(f.name) for f in others)).toDF(*(f"c{i}" for i in range(len(others) + 1)))
    return texts_first.mapInArrow(scan, T.StructType([*others, T.StructField("spans", SPANS)]))


def _joined(only_base: bool):
    spans = F.filter("spans", lambda s: s["base"]) if only_base else F.col("spans")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans, best score."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
