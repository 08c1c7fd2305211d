"""Operator 2: personal data found by pattern, checksum and context.

Patterns propose spans, validators (Luhn for cards, mod 97 for IBANs, ranges for
addresses, digit counts for telephone numbers) confirm or refute them, and words
within ``CONTEXT_CHARS`` of a span raise or lower its score. The four base kinds
are reported whatever their context; every further span needs ``MIN_SCORE``.

Defined results: a null text is an empty one and has no spans; repeated rows give
repeated results; other columns, whatever their names, pass through untouched;
offsets count code points and the end is exclusive. Each search is linear in the
length of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import bounded_batches, fresh, whole_text

#: Order among spans that start at the same place.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 48
MIN_SCORE = 0.6
SPAN_TYPE = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("score", T.DoubleType())
    .add("base", T.BooleanType())
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)] )(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_GROUP = re.compile(r"[0-9]+")

#: Words that speak for or against a kind when they stand nearby.
FOR = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "mastercard", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "handy", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = {
    "email": (),
    "ip": ("version", "release", "section"),
    "card": ("order", "invoice", "isbn", "serial", "tracking", "version"),
    "phone": ("isbn", "invoice", "version"),
    "iban": ("serial", "hash"),
    "ssn": ("part", "serial", "order", "invoice"),
}
_NEAR = re.compile(r"[^\W\d_]+|@")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of an IBAN without blanks hold."""
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each "@"."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _digits(span: str) -> str:
    return "".join(_GROUP.findall(span))


def _base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _DIGIT_RUN.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(number := _digits(m[0])) <= 19 and luhn(number):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _further(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Proposals beyond the base kinds with the score they have before context."""
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span(), 0.8
    for m in _DIGIT_RUN.finditer(text):
        if m.end() - m.start() > 19:  # a card number that stands in a row with other numbers
            for g in _GROUP.finditer(text, m.start(), m.end()):
                if len(g[0]) in (15, 16) and g[0][0] in "3456" and luhn(g[0]):
                    yield "card", *g.span(), 0.7
    for m in _LOCAL_PHONE.finditer(text):
        yield "phone", *m.span(), 0.4
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), 0.4


def _context(text: str, kind: str, start: int, end: int) -> float:
    """What nearby words add to a score: 0.3 for, -0.3 against."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    near = {w.lower() for w in _NEAR.findall(near)}
    return 0.3 * any(w in near for w in FOR[kind]) - 0.3 * any(w in near for w in AGAINST[kind])


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text as (kind, start, end, score, base), by start and kind."""
    base = _base(text)
    spans = [(k, a, b, min(1.0, max(0.0, 0.9 + _context(text, k, a, b))), True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, a, b, score in _further(text):
        score = min(1.0, score + _context(text, kind, a, b))
        if score >= MIN_SCORE and not _overlaps(begins, reach, a, b):
            spans.append((kind, a, b, score, False))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _overlaps(begins: list[int], reach: list[int], a: int, b: int) -> bool:
    """Whether a base span overlaps [a, b): of those that begin before b, one ends after a."""
    before = bisect_left(begins, b)
    return before > 0 and reach[before - 1] > a


@F.pandas_udf(SPAN_TYPE)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([find_spans(t) for t in texts], dtype=object)


def pii_spans(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, score, base)."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _spans(whole_text(text_col)))


def redact(text: str, spans: list) -> str:
    """The text with each span, or run of overlapping spans, replaced by <KIND>."""
    parts, at = [], 0
    for s in spans:
        kind, start, end = s[0], s[1], s[2]
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else redact(t, find_spans(t)) for t in texts], dtype=object)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced by its kind; null stays null."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text_col, _redacted(F.col(text_col).cast("string")))


def _written(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts and digest of base spans and the list of all spans."""
    (found,) = fresh(docs, "pii_spans")
    spans = pii_spans(docs.select(id_col, text_col), text_col, found)
    base = F.filter(F.col(found), lambda s: s["base"])
    count = lambda kind: F.size(F.filter(F.col(found), lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return spans.select(
        F.col(id_col).alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col(found)).alias("spans"),
    )
