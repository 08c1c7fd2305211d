"""Location of quoted evidence in source texts by a cascade of ever looser matches.

Levels: the exact quote; the quote without white space; also without punctuation; its
longest telling part. Levels two and three search the normalised text, while the quote
only loses its white space and punctuation. Offsets count code points of the source,
the end is exclusive. ``exact_spans`` and ``slice_agrees`` are Spark functions only;
the cascade needs position maps and runs as a pandas function, one index per text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.functions.text import Normalized, code_points, folded

#: Level, confidence and support of a match (fixed values).
LEVELS = {"exact": (1.0, "direct"), "stripped": (0.9, "equivalent"), "no_punct": (0.8, "inferred"), "substring": (0.6, "inferred"), "not_found": (0.0, "unsupported")}
CONTEXT = 40
MOST_PARTS = 15
#: Punctuation: CJK signs, full-width forms, ASCII signs, quotation marks, ellipsis.
SIGNS = "　-〿＀-￯!-/:-@\\[-`{-~‘-‟…"
_SIGN = re.compile(f"[{SIGNS}]")
#: White space, and white space and signs, by code point; the last entry stands for all beyond, which are neither.
_BLANK = np.array([chr(c).isspace() for c in range(0xFFFF)] + [False])
_BLANK_OR_SIGN = _BLANK | np.array([bool(_SIGN.match(chr(c))) for c in range(0xFFFF)] + [False])
_PARTS = re.compile(rf"[\s{SIGNS}]+")
_LOOSE = re.compile("[\\s　-〿＀-￯‘-‟…]+")
_CODE = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-]{2,}[A-Za-z0-9]")
_AMOUNT = re.compile(r"\d+(?:\.\d+)?\s*(?:万元|亿元|元|万|亿)")

LOCATION = (
    T.StructType()
    .add("found", T.BooleanType())
    .add("level", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("text", T.StringType())
    .add("confidence", T.DoubleType())
    .add("support_level", T.StringType())
    .add("normalized_start", T.IntegerType())
    .add("normalized_end", T.IntegerType())
)


@dataclass(frozen=True)
class Index:
    """A source text with the places in its normalised text of the characters that each level looks at."""

    raw: str
    normal: Normalized
    solid: str
    solid_at: np.ndarray
    bare: str
    bare_at: np.ndarray


def _left(text: str, points: np.ndarray, out: np.ndarray) -> tuple[str, np.ndarray]:
    """A text without the characters that ``out`` tells by code point, all below its size, and the places of the others."""
    kept = np.flatnonzero(~out[np.minimum(points, len(out) - 1)]).astype(np.int32)
    return text if len(kept) == len(text) else points[kept].tobytes().decode("utf-32-le", "surrogatepass"), kept


@lru_cache(maxsize=8)
def index(raw: str) -> Index:
    normal = folded(raw)
    points = code_points(normal.text)
    solid, solid_at = _left(normal.text, points, _BLANK)
    bare, bare_at = _left(normal.text, points, _BLANK_OR_SIGN)
    return Index(raw, normal, solid, solid_at, bare, bare_at)


def telling_parts(quote: str) -> list[str]:
    """Parts of a quote to look for on their own, the longest first."""
    parts = [p for p in _PARTS.split(quote) if len(p) >= 2]
    parts += [m for m in _CODE.findall(quote) if len(m) >= 4]
    parts += [s for p in _LOOSE.split(quote) if len(s := p.strip("!-/:-@[-`{-~")) >= 4]
    parts += [m for m in _AMOUNT.findall(quote) if len(m) >= 4]
    parts = list(dict.fromkeys(parts))
    if len(parts) <= 1 and len(quote) >= 6:
        width = min(len(quote) - 2, max(6, len(quote) // 2))
        parts += [quote[i : i + width] for i in range(0, len(quote) - width + 1, max(1, width // 3)) if width >= 4]
    return sorted(dict.fromkeys(parts), key=len, reverse=True)[:MOST_PARTS]


def _in_view(view: str, places: np.ndarray, normal: Normalized, wanted: str, search_from: int) -> tuple[int, int, int, int] | None:
    """First or, if that lies before ``search_from``, second match in a view: original and normalised range."""
    at = view.find(wanted) if wanted else -1
    for _ in range(2):
        if at < 0:
            return None
        first, last = int(places[at]), int(places[at + len(wanted) - 1]) + 1
        start, end = normal.to_raw(first, last)
        if start >= search_from:
            return start, end, first, last
        at = view.find(wanted, at + 1)
    return None


def locate(raw: str, quote: str, search_from: int = 0, levels: tuple[str, ...] = ("exact", "stripped", "no_punct", "substring")) -> tuple:
    """(found, level, start, end, text, confidence, support, normalised start and end) of a quote."""
    if not raw or not quote or not quote.strip():
        return False, "not_found", -1, -1, "", *LEVELS["not_found"], -1, -1

    def result(level: str, start: int, end: int, norm: tuple[int, int] | None = None) -> tuple:
        return True, level, start, end, raw[start:end], *LEVELS[level], *(norm or index(raw).normal.to_normalized(start, end))

    if "exact" in levels and (at := raw.find(quote, search_from)) >= 0:
        return result("exact", at, at + len(quote))
    there, solid = index(raw), re.sub(r"\s+", "", quote)
    if "stripped" in levels and (hit := _in_view(there.solid, there.solid_at, there.normal, solid, search_from)):
        return result("stripped", hit[0], hit[1], hit[2:])
    if "no_punct" in levels and (hit := _in_view(there.bare, there.bare_at, there.normal, _SIGN.sub("", solid), search_from)):
        return result("no_punct", hit[0], hit[1])
    if "substring" in levels:
        for part in telling_parts(quote):
            if (at := raw.find(part, search_from)) >= 0:
                return result("substring", at, at + len(part))
    return False, "not_found", -1, -1, "", *LEVELS["not_found"], -1, -1


def locate_column() -> object:
    """Pandas function of (text, quote): the location struct; nulls count as empty."""

    @F.pandas_udf(LOCATION)
    def run(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate(t or "", q or "") for t, q in zip(texts, quotes, strict=True)], columns=LOCATION.names)

    return run


def locate_batch_column() -> object:
    """Pandas function of (text, array of quotes): locations in order, each search from the end of the last hit."""

    @F.pandas_udf(T.ArrayType(LOCATION))
    def run(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        out = []
        for text, listed in zip(texts, quotes, strict=True):
            at, found = 0, []
            for quote in listed if listed is not None else []:
                found.append(hit := locate(text or "", quote or "", at))
                at = hit[3] if hit[0] else at
            out.append(found)
        return pd.Series(out, dtype=object)

    return run


def exact_spans(text: Column, quote: Column) -> Column:
    """struct(start, end) of the first exact occurrence; -1 where there is none."""
    at = F.position(quote, text) - 1
    found = (F.length(quote) > 0) & (at >= 0)
    return F.struct(F.when(found, at).otherwise(-1).alias("start"), F.when(found, at + F.length(quote)).otherwise(-1).alias("end"))


def occurrences(text: Column, quote: Column, most: int = 20) -> Column:
    """Starts of the non-overlapping exact occurrences, in Spark functions: lengths between cuts add up."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), quote, F.lit("\\E")))
    count = F.least(F.size(pieces) - 1, F.lit(most))
    before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * F.length(quote)
    none = F.array().cast("array<int>")
    return F.when((F.length(quote) > 0) & (count > 0), F.transform(F.sequence(F.lit(1), count), before)).otherwise(none)


def overlapping_occurrences(text: Column, quote: str) -> Column:
    """Number of places of a quote in the whole text, overlapping ones too; 0 for a null text or an empty quote."""
    if not quote:
        return F.lit(0)
    escaped = "".join(f"\\x{{{ord(c):x}}}" for c in quote)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?={escaped})"))


def slice_agrees(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether the slice is the quote, up to blanks at its ends; out-of-range slices are not."""
    piece = F.substring(text, start + 1, end - start)
    bounds = (start >= 0) & (end > start) & (end <= F.length(text))
    return F.coalesce(bounds & ((piece == quote) | (F.trim(piece) == F.trim(quote))), F.lit(False))


def context(text: Column, start: Column, end: Column, chars: int = CONTEXT) -> Column:
    """struct(before, after): up to ``chars`` characters around a span."""
    low = F.greatest(F.lit(0), start - chars)
    return F.struct(F.substring(text, low + 1, start - low).alias("before"), F.substring(text, end + 1, F.lit(chars)).alias("after"))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over hull of two ranges, 0 when they are apart."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return F.when(shared > 0, shared / (F.greatest(a_end, b_end) - F.least(a_start, b_start))).otherwise(0.0)


def best_overlap(found: DataFrame, gold: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """``found`` spans with the best overlap with a gold span of the same keys, and whether it matches."""
    pairs = found.join(gold.select(*keys, F.col("start").alias("g_start"), F.col("end").alias("g_end")), keys, "left")
    share = F.max(F.coalesce(iou(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end")), F.lit(0.0)))
    return pairs.groupBy(*found.columns).agg(share.alias("iou")).withColumn("matched", F.col("iou") >= least)
