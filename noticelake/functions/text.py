"""Text normalisation with maps between original and normalised positions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMALIZER_VERSION = "1.0"
#: Full-width forms and the characters that they stand for: U+3000 and the shifted ASCII range.
WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
BLANKS = frozenset(" \t\r\f\v")

#: What makes places move: other blanks than a single one between characters of a line.
_MOVES = re.compile(r"[\t\r\f\v]|  |\A | \Z|\n | \n")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

NORMALIZED = (
    T.StructType()
    .add("text", T.StringType())
    .add("forward", T.ArrayType(T.IntegerType()))
    .add("reverse", T.ArrayType(T.IntegerType()))
)


def halfwidth(column: str | Column) -> Column:
    """Full-width letters, digits and signs to ASCII, in Spark functions only."""
    return F.translate(column, WIDE, NARROW)


def normalize_lite(column: str | Column) -> Column:
    """Normalisation without compatibility forms beyond full width: for filters that must stay in the JVM."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.translate(halfwidth(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " "), "(^|\\n) ", "$1")
    return F.regexp_replace(text, " (\\n|\\z)", "$1")


@lru_cache(maxsize=65_536)
def _folded(char: str) -> str:
    """Compatibility form of one character, its ASCII capitals in lower case."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in unicodedata.normalize("NFKC", char)) if char not in BLANKS else char


@dataclass(frozen=True)
class Normalized:
    """Normalised text; ``forward`` gives the original place of each of its characters,
    ``reverse`` its place for each original one, -1 where nothing or only a blank is left."""

    text: str
    forward: Sequence[int]
    reverse: Sequence[int]

    def to_normalized(self, start: int, end: int) -> tuple[int, int]:
        """Normalised range of an original one: dropped ends are passed over inwards."""
        size = len(self.reverse)
        start, end = max(0, min(start, size)), max(0, min(end, size))
        first = next((self.reverse[i] for i in range(start, size) if self.reverse[i] >= 0), len(self.text))
        last = next((self.reverse[i] + 1 for i in range(end - 1, -1, -1) if self.reverse[i] >= 0), 0)
        first, last = int(first), int(last)
        return first, max(first, last) if end > start else first

    def to_raw(self, start: int, end: int) -> tuple[int, int]:
        """Original range of a normalised one."""
        if not len(self.forward) or end <= start:
            return 0, 0
        start, end = max(0, min(start, len(self.forward) - 1)), max(1, min(end, len(self.forward)))
        return int(self.forward[start]), int(self.forward[end - 1]) + 1


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def folded(raw: str) -> Normalized:
    """normalize() with its places as arrays of 32-bit integers, which take a tenth of a list's memory.

    A text that only has capitals to fold keeps all its places and is not walked through.
    """
    if not _MOVES.search(raw) and unicodedata.is_normalized("NFKC", raw):
        normal, places = raw.translate(_LOWER), np.arange(len(raw), dtype=np.int32)
        return Normalized(normal, places, places if normal == raw else np.where(code_points(raw) == ord(" "), np.int32(-1), places))
    text, forward, blank = [], [], -1  # blank: where a run of blanks inside a line began
    for at, char in enumerate(raw):
        for c in _folded(char):
            if c in BLANKS:
                if blank < 0 and text and text[-1] != "\n":
                    blank = at
                continue
            if c == "\n":
                blank = -1
            elif blank >= 0:
                text.append(" ")
                forward.append(blank)
                blank = -1
            text.append(c)
            forward.append(at)
    normal, places = "".join(text), np.array(forward, dtype=np.int32)
    if normal == raw:
        return Normalized(normal, places, np.arange(len(raw), dtype=np.int32))
    told = np.flatnonzero(code_points(normal) != ord(" ")).astype(np.int32)
    # Of the characters that an original one becomes the first counts.
    origins, first = np.unique(places[told], return_index=True)
    reverse = np.full(len(raw), -1, dtype=np.int32)
    reverse[origins] = told[first]
    return Normalized(normal, places, reverse)


def normalize(raw: str) -> Normalized:
    """Fold each character, trim each line, make one blank of a run of blanks; keep line ends."""
    done = folded(raw)
    return Normalized(done.text, done.forward.tolist(), done.reverse.tolist())


#: Characters of the texts that a worker holds results for at a time; a longer text is held alone.
HELD_CHARS = 500_000


def held(batches: Iterator[pa.Array | tuple[pa.Array, ...]], chars: int = HELD_CHARS) -> Iterator[list]:
    """The rows of Arrow batches in order, in lists of at most ``chars`` characters of their first column."""
    for batch in batches:
        rows, size = [], 0
        for row in zip(*batch) if isinstance(batch, tuple) else batch:
            value = tuple(v.as_py() for v in row) if isinstance(batch, tuple) else row.as_py()
            n = len((value[0] if isinstance(batch, tuple) else value) or "")
            if rows and size + n > chars:
                yield rows
                rows, size = [], 0
            rows.append(value)
            size += n
        if rows:
            yield rows


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def normalize_text() -> object:
    """Arrow function of a text column: struct of text, forward and reverse; null counts as empty."""

    @F.arrow_udf(NORMALIZED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in held(batches):
            done = [folded(t or "") for t in texts]
            columns = [pa.array([d.text for d in done], pa.string()), _lists([d.forward for d in done]), _lists([d.reverse for d in done])]
            yield pa.StructArray.from_arrays(columns, names=NORMALIZED.names)

    return run


def normalized_value(column: str | Column) -> Column:
    """A value for comparison: trimmed, half-width, lower case, numbers without commas."""
    value = F.lower(halfwidth(F.trim(column)))
    return F.when(value.rlike("^[0-9,]+\\.?[0-9]*$"), F.replace(value, F.lit(","), F.lit(""))).otherwise(value)


def bigrams(column: Column) -> Column:
    """Two-character grams in order, with repeats; a single character is its own gram."""
    long_enough = F.length(column) > 1
    grams = F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(column, i, F.lit(2)))
    return F.when(long_enough, grams).when(F.length(column) == 1, F.array(column)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays taken as sets; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def clean_body(column: Column, noise: str = "^(分享|打印|关闭|相关公告)", end: str = "^(附件|相关附件|免责声明)") -> Column:
    """Body of a notice: from its first "## " line to the earliest end marker, without noise and blank lines."""
    body = F.when(F.contains(column, F.lit("## ")), F.substring(column, F.locate("## ", column), F.length(column))).otherwise(column)
    lines = F.split(body, "\n")
    stop = F.array_min(F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(end), i)), lambda i: i.isNotNull()))
    kept = F.slice(lines, 1, F.coalesce(stop, F.size(lines)))
    return F.array_join(F.filter(kept, lambda l: ~l.rlike(noise) & (F.trim(l) != "")), "\n")
