"""Table functions: places of a quote and facts of a text as rows, for FROM and LATERAL in SQL.

``occurrences(text, quote, most)`` is a scalar-argument function for LATERAL joins.
``facts(TABLE(t), text => name)`` takes a whole table, partitioned as the caller says;
its schema is made when the query is analysed, from the columns of that table, all of which
come back beside the facts. Nulls give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from noticelake.operators.facts import PATTERNS

_PATTERNS = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}


@udtf(returnType="number int, start int", useArrow=True)
class Occurrences:
    """Starts of the non-overlapping places of a quote, at most ``most`` of them."""

    def eval(self, text: str | None, quote: str | None, most: int | None = 20) -> Iterator[tuple[int, int]]:
        at = -1 if not text or not quote else text.find(quote)
        number = 0
        while at >= 0 and (most is None or number < most):
            yield number, at
            number += 1
            at = text.find(quote, at + len(quote))


@udtf(useArrow=True)
class Facts:
    """The columns of a row with each fact of its text: category and value, every different one once."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = [f.name for f in rows.dataType.fields]
        if text.value not in names:
            raise ValueError(f"no column {text.value!r} in {names}")
        kept = [f for f in rows.dataType.fields if f.name != text.value]
        return AnalyzeResult(schema=T.StructType([*kept, T.StructField("category", T.StringType()), T.StructField("fact", T.StringType())]))

    def eval(self, rows: Row, text: str) -> Iterator[tuple]:
        own = rows.asDict()
        said = own.pop(text) or ""
        for category, pattern in _PATTERNS.items():
            for fact in dict.fromkeys(m.group(0).strip(" ") for m in pattern.finditer(said)):
                yield (*own.values(), category, fact)


def register(spark: SparkSession) -> None:
    """Make both known to SQL under ``occurrences`` and ``facts``."""
    spark.udtf.register("occurrences", Occurrences)
    spark.udtf.register("facts", Facts)
