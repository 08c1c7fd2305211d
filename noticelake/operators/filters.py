"""Filters over notices: each operator is a Column predicate or a DataFrame filter.

A parameter that is not given puts no condition. Matching of words is literal and,
where said, blind to the case of ASCII letters; nulls never match.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spoken names of notice types (fixed values); the first that a query contains decides.
TYPE_SYNONYMS = {
    "招标": "tender", "采购": "tender", "中标": "award", "成交": "award", "更正": "correction", "变更": "correction", "废标": "cancellation",
}


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def contains_word(column: str | Column, word: str) -> Column:
    """Literal substring, blind to the case of ASCII letters."""
    column = F.col(column) if isinstance(column, str) else column
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(column, upper, lower), F.lit(word.translate(str.maketrans(upper, lower))))


def like_word(column: str, word: str) -> Column:
    """Unescaped pattern: % and _ in the word are wildcards; blind to case."""
    return F.lower(F.col(column)).like(f"%{word.lower()}%")


def equals_given(values: Mapping[str, object | None]) -> Column:
    return all_of(F.col(c) == F.lit(v) for c, v in values.items() if v is not None)


def between_given(column: str, low: object | None = None, high: object | None = None) -> Column:
    """Closed range; either end may be missing."""
    ends = [F.col(column) >= F.lit(low)] if low is not None else []
    return all_of(ends + ([F.col(column) <= F.lit(high)] if high is not None else []))


def in_list(df: DataFrame, column: str, values: list, longest: int = 1_000) -> DataFrame:
    """Rows with a listed value; long lists become a semi join."""
    if len(values) <= longest:
        return df.filter(F.col(column).isin(values))
    listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], [column])
    return df.join(listed, column, "left_semi")


def any_keyword(columns: Iterable[str], words: Iterable[str]) -> Column:
    return any_of(contains_word(c, w) for w in words for c in columns)


def keywords_and_region(df: DataFrame, words: list[str], regions: list[str], text: list[str], places: list[str]) -> DataFrame:
    """Keyword OR, then region OR over other columns; neither given yields nothing."""
    if not words and not regions:
        return df.filter(F.lit(False))
    found = df.filter(any_keyword(text, words)) if words else df
    return found.filter(any_keyword(places, regions)) if regions else found


def type_of_word(column: str | Column) -> Column:
    """Notice type of a spoken name; an unknown name stays."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(*(F.when(F.contains(column, F.lit(k)), F.lit(v)) for k, v in TYPE_SYNONYMS.items()), column)


def recent(column: str, as_of: str, days: int) -> Column:
    """At or after ``as_of`` less so many days; the clock is a parameter."""
    return F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))


def announcement_path(platform: str, url: str, marked: str = "ccgp", path: str = "/cggg/") -> Column:
    """Pages of a marked platform count only under its announcement path; empty addresses pass."""
    address = F.coalesce(F.col(url), F.lit(""))
    return ~F.contains(F.coalesce(F.col(platform), F.lit("")), F.lit(marked)) | (address == "") | F.contains(address, F.lit(path))


def host(url: str | Column) -> Column:
    """Host of an address without its www., m., wap. or mobile. prefix."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^(www|m|wap|mobile)\\.", "")


def host_suffixes(name: Column) -> Column:
    """A host and all its parent domains, so that suffix matching is an equi join."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def whitelist_verdict(pages: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with the listed domain that its host is or lies under, longest first, and ``allowed``.

    ``domains`` has (domain, active); a decommissioned domain rejects.
    """
    hosts = pages.withColumn("host", host(url))
    suffixes = hosts.select(url, F.explode_outer(host_suffixes(F.col("host"))).alias("domain"))
    best = suffixes.join(domains, "domain").groupBy(url).agg(F.max_by(F.struct("domain", "active"), F.length("domain")).alias("hit"))
    return hosts.join(best, url, "left").select(*hosts.columns, F.col("hit.domain").alias("domain"), F.coalesce("hit.active", F.lit(False)).alias("allowed"))


def strategy_keeps(strategy: str, grade: str = "display_grade", support: str = "support_level") -> Column:
    """Output strategies: strict, default, loose and audit."""
    high, review = F.col(grade) == "high", F.col(grade) == "review"
    strong = F.lower(F.col(support)).isin("direct", "equivalent")
    kept = {"strict": high, "default": high | (review & strong), "loose": high | review, "audit": F.lit(True)}
    if strategy not in kept:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.coalesce(kept[strategy], F.lit(False))


def newest_of_each(rows: DataFrame, group: str, order: str, most: int | None = None) -> DataFrame:
    """The rows of the ``most`` largest ``order`` of each group; all rows without a bound."""
    if most is None:
        return rows
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("__rank") <= most).drop("__rank")


def split_check(whole: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: sizes of two splits of a table of ids, how many ids they share, how many both miss, and whether neither happens."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = count(first, "first"), count(second, "second"), count(first.intersect(second), "shared"), count(whole.exceptAll(first.unionByName(second).distinct()), "missing")
    row = parts[0]
    for part in parts[1:]:  # one row each
        row = row.crossJoin(F.broadcast(part))
    return row.withColumn("disjoint_and_complete", (F.col("shared") == 0) & (F.col("missing") == 0))
