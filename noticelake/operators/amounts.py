"""Amounts validated in full: type, currency, warnings and the rule by which a value was derived.

The steps are projections one after the other, each pattern run once a value; the three
groups of the amount come from one match, whose replacement puts marks between them.

Defined results: null and blank values are ``empty``; a type that means unknown counts as
none and is noted; any other that is not known is an error, before the value is looked at;
numbers in a rule are written as decimals with one place at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.values import AMOUNT, AMOUNT_PREFIX, CURRENCIES

#: Types of amounts, and what a type says that means none (fixed values).
AMOUNT_TYPES = ("budget", "ceiling", "award", "contract", "unit_price")
UNKNOWN_TYPES = ("unknown", "其他", "未指定", "")
_BRACKET = "（\\s*(万元|亿元|元|万|亿)\\s*）\\s*$"
_SUFFIX = "（[^）]*）$"
_MARK = "\u0001"


def plain(number: Column) -> Column:
    """A number with its decimals but no zeros behind them, one place at least."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), "\\.$", ".0")


def validated(rows: DataFrame, raw: str, kind: str | None = None, expected: str = "CNY", name: str = "amount") -> DataFrame:
    """``rows`` with a struct: valid, error, value (yuan), normalized, currency, amount_type, warnings and derivation_rule."""
    given = F.lit(None).cast("string") if kind is None else F.col(kind)
    none = F.coalesce(F.lower(given).isin(*UNKNOWN_TYPES), F.lit(False))
    step = rows.select("*", F.trim(raw).alias("_raw"), F.when(~none, given).alias("_type"), F.coalesce(none & (given != ""), F.lit(False)).alias("_noted"))
    step = step.withColumn("_first", F.trim(F.regexp_replace("_raw", AMOUNT_PREFIX, "")))
    step = step.withColumn("_unit", F.regexp_extract("_first", _BRACKET, 1))
    step = step.withColumn("_second", F.when(F.col("_unit") != "", F.trim(F.regexp_replace("_first", _BRACKET, "$1"))).otherwise(F.col("_first")))
    step = step.withColumn("_suffix", F.regexp_extract("_second", _SUFFIX, 0))
    step = step.withColumn("_third", F.when(F.col("_suffix") != "", F.trim(F.regexp_replace("_second", _SUFFIX, ""))).otherwise(F.col("_second")))
    step = step.withColumn("_parts", F.split(F.regexp_replace("_third", AMOUNT, f"$1{_MARK}$2{_MARK}$3"), _MARK))
    number = F.replace(F.get("_parts", F.lit(1)), F.lit(","), F.lit("")).try_cast("double")
    step = step.withColumn("_number", number).withColumn("_shown", F.get("_parts", F.lit(2)))
    has = lambda word: F.contains("_shown", F.lit(word))
    step = step.withColumn("_value", F.col("_number") * F.when(has("亿"), 1e8).when(has("万"), 1e4).otherwise(1.0))
    bad_type = F.col("_type").isNotNull() & ~F.col("_type").isin(*AMOUNT_TYPES)
    error = F.when(F.coalesce(F.col("_raw"), F.lit("")) == "", "empty").when(bad_type, "bad_type").when(F.col("_number").isNull(), "bad_format")
    sign, value = F.get("_parts", F.lit(0)), F.col("_value")
    normalized = F.when(value >= 1e8, F.format_string("%.2f亿元", value / 1e8)).when(value >= 1e4, F.format_string("%.2f万元", value / 1e4)).otherwise(F.format_string("%.2f元", value))
    said = F.concat_ws(
        " | ",
        F.when(F.col("_noted"), "amount_type=unknown→None"),
        F.when(F.col("_first") != F.col("_raw"), F.concat(F.lit("剥离前缀: '"), F.substring("_raw", 1, 30), F.lit("...' → '"), F.substring("_first", 1, 30), F.lit("'"))),
        F.when(F.col("_unit") != "", F.concat(F.lit("括号单位展开: '（"), "_unit", F.lit("）' → '"), "_unit", F.lit("'"))),
        F.when(F.col("_suffix") != "", F.concat(F.lit("剥离后缀: '"), "_suffix", F.lit("'"))),
        F.when(has("亿"), F.concat(plain(F.col("_number")), F.lit("亿 × 10^8 = "), plain(value), F.lit("元"))).when(has("万"), F.concat(plain(F.col("_number")), F.lit("万 × 10^4 = "), plain(value), F.lit("元"))),
    )
    good = F.col("_error").isNull()
    step = step.withColumn("_error", error)
    warned = F.when(F.col("_number") == 0, F.array(F.lit("zero_amount"))).otherwise(F.array().cast("array<string>"))
    told = F.struct(
        good.alias("valid"),
        F.col("_error").alias("error"),
        F.when(good, value).alias("value"),
        F.when(good, normalized).alias("normalized"),
        F.when(good, F.coalesce(*(F.when(sign == k, F.lit(v)) for k, v in CURRENCIES.items()), F.lit(expected))).alias("currency"),
        F.when(good, F.col("_type")).alias("amount_type"),
        F.when(good, warned).alias("warnings"),
        F.when(good, F.nullif(said, F.lit(""))).alias("derivation_rule"),
    )
    return step.select(*rows.columns, told.alias(name))
