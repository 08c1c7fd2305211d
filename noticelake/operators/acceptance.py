"""Acceptance of proposed field values: locate the quotes, validate the value, grade, accept or say why not.

One lazy plan: the proposals of a text are gathered in their order, so that its quotes are
searched one after the other over one index of the text. The exact level runs as a fold in
the JVM that carries the place where the last hit ended; only texts of which a quote is not
found there go to the pandas function, which repeats the same walk over all levels.

Defined results: proposals without their text, with an empty or null one, or without quotes
are not located; null and blank quotes are never found; proposals of equal order are taken
by field and value; equal rows are equal proposals and are all kept; empty tables give
empty results; columns beyond those named pass through from the proposals. A text's own
proposals come together in one row, as a search that goes on from quote to quote has to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.values import validate_amount, validate_date, validate_identifier
from noticelake.operators.evidence import CONTEXT, locate_batch_column
from noticelake.operators.lineage import display_grade

#: Names of fields that are taken in (fixed values).
FIELDS = ("project_identifier", "project_name", "purchaser_name", "winner_name", "amount", "publish_date", "bid_deadline")
#: Support that a level of the search gives to a field, and the validator of a field (fixed values).
SUPPORT = {"exact": "direct", "stripped": "direct", "no_punct": "equivalent", "substring": "inferred"}
RULES = {"amount": "validate_amount", "publish_date": "validate_date", "bid_deadline": "validate_date", "project_identifier": "validate_project_identifier"}
SPAN = "struct<level:string,start:int,end:int,confidence:double>"
#: A quote with more than white space in it.
_SAYS = "(?U)[^\\s\\x1c-\\x1f]"


def exact_in_order(text: Column, quotes: Column) -> Column:
    """Array of the spans of ``quotes``, each searched from the end of the last hit; a span that is not there is null."""

    def step(seen: Column, quote: Column) -> Column:
        at = F.position(quote, text, seen["at"] + 1) - 1
        hit = F.coalesce(quote.rlike(_SAYS) & (at >= 0), F.lit(False))
        end = at + F.length(quote)
        span = F.when(hit, F.struct(F.lit("exact").alias("level"), at.alias("start"), end.alias("end"), F.lit(1.0).alias("confidence")))
        return F.struct(F.when(hit, end).otherwise(seen["at"]).alias("at"), F.array_append(seen["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.aggregate(quotes, start, step, lambda s: s["spans"])


def located_in_order(rows: DataFrame, text: str, quotes: str, name: str = "spans") -> DataFrame:
    """``rows`` with an array of SPAN for the array ``quotes``, null for what no level finds."""
    own, all_of = F.coalesce(text, F.lit("")), F.coalesce(quotes, F.array().cast("array<string>"))
    exact = rows.withColumn(name, exact_in_order(own, all_of))
    missed = F.exists(name, lambda s: s.isNull())
    # Where nothing is missed the function gets nulls, which cost no search and no transfer.
    loose = exact.withColumn(f"{name}_", locate_batch_column()(F.when(missed, own), F.when(missed, all_of)))
    found = F.transform(f"{name}_", lambda s: F.when(s["found"], F.struct(s["level"].alias("level"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"))))
    return loose.withColumn(name, F.when(missed, found).otherwise(F.col(name))).drop(f"{name}_")


def field_valid(field: Column, raw: Column) -> Column:
    """Whether a value passes the validator of its field; fields without one pass."""
    told = (
        F.when(field == "amount", validate_amount(raw)["valid"])
        .when(field.isin("publish_date", "bid_deadline"), validate_date(raw)["valid"])
        .when(field == "project_identifier", validate_identifier(raw)["valid"])
        .otherwise(True)
    )
    return F.coalesce(told, F.lit(False))


def accept(texts: DataFrame, proposals: DataFrame, key: str = "doc_id", order: str = "seq", role: str = "official_original") -> DataFrame:
    """One row per proposal (key, order, field_name, field_status, raw_value, quotes): accepted, reason and the evidence.

    ``reason`` is the first of unknown_field, no_value, no_quote, not_located, invalid_value and low_grade; null for what is accepted.
    """
    row = F.struct(order, "field_name", "raw_value", *(c for c in proposals.columns if c not in (key, order, "field_name", "raw_value")))
    listed = proposals.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    listed = listed.withColumn("asked", F.flatten(F.transform("rows", lambda r: F.coalesce(r["quotes"], F.array().cast("array<string>")))))
    with_text = listed.join(texts.select(key, F.col("text").cast("string").alias("text")), key, "left")
    spans = located_in_order(with_text, "text", "asked")
    # The spans of a proposal begin where those of the proposals before it end.
    size = lambda r: F.coalesce(F.size(r["quotes"]), F.lit(0))
    each = spans.select(key, "text", "rows", "spans", F.posexplode("rows").alias("at", "r"))
    first = F.aggregate(F.slice("rows", 1, F.col("at")), F.lit(0), lambda n, r: n + F.greatest(size(r), F.lit(0)))
    own = F.filter(F.slice("spans", first + 1, F.greatest(size(F.col("r")), F.lit(0))), lambda s: s.isNotNull())
    best = each.select(key, "text", "r", F.try_element_at(own, F.lit(1)).alias("span"))
    level, field = F.col("span.level"), F.col("r.field_name")
    told = best.withColumns(
        {
            "has_value": (F.coalesce("r.raw_value", F.lit("")) != "") & ~F.coalesce(F.col("r.field_status") == "absent", F.lit(False)),
            "has_quote": size(F.col("r")) > 0,
            "located": F.col("span").isNotNull(),
            "valid": field_valid(field, F.col("r.raw_value")),
            "support_level": F.coalesce(*(F.when(level == k, F.lit(v)) for k, v in SUPPORT.items()), F.lit("unsupported")),
        }
    )
    told = told.withColumn("display_grade", display_grade(F.col("support_level"), F.lit(role), F.col("r.field_status")))
    reason = (
        F.when(~F.coalesce(field.isin(*FIELDS), F.lit(False)), "unknown_field")
        .when(~F.col("has_value"), "no_value")
        .when(~F.col("has_quote"), "no_quote")
        .when(~F.col("located"), "not_located")
        .when(~F.col("valid"), "invalid_value")
        .when(F.col("display_grade") == "low", "low_grade")
    )
    start, end = F.col("span.start"), F.col("span.end")
    low = F.greatest(F.lit(0), start - CONTEXT)
    return told.select(
        key,
        "r.*",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
        "has_value",
        "has_quote",
        "located",
        "valid",
        level.alias("match_method"),
        start.alias("raw_start"),
        end.alias("raw_end"),
        F.substring("text", start + 1, end - start).alias("evidence_text"),
        F.substring("text", low + 1, start - low).alias("context_before"),
        F.substring("text", end + 1, F.when(end >= 0, F.lit(CONTEXT))).alias("context_after"),
        F.col("span.confidence").alias("confidence"),
        "support_level",
        F.coalesce(*(F.when(field == k, F.lit(v)) for k, v in RULES.items()), F.lit("evidence_locate")).alias("verification_rule"),
        "display_grade",
    )
