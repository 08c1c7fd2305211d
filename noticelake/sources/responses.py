"""Proposed fields as a language model answers them: semi-structured text, checked and read as VARIANT.

A response is rejected as a whole for the first fault in its order of reading: of the
record, then field by field, within a field name, status, kind of amount, then its quotes
one by one. Of an accepted response each field is read on its own: one with a member of
another type than text is passed over, values of any type become text.

Defined results: null and unreadable responses are ``not_json``; fences, text around the
outer braces and trailing commas are forgiven, as in lenient_json(); a status or role that
is not given is ``present`` or ``primary``; a given null is none of the known ones; an
empty kind of amount counts as not given; objects and lists become compact JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names, states, kinds and roles that are known (fixed values).
FIELD_NAMES = ("project_identifier", "purchaser_name", "winner_name", "amount", "publish_date", "bid_deadline")
STATUSES = ("present", "absent", "ambiguous", "multi_value")
AMOUNT_TYPES = ("budget", "ceiling", "award", "contract", "unit_price")
ROLES = ("primary", "context", "qualifier")
#: Members of a field that are text or not given.
TEXTS = ("amount_type", "currency", "lot_id", "original_unit", "tax_status", "display_precision")


def parsed(response: Column) -> Column:
    """The response as VARIANT, leniently; null where no reading is JSON."""
    bare = F.trim(F.regexp_replace(response, "(?s)^\\s*```(?:json)?|```\\s*$", ""))
    braces = F.regexp_extract(response, "(?s)\\{.*\\}", 0)
    mended = F.regexp_replace(braces, ",\\s*([}\\]])", "$1")
    return F.coalesce(*(F.try_parse_json(c) for c in (response, bare, braces, mended)))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _member(v: Column, name: str) -> Column:
    """A member as VARIANT; null where it is not given, a VARIANT null where it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _listed(v: Column) -> Column:
    """The elements of a list; null for anything else."""
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _known(v: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(_text(v).isin(*allowed), F.lit(False))


def _falsy(v: Column) -> Column:
    return v.isNull() | F.to_json(v).isin("null", '""', "0", "false", "[]", "{}", "0.0")


def _evidence_fault(quote: Column, j: Column) -> Column:
    role = _member(quote, "role")
    fault = F.when(_kind(quote) != "OBJECT", "not_object").when(_member(quote, "evidence_text").isNull(), "missing_evidence_text").when(role.isNotNull() & ~_known(role, ROLES), "bad_role")
    return F.concat(F.lit("candidate_evidences["), j.cast("string"), F.lit("]: "), fault)


def _field_fault(field: Column, i: Column) -> Column:
    name, status, kind, quotes = (_member(field, n) for n in ("field_name", "field_status", "amount_type", "candidate_evidences"))
    first = F.try_element_at(F.filter(F.transform(_listed(quotes), _evidence_fault), lambda x: x.isNotNull()), F.lit(1))
    fault = (
        F.when(_kind(field) != "OBJECT", "not_object")
        .when(name.isNull(), "missing_field_name")
        .when(~_known(name, FIELD_NAMES), "bad_field_name")
        .when(status.isNotNull() & ~_known(status, STATUSES), "bad_field_status")
        .when((_text(name) == "amount") & ~_falsy(kind) & ~_known(kind, AMOUNT_TYPES), "bad_amount_type")
        .when(quotes.isNotNull() & (_kind(quotes) != "ARRAY"), "evidences_not_list")
        .otherwise(first)
    )
    return F.concat(F.lit("fields["), i.cast("string"), F.lit("]: "), fault)


def _value(v: Column) -> Column:
    """A value of any type as text; null stays null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_kind(v) != "VOID", F.to_json(v))


def _read(field: Column) -> Column:
    """The field as a struct; null where a member that has to be text is something else."""
    members = {n: _member(field, n) for n in TEXTS}
    odd = lambda v: v.isNotNull() & ~_kind(v).isin("STRING", "VOID")
    quotes = F.coalesce(_listed(_member(field, "candidate_evidences")), F.array().cast("array<variant>"))
    wrong = F.exists(quotes, lambda q: _text(_member(q, "evidence_text")).isNull())
    for v in members.values():
        wrong = wrong | odd(v)
    row = F.struct(
        _text(_member(field, "field_name")).alias("field_name"),
        F.coalesce(_text(_member(field, "field_status")), F.lit("present")).alias("field_status"),
        _value(_member(field, "raw_value")).alias("raw_value"),
        _value(_member(field, "normalized_value")).alias("normalized_value"),
        *(_text(v).alias(n) for n, v in members.items()),
        F.transform(quotes, lambda q: F.struct(_text(_member(q, "evidence_text")).alias("evidence_text"), F.coalesce(_text(_member(q, "role")), F.lit("primary")).alias("role"))).alias("candidate_evidences"),
    )
    return F.when(~wrong, row)


def checked(responses: DataFrame, response: str = "response") -> DataFrame:
    """``responses`` with valid, reason (the first fault, null if there is none), fields, and n_dropped fields that were passed over."""
    (doc, listed) = ("_doc", "_listed")
    rows = responses.withColumn(doc, parsed(F.col(response).cast("string"))).withColumn(listed, _listed(_member(F.col(doc), "fields")))
    member = _member(F.col(doc), "fields")
    reason = (
        F.when(F.col(doc).isNull(), "not_json")
        .when(member.isNull(), "missing_fields")
        .when(F.col(listed).isNull(), "fields_not_list")
        .when(F.size(listed) == 0, "fields_empty")
        .otherwise(F.try_element_at(F.filter(F.transform(listed, _field_fault), lambda x: x.isNotNull()), F.lit(1)))
    )
    told = rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    read = F.transform(F.when(F.col("valid"), F.col(listed)), _read)
    told = told.withColumn("fields", read)
    n_dropped = F.size(F.filter("fields", lambda f: f.isNull()))
    return told.withColumn("n_dropped", F.when(F.col("valid"), n_dropped)).withColumn("fields", F.filter("fields", lambda f: f.isNotNull())).drop(doc, listed)
