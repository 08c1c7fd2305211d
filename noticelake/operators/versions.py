"""Versions of evolving rows: chains by content, current rows, sequences, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_chain(rows: DataFrame, key: list[str], order: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the one before, numbered from 1, with the previous content."""
    by = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(content).over(by)
    first = F.row_number().over(by) == 1
    marked = rows.withColumn("previous", before).withColumn("changed", first | ~F.col(content).eqNullSafe(before))
    number = F.sum(F.col("changed").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("version", number).filter("changed").drop("changed")


def is_current(rows: DataFrame, key: list[str], order: str, multi: str) -> DataFrame:
    """``rows`` with is_current: all since the last single-valued row of the key, that row included."""
    by = Window.partitionBy(*key)
    last_single = F.max(F.when(~F.col(multi), F.col(order))).over(by)
    return rows.withColumn("is_current", F.coalesce(F.col(order) >= last_single, F.lit(True)))


def next_sequence(links: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New links numbered on from the greatest sequence of their key."""
    top = links.groupBy(key).agg(F.max("sequence").alias("top"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.join(top, key, "left").withColumn("sequence", F.coalesce("top", F.lit(0)) + number).drop("top")


def upsert_by_url(new: DataFrame, known: DataFrame, url: str = "source_url") -> DataFrame:
    """New sources that are not yet known, once each, with ids made from the address; a null address counts as the row's text."""
    named = new.withColumn(url, F.coalesce(url, F.concat(F.lit("synthetic:"), F.sha2(F.to_json(F.struct(*new.columns)), 256))))
    return named.dropDuplicates([url]).join(known.select(url), url, "left_anti").withColumn("source_id", F.substring(F.sha2(url, 256), 1, 26))


def organisations(names: DataFrame, known: DataFrame, name: str = "normalized_name") -> DataFrame:
    """Names that are not yet known, once each, with a stable id."""
    fresh = names.filter(F.coalesce(name, F.lit("")) != "").select(name).distinct()
    return fresh.join(known.select(name), name, "left_anti").withColumn("organization_id", F.substring(F.sha2(name, 256), 1, 26))
