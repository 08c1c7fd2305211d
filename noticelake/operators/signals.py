"""Observations about organisations: counts and shares only, never a credit score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.sources.tables import money


def activity(awards: DataFrame, org: str = "winner") -> DataFrame:
    """Awards per organisation and month: number and sum."""
    month = F.date_format("win_date", "yyyy-MM").alias("month")
    return awards.groupBy(org, month).agg(F.count("*").alias("n"), F.sum(money("win_amount")).cast("double").alias("amount"))


def concentration(awards: DataFrame, dimension: str, org: str = "winner", top: int = 3) -> DataFrame:
    """Share of the ``top`` most frequent values of a dimension in an organisation's awards; a missing value counts as one of its own."""
    counts = awards.groupBy(org, F.coalesce(dimension, F.lit("未知")).alias("value")).agg(F.count("*").alias("n"))
    rank = Window.partitionBy(org).orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("k", F.row_number().over(rank))
    first = F.when(F.col("k") <= top, F.col("n"))
    return ranked.groupBy(org).agg(F.sum("n").cast("long").alias("total"), F.sum(first).cast("long").alias("top"), (F.sum(first) / F.sum("n")).alias("share"))


def co_occurrence(participants: DataFrame, org: str, group: list[str], most: int = 50) -> DataFrame:
    """Pairs of organisations that take part in the same groups: number of groups shared.

    Groups of more than ``most`` organisations go by their neighbours in order of name only through the exact
    second path: each member is paired with the group by a join on (group, part), so no task holds a whole group.
    """
    from noticelake.sources.scratch import stored

    once = stored(participants.select(*group, org).distinct())  # read four times
    sizes = once.groupBy(*group).agg(F.count("*").alias("m"))
    parts = once.join(sizes, group).withColumn("parts", F.ceil(F.col("m") / most).cast("int"))
    left = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed(org, "a")
    right = parts.select(*group, F.pmod(F.xxhash64(org), F.col("parts")).cast("int").alias("part"), F.col(org).alias("b"))
    return left.join(right, [*group, "part"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def link_lists(rows: DataFrame, org: str, item: str) -> DataFrame:
    """Number and ordered list of linked items per organisation."""
    return rows.groupBy(org).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items"))


def by_perspective(awards: DataFrame) -> DataFrame:
    """Records per winner, or per purchaser where no record names a winner."""
    any_winner = awards.agg(F.coalesce(F.bool_or(F.coalesce("winner", F.lit("")) != ""), F.lit(False)).alias("any"))
    org = F.when(F.col("any"), F.col("winner")).otherwise(F.col("purchaser"))
    return awards.join(F.broadcast(any_winner)).groupBy(org.alias("org")).agg(F.count("*").alias("n")).filter("org <> ''")
