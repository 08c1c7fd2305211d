"""Profiles of organisations: sums by role, and what a supplier's awards have most in common.

Defined results: null and empty names are nobody's and count for no list; amounts that are
null count as 0; equal counts in a list go by name; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def role_sums(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(organisation, n and amount of each role, total): ``parts`` gives for a role its rows, the column of the organisation and that of the amount.

    Each role is summed on its own before the roles come together, so one row an organisation and role is shuffled.
    """
    each = []
    for role, (rows, name, amount) in parts.items():
        money = F.coalesce(F.col(amount).cast("decimal(18,2)"), F.lit(0))
        named = rows.filter(F.coalesce(name, F.lit("")) != "")
        each.append(named.groupBy(F.col(name).alias("organisation")).agg(F.count("*").alias("n"), F.sum(money).alias("amount")).withColumn("role", F.lit(role)))
    both = reduce(DataFrame.unionByName, each)
    of = lambda role, c: F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    sums = [x for r in parts for x in (of(r, "n").alias(f"n_{r}"), of(r, "amount").cast("double").alias(f"amount_{r}"))]
    return both.groupBy("organisation").agg(*sums, F.sum("amount").cast("double").alias("total"))


def top_values(rows: DataFrame, by: str, columns: list[str], most: int = 5) -> DataFrame:
    """(by, one array a column): the most frequent values of each column, the most frequent first, in one pass over the rows.

    Counts come before ranks, so what is ranked for a hot organisation is its different values and not its rows.
    """
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    counts = rows.select(by, value).filter("coalesce(x.value, '') <> ''").groupBy(by, "x.column", "x.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by, "column").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("k", rank).filter(F.col("k") <= most)
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("column") == c, F.struct("k", "value")))), lambda x: x["value"])
    return top.groupBy(by).agg(*(of(c).alias(c) for c in columns))


def supplier_profiles(awards: DataFrame, winner: str = "winner", amount: str = "win_amount", at: str = "win_date", lists: tuple[str, ...] = ("purchaser", "agency", "region")) -> DataFrame:
    """One row per winner: win_count, total_win_amount, first and last day, and the five main values of each list."""
    named = awards.filter(F.coalesce(winner, F.lit("")) != "")
    money = F.sum(F.coalesce(F.col(amount).cast("decimal(18,2)"), F.lit(0))).cast("double")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    sums = named.groupBy(winner).agg(F.count("*").alias("win_count"), money.alias("total_win_amount"), day(F.min(at)).alias("first_win_date"), day(F.max(at)).alias("last_win_date"))
    return sums.join(top_values(named, winner, list(lists)), winner, "left")
