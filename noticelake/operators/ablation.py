"""Four ways to accept proposed field values, compared on the same rows of the acceptance chain.

A takes every value, B asks for a quote, C for a quote that is located and a value that is
valid, D gives out only what its grade does not forbid. All have the same values; they
differ in which of them are unjustified and, for D, in which are judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.operators.lineage import display_grade

GROUPS = ("A", "B", "C", "D")


def group_rows(chained: DataFrame, gold: str = "gold") -> DataFrame:
    """One row per group and row of accept() with a gold value: group, has_value, justified, output, correct (null where not judged), gold_absent."""
    value, quoted, proven = F.col("has_value"), F.col("has_quote"), F.col("located") & F.col("valid")
    support = F.when(proven, "direct").when(value, "inferred").otherwise("unsupported")
    shown = display_grade(support, F.lit("official_original"), F.col("field_status")) != "low"
    justified = {"A": F.lit(False), "B": quoted, "C": proven, "D": shown}
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("group"), justified[g].alias("justified"), (shown if g == "D" else F.lit(True)).alias("output")) for g in GROUPS)))
    wanted = F.coalesce(gold, F.lit(""))
    told = F.coalesce(value & (wanted != "") & (F.contains(F.col("raw_value"), wanted) | F.contains(wanted, F.col("raw_value"))), F.lit(False))
    out = chained.select(each.alias("x"), "has_value", told.alias("told"), (wanted == "").alias("gold_absent"))
    return out.select("x.group", "has_value", "x.justified", "x.output", F.when(F.col("x.output"), F.col("told")).alias("correct"), "gold_absent")


def summary(rows: DataFrame) -> DataFrame:
    """Per group: rows, values, values judged, their precision, the share of values without justification and of absent ones that a value was given out for."""
    rate = lambda c, d: F.try_divide(F.count_if(c), F.count_if(d))
    value, judged = F.col("has_value"), F.col("has_value") & F.col("output")
    return rows.groupBy("group").agg(
        F.count("*").alias("n"),
        F.count_if(value).alias("n_values"),
        F.count_if(judged).alias("n_judged"),
        rate(judged & F.col("correct"), judged).alias("precision"),
        rate(value & ~F.col("justified"), value).alias("unjustified_rate"),
        rate(judged & F.col("gold_absent"), F.col("gold_absent")).alias("null_false_positive_rate"),
    )
