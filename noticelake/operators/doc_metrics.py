"""Metrics of a document's predicted fields and quotes against its annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.evidence import iou

PRESENT = ("present", "multi_value")
MATCH = 0.5
HISTOGRAM = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9)


def best_iou(places: Column, gold: Column) -> Column:
    """The best overlap of any of a quote's places with any annotated span; null if the quote has no place."""
    of_place = lambda p: F.array_max(F.transform(gold, lambda g: iou(p["start"], p["end"], g["start"], g["end"])))
    best = F.array_max(F.transform(places, of_place))
    return F.when(F.size(places) > 0, F.coalesce(best, F.lit(0.0)))


def evidence_metrics(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document, of rows (doc, gold_status, quotes, gold): counts, recall, precision and mean overlaps.

    ``quotes`` is an array with, for each predicted quote, the array of its places (start, end): one for the variant of
    first occurrences, up to 20 for that of all. Quotes of fields without annotated spans count as predicted only.
    """
    overlaps = F.when(F.size("gold") > 0, F.transform("quotes", lambda places: best_iou(places, F.col("gold")))).otherwise(F.array().cast("array<double>"))
    each = fields.select(doc, F.col("gold_status").isin(*PRESENT).alias("present"), F.size("quotes").alias("pred"), F.filter(overlaps, lambda x: x.isNotNull()).alias("ious"))
    each = each.withColumn("matched", F.filter("ious", lambda x: x >= MATCH))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sums = each.groupBy(doc).agg(
        F.count("*").alias("fields_total"),
        F.count_if("present").alias("fields_present"),
        F.count_if(F.size("matched") > 0).alias("fields_found"),
        F.sum("pred").cast("long").alias("evidences_pred"),
        F.sum(F.size("ious")).cast("long").alias("evidences_located"),
        F.sum(F.size("matched")).cast("long").alias("evidences_matched"),
        F.sum(total("matched")).alias("overlap"),
    )
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return sums.select(
        doc, "fields_total", "fields_present", "fields_found", "evidences_pred", "evidences_located", "evidences_matched",
        F.round(F.col("fields_found") / at_least_one("fields_present"), 4).alias("recall"),
        F.round(F.col("evidences_matched") / at_least_one("evidences_pred"), 4).alias("precision"),
        F.round(F.col("overlap") / at_least_one("evidences_pred"), 4).alias("iou_avg"),
        F.round(F.col("overlap") / at_least_one("evidences_matched"), 4).alias("iou_avg_matched"),
    )


def located_gap(fields: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents that locate more quotes than they match, by the gap, and the histogram of all located overlaps (low edge, n, share)."""
    gap = evidence_metrics(fields, doc).select(doc, (F.col("evidences_located") - F.col("evidences_matched")).alias("gap")).filter("gap > 0")
    quotes = fields.filter(F.size("gold") > 0).select(F.explode("quotes").alias("places"), "gold").select(best_iou(F.col("places"), F.col("gold")).alias("iou"))
    low = F.lit(HISTOGRAM[-1])
    for edge, above in reversed(tuple(zip(HISTOGRAM, HISTOGRAM[1:], strict=False))):
        low = F.when(F.col("iou") < above, F.lit(edge)).otherwise(low)
    counted = quotes.filter("iou is not null").select(F.when(F.col("iou") == 0, F.lit(-1.0)).otherwise(low).alias("low")).groupBy("low").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return gap, counted.join(F.broadcast(total)).select("low", "n", (F.col("n") / F.col("total")).alias("share"))


def interval_rows(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document, of rows (doc, gold_status, has_value, has_evidence, verified, correct): the sums that intervals are drawn from."""
    present = F.col("gold_status").isin(*PRESENT)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.groupBy(doc).agg(
        F.count_if(present).alias("fields_present"),
        F.count_if(present & yes("has_value")).alias("fields_found"),
        F.count_if(yes("has_evidence")).alias("evidences_pred"),
        F.count_if(yes("verified")).alias("evidences_matched"),
        F.count_if(yes("has_evidence") & yes("verified")).alias("overlap"),
        F.count_if(yes("correct")).alias("fields_correct"),
        F.count_if(F.col("correct").isNotNull()).alias("fields_evaluable"),
    )
