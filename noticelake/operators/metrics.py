"""Evaluation metrics: set precision and recall, percentiles, calibration, bootstrap intervals."""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_scores(gold: Column, predicted: Column) -> Column:
    """struct(precision, recall, f1) of two arrays taken as sets.

    Both empty: 1, 1, 1; nothing predicted: 0, 0, 0; nothing to find: 0, 1, 0.
    """
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(g, p))
    none_g, none_p = F.size(g) == 0, F.size(p) == 0
    precision = F.when(none_g & none_p, 1.0).when(none_g | none_p, 0.0).otherwise(F.try_divide(hit, F.size(p)))
    recall = F.when(none_g, 1.0).when(none_p, 0.0).otherwise(F.try_divide(hit, F.size(g)))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    f1 = F.when(none_g & ~none_p, 0.0).otherwise(f1)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def index_percentiles(rows: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """(key, name): element int(n * share), at most the last, of each key's values in order; null values do not count.

    Equal values are counted first, so what is ranked per key is its distinct values, whatever the rows of a hot key.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_m"))
    whole = Window.partitionBy(key)
    upto, total = F.sum("_m").over(whole.orderBy(value)), F.sum("_m").over(whole)
    at = F.least(F.floor(total * share), total - 1)
    ranked = counted.withColumn("_hit", upto > at)
    return ranked.filter("_hit").groupBy(key).agg(F.min(value).alias(name))


def buckets(value: Column, edges: tuple[float, ...]) -> Column:
    """Number of the first edge that is above a value; the last bucket is open."""
    chosen = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        chosen = F.when(value < edges[i], F.lit(i)).otherwise(chosen)
    return chosen


def group_summary(rows: DataFrame, group: str) -> DataFrame:
    """Per group of rows (has_value, correct, justified, gold_absent): counts and rates."""
    n = F.count("*")
    rate = lambda c, d: F.try_divide(F.count_if(c), F.count_if(d))
    value = F.col("has_value")
    return rows.groupBy(group).agg(
        n.alias("n"),
        F.count_if(value).alias("n_values"),
        rate(value & F.col("correct"), value).alias("precision"),
        rate(value & ~F.col("justified"), value).alias("unjustified_rate"),
        rate(value & F.col("gold_absent"), F.col("gold_absent")).alias("null_false_positive_rate"),
    )


def workpoints(rows: DataFrame) -> DataFrame:
    """Coverage and precision of graded rows (grade, correct) for growing sets of allowed grades."""
    points = {"strict": ("high",), "loose": ("high", "review"), "audit": ("high", "review", "low")}
    each = rows.withColumn("point", F.explode(F.filter(F.array(*(F.when(F.col("grade").isin(*g), F.lit(p)) for p, g in points.items())), lambda p: p.isNotNull())))
    total = rows.agg(F.count("*").alias("total"))
    kept = each.groupBy("point").agg(F.count("*").alias("kept"), F.count_if("correct").alias("right"))
    return kept.join(F.broadcast(total)).select("point", "kept", (F.col("kept") / F.col("total")).alias("coverage"), (F.col("right") / F.col("kept")).alias("precision"))


#: Shares of Poisson draws of mean 1 that are at most 0, 1, 2 ...: all that differ from 1 in the 40 bits of a draw.
POISSON_CUTS = tuple(c for c in accumulate(math.exp(-1) / math.factorial(k) for k in range(20)) if 1 - c > 2.0**-41)


def bootstrap(rows: DataFrame, project: str, numerator: str, denominator: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(point, low, high) of a ratio of sums, projects resampled with replacement.

    Sums are taken per project first. Draws are seeded: each project gets a Poisson weight of mean 1 per
    replicate, made from its hash and the replicate, so that no draw travels and reruns agree.
    """
    sums = rows.groupBy(project).agg(F.sum(numerator).alias("x"), F.sum(denominator).alias("y"))
    base = random.Random(seed).getrandbits(31)
    reps = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.col(project).cast("string"), "rep", F.lit(base)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = sum(F.when(u > c, 1).otherwise(0) for c in POISSON_CUTS)
    ratio = reps.groupBy("rep").agg(F.try_divide(F.sum(F.col("x") * weight), F.sum(F.col("y") * weight)).alias("r"))
    ends = ratio.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    point = sums.agg(F.try_divide(F.sum("x"), F.sum("y")).alias("point"))
    return point.join(F.broadcast(ends)).select("point", F.least("low", "point").alias("low"), F.greatest("high", "point").alias("high"))
