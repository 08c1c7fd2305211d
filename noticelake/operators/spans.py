"""Overlaps of spans: an interval join by bins, and the best overlap of every span.

Spans of one document are never all paired: each goes to the bins of positions that it
meets, and spans that meet in a bin are compared there. A pair that shares several bins is
kept in the first of them, so pairs come out once and nothing has to be made distinct.

Defined results: spans without a start or end, and empty or reversed ones, overlap nothing;
keys join where they are equal and not null; repeated spans are compared once and all have
the result; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.evidence import iou

#: Characters of a bin. A span of n characters goes to n / BIN + 1 of them.
BIN = 128


def _binned(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return spans.filter("end > start").select(*keys, "start", "end", first.alias("first"), F.explode(F.sequence(first, last)).alias("bin"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of spans (start, end of ``left``; other_start, other_end of ``right``) of equal keys that share a position, each once."""
    other = _binned(right.select(*keys, "start", "end").distinct(), keys, width)
    other = other.withColumnsRenamed({"start": "other_start", "end": "other_end", "first": "other_first"})
    pairs = _binned(left.select(*keys, "start", "end").distinct(), keys, width).join(other, [*keys, "bin"])
    meet = (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))
    return pairs.filter(meet & (F.col("bin") == F.greatest("first", "other_first"))).select(*keys, "start", "end", "other_start", "other_end")


def best_overlap(found: DataFrame, gold: DataFrame, keys: list[str], least: float = 0.5, offset: Column | None = None, width: int = BIN) -> DataFrame:
    """``found`` with iou, its best overlap with a span of ``gold`` of the same keys (0 without one), and whether it matches.

    ``offset``: an expression over ``gold`` that is added to its spans, as where they count from the start of a body within the text.
    """
    if offset is not None:
        gold = gold.withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset})
    share = iou(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    best = overlapping(found, gold, keys, width).groupBy(*keys, "start", "end").agg(F.max(share).alias("iou"))
    joined = found.join(best, [*keys, "start", "end"], "left")
    return joined.withColumn("iou", F.coalesce("iou", F.lit(0.0))).withColumn("matched", F.col("iou") >= least)
