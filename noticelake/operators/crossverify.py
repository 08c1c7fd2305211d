"""Cross-verification of stated values: what stands behind a value is counted in clusters of reposts, not in pages.

Defined results: claims without a project, field or value cannot be compared and give no
state; a page outside every cluster is one of its own; repeated claims count once; a null
platform or notice type is one of its own; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per (project_id, field_name, value) with n_pages, n_sources and its state.

    ``claims``: project_id, field_name, value, page_id, platform, notice_type; ``clusters``: id, cluster.
    In this order: ``conflict`` where another value stands in a notice of the same type,
    ``version_difference`` where one stands in a notice of another type, ``single_source``
    for one page, ``same_origin`` for pages of one cluster, ``independent`` for clusters of
    several platforms, else ``consistent_unknown``.

    Claims are pre-aggregated by cluster; other values are found by counts per notice type,
    not by pairs of claims, so a project with many claims costs no more than their number.
    """
    asked = claims.filter("coalesce(project_id, '') <> '' and coalesce(field_name, '') <> '' and value is not null")
    pages = asked.select("project_id", "field_name", "value", "page_id", "platform", "notice_type").distinct()
    named = pages.join(clusters.select(F.col("id").alias("page_id"), "cluster"), "page_id", "left").withColumn("cluster", F.coalesce("cluster", "page_id"))
    fact, slot = ["project_id", "field_name", "value"], ["project_id", "field_name"]
    # Nulls of these two count as values of their own.
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    sources = named.select(*fact, "cluster", told("platform").alias("platform"), told("notice_type").alias("notice_type")).distinct()
    of_type = sources.groupBy(*slot, "notice_type").agg((F.min("value") != F.max("value")).alias("contested"))
    of_slot = sources.groupBy(*slot).agg((F.min("value") != F.max("value")).alias("several"))
    counts = named.groupBy(*fact).agg(F.count_distinct("page_id").alias("n_pages"))
    per_value = (
        sources.join(of_type, [*slot, "notice_type"])
        .groupBy(*fact)
        .agg(F.count_distinct("cluster").alias("n_sources"), F.count_distinct("platform").alias("n_platforms"), F.bool_or("contested").alias("contested"))
    )
    state = (
        F.when(F.col("contested"), "conflict")
        .when(F.col("several"), "version_difference")
        .when(F.col("n_pages") == 1, "single_source")
        .when(F.col("n_sources") == 1, "same_origin")
        .when(F.col("n_platforms") > 1, "independent")
        .otherwise("consistent_unknown")
    )
    return per_value.join(counts, fact).join(of_slot, slot).select(*fact, "n_pages", "n_sources", state.alias("state"))
