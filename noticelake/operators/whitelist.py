"""Maintenance of the list of permitted domains from a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("add", "decommission", "recommission")


def maintained(domains: DataFrame, changes: DataFrame) -> DataFrame:
    """(domain, status, reason, changes) after all changes (domain, action, reason, at) have been made in order of ``at``.

    A withdrawal without a reason and an unknown action change nothing. Domains that are only in the log are added.
    """
    reason = F.coalesce("reason", F.lit(""))
    valid = changes.filter(F.col("action").isin(*ACTIONS) & ((F.col("action") != "decommission") | (reason != "")))
    last = valid.groupBy("domain").agg(F.max_by(F.struct("action", "reason"), "at").alias("last"), F.count("*").alias("changes"))
    gone = F.coalesce(F.col("last.action") == "decommission", F.lit(False))
    status = F.when(gone, "decommissioned").otherwise("active")
    joined = domains.select("domain").distinct().join(last, "domain", "full")
    return joined.select("domain", status.alias("status"), F.when(gone, F.col("last.reason")).alias("reason"), F.coalesce("changes", F.lit(0)).alias("changes"))
