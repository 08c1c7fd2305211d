"""Status of collectors: what ran, failed and came in today, per platform and in all.

Defined results: platforms without jobs or notices are idle with zeros; rows whose platform
is none of the fixed ones count in all but for no platform; a job that runs or waits makes
its platform running, whatever failed; results that are no JSON, or hold no number, count 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of jobs (fixed values).
ACTIVE, FAILED, COMPLETED = ("pending", "running"), "failed", "completed"


def platform_states(jobs: DataFrame, notices: DataFrame, codes: list[str], today: str) -> DataFrame:
    """One row per code: status, collected, failed_count and last_fetch of the day that begins at ``today``.

    ``jobs``: code, status, created_at, completed_at; ``notices``: code, created_at. Each side is summed on its own.
    """
    since = F.lit(today).cast("timestamp")
    of_jobs = jobs.filter(F.col("created_at") >= since).groupBy("code").agg(
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"),
        F.count_if(F.col("status") == FAILED).alias("failed_count"),
        F.max(F.when(F.col("status") == COMPLETED, F.col("completed_at"))).alias("completed"),
    )
    of_notices = notices.filter(F.col("created_at") >= since).groupBy("code").agg(F.count("*").alias("collected"), F.max("created_at").alias("fetched"))
    fixed = jobs.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    both = F.broadcast(fixed).join(of_jobs, "code", "left").join(of_notices, "code", "left")
    status = F.when(F.col("active") > 0, "running").when(F.col("failed_count") > 0, "failed").otherwise("idle")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("code", status.alias("status"), zero("collected"), zero("failed_count"), F.greatest("completed", "fetched").alias("last_fetch"))


def totals(jobs: DataFrame, notices: DataFrame, today: str, most: int = 50) -> DataFrame:
    """One row: active_jobs, today_collected, today_failed, and today_deduplicated over the ``most`` last jobs completed today."""
    since = F.lit(today).cast("timestamp")
    number = lambda path: F.get_json_object("result_data", path).try_cast("long")
    nested = F.get_json_object("result_data", "$.ingest").startswith("{")
    duplicates = F.coalesce(F.when(nested, number("$.ingest.duplicates")).otherwise(number("$.duplicates")), F.lit(0))
    last = jobs.filter((F.col("status") == COMPLETED) & (F.col("completed_at") >= since)).orderBy(F.desc("completed_at"), F.desc("job_id")).limit(most)
    counts = jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active_jobs"), F.count_if((F.col("status") == FAILED) & (F.col("created_at") >= since)).alias("today_failed"))
    collected = notices.agg(F.count_if(F.col("created_at") >= since).alias("today_collected"))
    summed = last.agg(F.coalesce(F.sum(duplicates), F.lit(0)).alias("today_deduplicated"))
    return counts.join(F.broadcast(collected)).join(F.broadcast(summed)).select("active_jobs", "today_collected", "today_failed", "today_deduplicated")
