"""Notice views over the driver's tables.

Orders stand for notices, customers for purchasers, line items for award records
and documents for raw notice texts. All views are lazy selections, so filters and
column choices of a query reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dates that stand for "now", so that results do not change with the clock.
ORDERS_AS_OF, EVENTS_AS_OF = "2001-08-01", "2024-01-31"

NOTICE_TYPES = {"O": "tender", "F": "award", "P": "correction"}

#: The same views in SQL, for the stated results.
NOTICES_SQL = """notices AS (
  SELECT o_orderkey AS id, c_name AS purchaser, n_name AS location, r_name AS region, o_orderdate AS publish_time,
         o_totalprice AS budget, o_orderpriority AS platform,
         CASE o_orderstatus WHEN 'O' THEN 'tender' WHEN 'F' THEN 'award' WHEN 'P' THEN 'correction' END AS notice_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
AWARDS_SQL = """awards AS (
  SELECT l_orderkey AS notice_id, l_linenumber AS lot, s_name AS winner, l_extendedprice AS win_amount, l_shipdate AS win_date,
         c_name AS purchaser, n_name AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a small input has fewer partitions; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, purchaser, location, region, publish_time, budget, platform, notice_type."""
    kind = F.create_map(*(F.lit(x) for pair in NOTICE_TYPES.items() for x in pair))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("c_name").alias("purchaser"),
            F.col("n_name").alias("location"),
            F.col("r_name").alias("region"),
            F.col("o_orderdate").alias("publish_time"),
            F.col("o_totalprice").alias("budget"),
            F.col("o_orderpriority").alias("platform"),
            F.try_element_at(kind, F.col("o_orderstatus")).alias("notice_type"),
        )
    )


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notice_id, lot, winner, win_amount, win_date, purchaser, region.

    Orders meet their customers before the line items, so that the many rows of these are dealt out and sorted once,
    by their order, and carry no names then.
    """
    sold = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "c_name", "n_name")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(sold.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("notice_id"),
            F.col("l_linenumber").alias("lot"),
            F.col("s_name").alias("winner"),
            F.col("l_extendedprice").alias("win_amount"),
            F.col("l_shipdate").alias("win_date"),
            F.col("c_name").alias("purchaser"),
            F.col("n_name").alias("region"),
        )
    )


def money(column: str):
    """Amounts are summed as decimals, so that the order of rows does not show in a sum."""
    return F.col(column).cast("decimal(18,2)")
