"""A push log on a stream, each push once whatever fails in between.

A batch is known by its number. Its pushes are written to their own partition first, its log
rows, which are its commit, last; both writes replace the partition of that number. What was
pushed before is read from the log of earlier numbers only, so a batch that is run again
finds what it found the first time, and leaves what it left.

Defined results: rows without an id are not pushed; of rows of a batch that repeat an id the
newest is pushed, of equal times the one whose JSON comes first; an id that was pushed to a
subscription is not pushed to it again; batches without new rows leave no partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _replace(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def log_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log with its column ``batch``; an empty one where nothing was written yet."""
    named = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], named).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(named).parquet(path)


def push_batch(rows: DataFrame, number: int, path: str, log: str, key: str = "tender_id", subscription: str = "subscription_id", newest: str = "publish_time") -> None:
    """Push what the log of earlier batches does not hold, then commit it to the log."""
    ids = T.StructType([rows.schema[subscription], rows.schema[key]])
    before = log_of(rows.sparkSession, log, ids).filter(F.col("batch") < number).select(subscription, key)
    row = F.struct(*rows.columns)
    fresh = rows.filter(F.col(key).isNotNull()).join(before, (rows[key] == before[key]) & rows[subscription].eqNullSafe(before[subscription]), "left_anti")
    once = fresh.groupBy(subscription, key).agg(F.min_by(row, F.struct(-F.unix_micros(F.col(newest).cast("timestamp")), F.to_json(row))).alias("row")).select("row.*")
    _replace(once, path, number)
    commit(rows.sparkSession, path, log, number, [subscription, key])


def commit(spark: SparkSession, path: str, log: str, number: int, ids: list[str]) -> None:
    """The log rows of a batch are those of the pushes that were written for it."""
    _replace(spark.read.parquet(f"{path}/batch={number}").select(*ids), log, number)


def pushed(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The pushes of committed batches."""
    committed = spark.read.parquet(log).select("batch").distinct()
    return spark.read.parquet(path).join(committed, "batch", "left_semi")


def push_stream(stream: DataFrame, path: str, log: str, checkpoint: str, **columns: str):
    """Push the available batches of a stream."""
    run = lambda rows, number: push_batch(rows, number, path, log, **columns)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
