"""Intermediate tables of operators, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is named, a temporary one serves a driver that runs its own tasks, as in tests; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="noticelake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _tables(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"tables-{spark.sparkContext.applicationId}")


def written(df: DataFrame) -> str:
    """The path of a new table in the shared folder that holds ``df``."""
    path = os.path.join(_tables(df.sparkSession), f"table-{uuid4().hex}")
    df.write.parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that its lineage ends.

    A lost executor then costs no more than the tasks that it ran. The tables of an application stay until ``clear``.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def clear(spark: SparkSession) -> None:
    """Delete this application's tables; call it once the results that were made from them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
