"""Registered queries: the batch forms of the streaming operators, over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.sources.tables import table
from noticelake.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def shown(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("""WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
 UNION ALL SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.ts + INTERVAL 30 MINUTE GROUP BY k.user_id, k.event_type)
SELECT min(event_id) AS event_id, user_id, event_type FROM events JOIN k USING (user_id, event_type, ts) GROUP BY user_id, event_type, ts""")
def st04_dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes that no pushed one of the same content precedes by 30 minutes or less."""
    return streams.drop_repeats_batch(events(spark, sf_dir), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("""SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY ALL""")
def st07_daily_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.daily_rate(events(spark, sf_dir), "user_id").select("user_id", shown("start"), "n")


@query("""SELECT event_type, strftime(date_trunc('day', ts) - INTERVAL (k) DAY, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, range(7) r(k) GROUP BY ALL""")
def st08_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding_activity(events(spark, sf_dir), "event_type").select("event_type", shown("start"), "n")


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def st09_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(events(spark, sf_dir), "user_id").select("user_id", shown("start"), shown("end"), "n")
