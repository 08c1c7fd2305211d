"""Registered queries: acceptance groups, signals per organisation, reposts, job states and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators import lineage, metrics, signals
from noticelake.operators import evidence as ev
from noticelake.operators import filters as f
from noticelake.sources.tables import AWARDS_SQL, NOTICES_SQL, awards, money, notices, table
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


@query(f"""WITH {AWARDS_SQL}, m AS (SELECT winner, strftime(win_date, '%Y-%m') AS month, sum(CAST(win_amount AS DECIMAL(18,2))) AS amount, count(*) AS n FROM awards GROUP BY ALL)
SELECT winner, sum(n)::BIGINT AS n, sum(amount)::DOUBLE AS amount, string_agg(month || '=' || n, ',' ORDER BY month) AS trend FROM m GROUP BY winner""")
def s07_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each winner with its months in order."""
    month = F.date_format("win_date", "yyyy-MM").alias("month")
    each = awards(spark, sf_dir).groupBy("winner", month).agg(F.sum(money("win_amount")).alias("amount"), F.count("*").alias("n"))
    trend = F.sort_array(F.collect_list(F.struct("month", "n")))
    text = F.array_join(F.transform(trend, lambda m: F.concat_ws("=", m["month"], m["n"].cast("string"))), ",")
    return each.groupBy("winner").agg(F.sum("n").cast("long").alias("n"), F.sum("amount").cast("double").alias("amount"), text.alias("trend"))


@query(f"""WITH {AWARDS_SQL} SELECT winner, count(*) AS n, string_agg(DISTINCT region, ',' ORDER BY region) AS items FROM awards GROUP BY winner""")
def s03_link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = signals.link_lists(awards(spark, sf_dir), "winner", "region")
    return listed.select("winner", "n", F.array_join("items", ",").alias("items"))


@query("""WITH p AS (SELECT page_id, substr(url, 1, 12) AS title, length(html) % 3 AS k, strftime(DATE '2024-01-01' + CAST(page_id % 5 AS INT), '%Y-%m-%d') AS published FROM pages)
SELECT a.page_id AS a, b.page_id AS b, CASE WHEN (a.title = b.title)::INT + (a.k = b.k)::INT + (a.published = b.published)::INT >= 3 THEN 'likely_repost' ELSE 'independent' END AS verdict
FROM p a JOIN p b ON b.page_id = a.page_id + 5""")
def l06_repost_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on pairs of pages five apart, by the features that their columns give."""
    empty = F.lit("")
    p = table(spark, sf_dir, "pages").select(
        "page_id",
        F.struct(
            empty.alias("host"), empty.alias("content"), F.substring("url", 1, 12).alias("identifier"), (F.length("html") % 3).cast("string").alias("notice_type"),
            empty.alias("title"), F.lit(0).cast("long").alias("simhash"), empty.alias("publisher"),
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 5).cast("int")), "yyyy-MM-dd").alias("published"), F.array().cast("array<string>").alias("links"),
        ).alias("x"),
    )
    pairs = p.select((F.col("page_id") + 5).alias("j"), F.col("page_id").alias("a"), F.col("x").alias("l")).join(p.select(F.col("page_id").alias("j"), F.col("x").alias("r")), "j")
    return pairs.select("a", F.col("j").alias("b"), lineage.repost_verdict(lineage.repost_features("l", "r")).alias("verdict"))


@query("""WITH p AS (SELECT o_custkey, o_orderstatus AS amount_type, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'lot' || (o_orderkey % 3) END AS lot, o_orderkey FROM orders)
SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN a.amount_type <> b.amount_type THEN 'different_amount_type' WHEN a.lot IS DISTINCT FROM b.lot THEN 'different_lot' END AS reason
FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.o_orderkey = a.o_orderkey + 1""")
def l08_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reason why neighbouring assertions of one purchaser cannot be compared."""
    key = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_custkey").alias("project_id"), F.lit("amount").alias("field_name"), F.col("o_orderstatus").alias("amount_type"),
            F.when(key != 0, F.concat(F.lit("lot"), key.cast("string"))).alias("lot_id"), F.lit(None).cast("string").alias("entity_role"),
        ).alias("x"),
    )
    next_ = rows.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderkey").alias("b"), F.col("x").alias("r"))
    pairs = rows.withColumnRenamed("x", "l").join(next_, "o_orderkey").filter(F.col("l.project_id") == F.col("r.project_id"))
    return pairs.select(F.col("o_orderkey").alias("a"), "b", lineage.comparable("l", "r").alias("reason"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'independent' WHEN 1 THEN 'consistent_unknown' WHEN 2 THEN 'single_source' WHEN 3 THEN 'conflict' END AS s FROM labels)
SELECT doc_id, coalesce(s IN ('independent', 'consistent_unknown'), false) AS verified FROM x""")
def g03_cross_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    status = F.when(k == 0, "independent").when(k == 1, "consistent_unknown").when(k == 2, "single_source").when(k == 3, "conflict")
    return table(spark, sf_dir, "labels").select("doc_id", lineage.cross_verified(status).alias("verified"))


@query("""WITH g AS (SELECT source, lang, count(*) FILTER (n_chars > 1000)::DOUBLE / count(*) AS recall FROM documents GROUP BY ALL)
SELECT lang, count(*) AS n, count(*) FILTER (recall < 0.5) AS low, max(recall) AS best FROM g GROUP BY lang""")
def a27_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = (F.count_if(F.col("n_chars") > 1000) / F.count("*")).alias("recall")
    each = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(share)
    return each.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("recall") < 0.5).alias("low"), F.max("recall").alias("best"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled
FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source""")
def a30_gold_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), n(F.col("lang") == "en").alias("en"), n(F.col("quality") == 0).alias("rejected"), n(F.col("toxic") == 1).alias("toxic"), n(F.col("quality").isNull()).alias("unlabelled")
    )


@query("""SELECT doc_id, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'th', ''))) // 2)::BIGINT AS n FROM documents""")
def x04_overlapping_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places, overlapping ones too, of a short quote in whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", ev.overlapping_occurrences(F.col("text"), "th").cast("long").alias("n"))


@query("""SELECT user_id, max_by(event_type, ts) AS state, count(*) AS steps FROM (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events) WHERE k = 1 GROUP BY user_id""")
def x07_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each job by the last of its events."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("event_type"))
    return first.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"), F.count("*").alias("steps"))


@query("""SELECT n_name AS domain, n_regionkey = 2 AS decommissioned FROM nation ORDER BY domain""")
def x08_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), (F.col("n_regionkey") == 2).alias("decommissioned")).orderBy("domain")


@query(f"""WITH {NOTICES_SQL}, w AS (SELECT id FROM notices WHERE (lower(purchaser) LIKE '%9%' OR lower(location) LIKE '%9%') AND (contains(lower(region), 'asia') OR contains(lower(location), '1'))
 AND notice_type IN ('tender', 'award')) SELECT id FROM w ORDER BY id DESC LIMIT 30""")
def x01_fallback_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = f.like_word("purchaser", "9") | f.like_word("location", "9")
    places = f.any_of([f.contains_word("region", "ASIA"), f.contains_word("location", "1")])
    found = f.in_list(notices(spark, sf_dir).filter(words & places), "notice_type", ["tender", "award"])
    return found.select("id").orderBy(F.desc("id")).limit(30)


@query("""WITH RECURSIVE k AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY ALL
 UNION ALL SELECT k.event_type, min(e.ts) FROM k JOIN events e ON e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 15 MINUTE GROUP BY k.event_type)
SELECT min(event_id) AS event_id FROM events JOIN k USING (event_type, ts) GROUP BY event_type, ts""")
def st05_collect_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that are not within 15 minutes of the last one that ran."""
    return streams.drop_repeats_batch(table(spark, sf_dir, "events"), ["event_type"], "event_id", 15, inclusive=True).select("event_id")
