"""Registered queries: scans, projections, schedules, resolution, evaluation by group, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions import addresses
from noticelake.functions import values as v
from noticelake.operators import deletes, lineage, metrics, simhash, versions
from noticelake.operators import filters as f
from noticelake.sources.readers import TEMPLATES, scrape
from noticelake.plans.domain import SIMHASH_SQL, fingerprints
from noticelake.sources.tables import NOTICES_SQL, ORDERS_AS_OF, money, notices, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


@query(f"WITH {NOTICES_SQL} SELECT id, purchaser, location, region, budget, platform, notice_type FROM notices")
def src01_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).drop("publish_time")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def src02_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def src03_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_custkey")


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS found_title,
 CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || h WHEN regexp_matches(h, '^[a-z]+://') THEN h ELSE regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/' || h END AS found_url
FROM (SELECT *, trim(regexp_extract(html, '(?is)<a[^>]+href=["'']([^"'']+)', 1)) AS h FROM pages)""")
def src07_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrape(table(spark, sf_dir, "pages"), TEMPLATES["plain"]).select("page_id", "found_title", "found_url")


@query("""SELECT c_custkey, CASE WHEN contains(k, '采购') THEN 'tender' WHEN contains(k, '成交') THEN 'award' ELSE k END AS kind
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '采购公告' WHEN 1 THEN '成交结果' ELSE c_mktsegment END AS k FROM customer)""")
def f10_type_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    said = F.when(key == 0, "采购公告").when(key == 1, "成交结果").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", f.type_of_word(said).alias("kind"))


@query("""SELECT page_id FROM pages WHERE NOT contains(url, 'example.com') OR contains(url, '/en/')""")
def f15_announcement_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(f.announcement_path("url", "url", "example.com", "/en/")).select("page_id")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'address' WHEN page_id % 5 = 1 THEN 'scheme' WHEN page_id % 5 = 2 THEN 'blocked' END AS reason FROM pages""")
def f17_unsafe_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id") % 5
    url = F.when(key == 0, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/x"))).when(key == 1, "file:///etc/hosts").when(key == 2, "http://localhost:80/")
    return table(spark, sf_dir, "pages").select("page_id", addresses.unsafe_reason(F.coalesce(url, "url")).alias("reason"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS arrived, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 s AS (SELECT user_id, event_id, k, arrived AS start FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(e.arrived, s.start + 8000000) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, start FROM s""")
def f19_rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each request when a host gets one every 8 seconds: greatest of arrival and the last start + 8 s.

    The recurrence has the closed form k * 8 s + running maximum of (arrival - k * 8 s), which is a window.
    """
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at, wait = F.unix_micros(F.col("ts").cast("timestamp")), 8_000_000
    k = F.row_number().over(by)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", at.alias("at"), (k * F.lit(wait)).cast("long").alias("turn"))
    start = F.max(F.col("at") - F.col("turn")).over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("turn")
    return rows.select("event_id", start.alias("start"))


@query("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), nullif(o_orderpriority, '')) AS picked, left(o_orderpriority, 3) AS short,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS published FROM orders""")
def p02_pick_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.nullif(F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.col("o_orderstatus")), F.lit(""))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.coalesce(first, F.nullif("o_orderpriority", F.lit(""))).alias("picked"),
        F.substring("o_orderpriority", 1, 3).alias("short"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
    )


@query("""SELECT s_suppkey, s_name, count(l_orderkey) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW' GROUP BY ALL""")
def j03_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    items = table(spark, sf_dir, "lineitem").join(low, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = items.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_suppkey", "s_name").agg(F.count("l_orderkey").alias("n"))


@query("""WITH k AS (SELECT c_custkey AS org, c_name AS name, CAST(c_custkey AS VARCHAR) AS code FROM customer),
 q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS code, c_name || CASE WHEN o_orderkey % 3 = 2 THEN '?' ELSE '' END AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT q.id, CASE WHEN a.org IS NOT NULL THEN 'code' WHEN b.org IS NOT NULL THEN 'name' ELSE 'none' END AS by, coalesce(a.org, b.org) AS org FROM q LEFT JOIN k a ON q.code = a.code LEFT JOIN k b ON q.name = b.name""")
def j08_resolve_organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit code first, then exact normalised name: equi joins in order of priority."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("code"))
    asked = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey") % 3
    asked = asked.select(F.col("o_orderkey").alias("id"), F.when(key == 0, F.col("o_custkey").cast("string")).alias("code"), F.concat("c_name", F.when(key == 2, "?").otherwise("")).alias("name"))
    by_code = asked.join(known.select("code", F.col("org").alias("a")), "code", "left")
    both = by_code.join(known.select("name", F.col("org").alias("b")), "name", "left")
    how = F.when(F.col("a").isNotNull(), "code").when(F.col("b").isNotNull(), "name").otherwise("none")
    return both.select("id", how.alias("by"), F.coalesce("a", "b").alias("org"))


@query("""WITH p AS (SELECT doc_id, max_by(quality, toxic) AS pred FROM labels GROUP BY doc_id) SELECT d.doc_id, pred, pred IS NULL AS missing FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""")
def j10_prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max_by("quality", "toxic").alias("pred"))
    return table(spark, sf_dir, "documents").select("doc_id").join(last, "doc_id", "left").withColumn("missing", F.col("pred").isNull())


@query("""SELECT event_type, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-31' - 30) AS n, count(DISTINCT CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) > DATE '2024-01-31' - 30) AS active_days FROM events GROUP BY event_type""")
def a13_active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.to_date("ts") > F.date_sub(F.lit("2024-01-31").cast("date"), 30), F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(day).alias("n"), F.count_distinct(day).alias("active_days"))


@query("""SELECT CASE WHEN regexp_matches(lower(p_type), 'steel|tin') THEN 'metal' ELSE 'other' END AS category, count(*) AS n, sum(p_size)::BIGINT::DOUBLE / count(*) AS mean_size FROM part GROUP BY 1""")
def a18_category_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.lower("p_type").rlike("steel|tin"), "metal").otherwise("other").alias("category")
    return table(spark, sf_dir, "part").groupBy(kind).agg(F.count("*").alias("n"), (F.sum("p_size") / F.count("*")).alias("mean_size"))


@query("""WITH d AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS recall FROM lineitem GROUP BY l_orderkey),
 b AS (SELECT l_orderkey, recall, CASE WHEN recall = 0 THEN '0' WHEN recall < 0.5 THEN '<.5' WHEN recall < 0.8 THEN '<.8' WHEN recall < 1 THEN '<1' ELSE '1' END AS bucket FROM d)
SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def a26_recall_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("recall"))
    r = F.col("recall")
    bucket = F.when(r == 0, "0").when(r < 0.5, "<.5").when(r < 0.8, "<.8").when(r < 1, "<1").otherwise("1")
    return share.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT lang, source, sum(n_chars)::BIGINT AS chars, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, count(*) AS sources, sum(chars)::BIGINT AS chars, max(n) AS most FROM d GROUP BY lang UNION ALL SELECT 'all', count(*), sum(chars)::BIGINT, max(n) FROM d""")
def a24_by_type_and_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and their total in one pass, by rollup."""
    each = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    rolled = each.rollup("lang").agg(F.count("*").alias("sources"), F.sum("chars").alias("chars"), F.max("n").alias("most"), F.grouping("lang").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("lang"), "sources", "chars", "most")


@query("""WITH d AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, n, f::DOUBLE / n AS rate FROM d ORDER BY rate, n DESC, l_orderkey LIMIT 10""")
def a28_worst_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    return sums.select("l_orderkey", "n", (F.col("f") / F.col("n")).alias("rate")).orderBy("rate", F.desc("n"), "l_orderkey").limit(10)


@query("""SELECT source, lang, count(*) AS n, grouping(lang) AS total FROM documents GROUP BY GROUPING SETS ((source, lang), (source))""")
def a31_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "documents").groupingSets([["source", "lang"], ["source"]], "source", "lang")
    return sets.agg(F.count("*").alias("n"), F.grouping("lang").cast("long").alias("total"))


@query("""WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey),
 w AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag = 'N')
SELECT w.l_orderkey, w.l_linenumber, coalesce(top, 0) + k AS sequence FROM w LEFT JOIN m ON w.l_orderkey = m.l_orderkey""")
def w03_next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    links = items.filter("l_returnflag <> 'N'").select("l_orderkey", F.col("l_linenumber").alias("sequence"))
    new = items.filter("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("o"))
    return versions.next_sequence(links, new, "l_orderkey", "o").select("l_orderkey", "l_linenumber", F.col("sequence").cast("long").alias("sequence"))


@query("""SELECT s_nationkey, list_sort(list(r))[CAST(floor(count(*) * 0.025) AS BIGINT) + 1] AS low, list_sort(list(r))[CAST(floor(count(*) * 0.975) AS BIGINT)] AS high
FROM (SELECT s_nationkey, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_nationkey) GROUP BY s_nationkey""")
def k10_order_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of an interval as elements int(n * .025) and int(n * .975) - 1 of the sorted rates of each nation."""
    rates = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("r"))
    named = rates.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    by = Window.partitionBy("s_nationkey")
    ranked = named.select("s_nationkey", "r", F.row_number().over(by.orderBy("r")).alias("k"), F.count("*").over(by).alias("n"))
    at = lambda p, off: F.max(F.when(F.col("k") == F.floor(F.col("n") * p) + off, F.col("r")))
    return ranked.groupBy("s_nationkey").agg(at(0.025, 1).alias("low"), at(0.975, 0).alias("high"))


@query("""SELECT event_id, CASE WHEN k >= 90 THEN 90.0::DOUBLE END AS parsed FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def n30_first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.when(k >= 90, F.lit("约 90.0 万元")).otherwise(F.lit("未公布"))
    return table(spark, sf_dir, "events").select("event_id", v.first_number(text).alias("parsed"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '某某·公司' ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'enterprise' ELSE 'unknown' END AS kind FROM customer""")
def n20_org_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit(" 某某•公司（上海）(旧) ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("（原名）")))
    return table(spark, sf_dir, "customer").select("c_custkey", v.org_name(raw).alias("name"), v.org_type(v.org_name(raw)).alias("kind"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'tender' WHEN 'F' THEN 'cancellation' ELSE 'other' END AS kind FROM orders""")
def n32_notice_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "F", "cancel").when(F.col("o_orderstatus") == "P", "P")
    return table(spark, sf_dir, "orders").select("o_orderkey", v.notice_kind(said).alias("kind"))


@query("""SELECT a.doc_id, substr(sha256(a.lang || '|' || a.source), 1, 16) AS grp FROM documents a""")
def l02_source_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", lineage.source_group(F.col("lang"), F.col("source")).alias("grp"))


@query("""WITH p AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 45), RECURSIVE_ AS (SELECT 1) SELECT count(DISTINCT l_suppkey) AS n_orgs FROM p""")
def l14_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations in clusters of shared large awards; each is in one cluster."""
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("b"))
    first = big.groupBy("o").agg(F.min("b").alias("a"))
    clusters = lineage.repost_clusters(big.join(first, "o").select("a", "b").distinct())
    return clusters.agg(F.count_distinct("id").alias("n_orgs"))


@query(f"""WITH {SIMHASH_SQL} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.fp, b.fp)::UBIGINT::HUGEINT) AS INT) AS distance
FROM f a JOIN f b ON b.doc_id < a.doc_id AND bit_count(xor(a.fp, b.fp)::UBIGINT::HUGEINT) <= 3 WHERE a.fp <> 0 AND b.fp <> 0""")
def j07_repost_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All earlier near texts of each text."""
    return simhash.near_rows(fingerprints(spark, sf_dir)).select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")


@query("""SELECT event_id, user_id FROM events WHERE user_id <> 7""")
def d08_delete_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.delete_user_data({"events": table(spark, sf_dir, "events")}, 7)["events"].select("event_id", "user_id")


@query("""SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN url END AS snapshot_path FROM pages""")
def d07_forget_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("snapshot_path"))
    return deletes.forget_snapshots(pages, F.col("page_id") % 4 == 0)


@query(f"""WITH {NOTICES_SQL}, s AS (SELECT notice_type, sum(CAST(budget AS DECIMAL(18,2)))::DOUBLE AS budget, count(*) AS n FROM notices
 WHERE publish_time >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 730 DAY GROUP BY notice_type) SELECT * FROM s""")
def x01_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = notices(spark, sf_dir).filter(f.recent("publish_time", ORDERS_AS_OF, 730))
    return fresh.groupBy("notice_type").agg(F.sum(money("budget")).cast("double").alias("budget"), F.count("*").alias("n"))


@query("SELECT doc_id, left(text, 500) AS head FROM documents")
def x02_text_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("head"))


@query("""WITH s AS (SELECT source, sum(quality)::BIGINT AS good, count(*) AS n FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source) SELECT source, good::DOUBLE / n AS point FROM s""")
def m14_score_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg((F.sum("quality") / F.count("*")).alias("point"))


@query()
def m10_project_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of returned items over suppliers as projects."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("hit"), F.lit(1).alias("one"))
    return metrics.bootstrap(items, "l_suppkey", "hit", "one", 400)
