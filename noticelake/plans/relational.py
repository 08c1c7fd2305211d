"""Registered queries: filters, joins, aggregates, order and set operations over notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.operators import filters as f
from noticelake.sources.tables import AWARDS_SQL, EVENTS_AS_OF, NOTICES_SQL, ORDERS_AS_OF, awards, money, notices, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that states its result."""

    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def big(column):
    return F.sum(column).cast("long")


@query(f"""WITH {NOTICES_SQL}, pushed AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0),
 open AS (SELECT * FROM notices WHERE publish_time >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY AND id NOT IN (SELECT id FROM pushed))
SELECT id, purchaser, location, notice_type, strftime(publish_time, '%Y-%m-%d') AS published, budget, (SELECT count(*) FROM open) AS total
FROM open ORDER BY publish_time DESC, id DESC LIMIT 100""")
def j04_unpushed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of the last 90 days that are not in a subscription's log: newest 100 and their total."""
    log = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    fresh = notices(spark, sf_dir).filter(f.recent("publish_time", ORDERS_AS_OF, 90)).join(log, "id", "left_anti")
    total = fresh.agg(F.count("*").alias("total"))
    newest = fresh.orderBy(F.desc("publish_time"), F.desc("id")).limit(100)
    joined = newest.join(F.broadcast(total))  # one row
    return joined.select("id", "purchaser", "location", "notice_type", day("publish_time").alias("published"), "budget", "total")


@query(f"WITH {NOTICES_SQL} SELECT id, purchaser FROM notices WHERE notice_type = 'award' AND region = 'ASIA'")
def f01_equality_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = f.equals_given({"notice_type": "award", "region": "ASIA", "location": None})
    return notices(spark, sf_dir).filter(wanted).select("id", "purchaser")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license') OR contains(lower(text), '100%')")
def f02_literal_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(f.any_keyword(["text"], ["Apache License", "100%"])).select("doc_id")


@query(f"WITH {NOTICES_SQL} SELECT id, purchaser, region FROM notices WHERE lower(purchaser) LIKE '%0_1%' OR lower(region) LIKE '%0_1%'")
def f03_unescaped_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = f.like_word("purchaser", "0_1") | f.like_word("region", "0_1")
    return notices(spark, sf_dir).filter(hit).select("id", "purchaser", "region")


@query(f"""WITH {NOTICES_SQL} SELECT id, budget FROM notices WHERE publish_time BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'
 AND budget BETWEEN 100000 AND 200000""")
def f04_closed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = f.between_given("publish_time", "1998-01-01", "1998-12-31")
    return notices(spark, sf_dir).filter(when & f.between_given("budget", 100000.0, 200000.0)).select("id", "budget")


@query(f"WITH {NOTICES_SQL} SELECT id, notice_type FROM notices WHERE notice_type IN ('award', 'correction')")
def f05_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.in_list(notices(spark, sf_dir), "notice_type", ["award", "correction"]).select("id", "notice_type")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def f06_keyword_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(f.any_keyword(["text", "source"], ["License", "token"])).select("doc_id", "source")


@query(f"""WITH {NOTICES_SQL}, kept AS (SELECT id FROM notices WHERE contains(lower(purchaser), '00001')
 AND (contains(lower(location), 'nation') OR contains(lower(region), 'asia') OR contains(lower(purchaser), 'asia')))
SELECT id FROM kept""")
def f07_region_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = ["purchaser", "location", "region"]
    return f.keywords_and_region(notices(spark, sf_dir), ["00001"], ["nation", "ASIA"], ["purchaser"], places).select("id")


@query(f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE false")
def f08_empty_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.keywords_and_region(notices(spark, sf_dir), [], [], ["purchaser"], ["region"]).select("id")


@query(f"""WITH {NOTICES_SQL} SELECT id, location FROM notices WHERE (contains(lower(purchaser), '7') OR contains(lower(location), '1')
 OR contains(lower(region), 'america')) AND notice_type IN ('tender')""")
def f09_loose_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = f.any_of([f.contains_word("purchaser", "7"), f.contains_word("location", "1"), f.contains_word("region", "AMERICA")])
    return f.in_list(notices(spark, sf_dir).filter(loose), "notice_type", ["tender"]).select("id", "location")


@query(f"""WITH {NOTICES_SQL} SELECT notice_type, count(*) AS n, min(strftime(publish_time, '%Y-%m-%d')) AS first_day FROM notices
WHERE publish_time >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 365 DAY GROUP BY notice_type""")
def f11_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = notices(spark, sf_dir).filter(f.recent("publish_time", ORDERS_AS_OF, 365))
    return fresh.groupBy("notice_type").agg(F.count("*").alias("n"), F.min(day("publish_time")).alias("first_day"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_day FROM events
WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def f12_parse_fail_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency over dates held as text: what does not parse is dropped."""
    text = F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("n/a"))
    events = table(spark, sf_dir, "events").withColumn("at", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    return events.filter(f.recent("at", EVENTS_AS_OF, 7)).select("event_id", day("at").alias("event_day"))


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^(www|m|wap|mobile)\.', '')"


@query(f"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), d(domain, active) AS (VALUES ('example.com', true), ('example.org', false))
SELECT page_id, host, domain, coalesce(active, false) AS allowed FROM h LEFT JOIN d ON host = domain OR ends_with(host, '.' || domain)""")
def f18_host_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts under listed domains by an equi join on all their suffixes."""
    domains = spark.createDataFrame([("example.com", True), ("example.org", False)], "domain string, active boolean")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return f.whitelist_verdict(pages.dropDuplicates(["url"]), domains).join(pages.withColumnRenamed("page_id", "p"), "url").select(
        F.col("p").alias("page_id"), "host", "domain", "allowed"
    )


@query("""WITH g(display_grade, support_level) AS (SELECT * FROM (VALUES ('high'), ('review'), ('low')) a(x),
 (VALUES ('direct'), ('equivalent'), ('inferred'), ('unsupported')) b(y)), k AS (SELECT doc_id,
  CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'review' ELSE 'low' END AS display_grade,
  CASE doc_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'inferred' ELSE 'unsupported' END AS support_level FROM labels)
SELECT count(*) FILTER (display_grade = 'high') AS n_strict,
 count(*) FILTER (display_grade = 'high' OR (display_grade = 'review' AND support_level IN ('direct', 'equivalent'))) AS n_default,
 count(*) FILTER (display_grade IN ('high', 'review')) AS n_loose, count(*) AS n_audit FROM k""")
def f13_strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    graded = table(spark, sf_dir, "labels").select(
        pick(("high", "review", "low"), 3).alias("display_grade"), pick(("direct", "equivalent", "inferred", "unsupported"), 4).alias("support_level")
    )
    return graded.agg(*(F.count_if(f.strategy_keeps(s)).alias(f"n_{s}") for s in ("strict", "default", "loose", "audit")))


@query("""SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R' AND o_orderstatus = 'F'""")
def j01_fields_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    kept = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return kept.join(fields, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT o_orderkey, count(*) AS n_evidence, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS evidence
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def j02_nested_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per notice with its evidence in order of sequence, by one join."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    text = F.transform(listed, lambda e: F.concat_ws(":", e["l_linenumber"].cast("string"), e["l_returnflag"]))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n_evidence"), F.array_join(text, ",").alias("evidence"))


@query("""SELECT o_orderkey, (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS known FROM orders""")
def j05_existing_url_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    known, new = orders.join(existing, "o_custkey", "left_semi"), orders.join(existing, "o_custkey", "left_anti")
    return known.select("o_orderkey", F.lit(True).alias("known")).unionByName(new.select("o_orderkey", F.lit(False).alias("known")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j13_todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def j14_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_partkey"))


@query("""SELECT c_custkey AS org_id, substr(sha256(c_name), 1, 16) AS org_hash, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey, c_name""")
def j12_org_hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse look-up of hashed names by a precomputed hash and an equi join."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 16).alias("org_hash"))
    seen = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = seen.groupBy(F.substring(F.sha2("c_name", 256), 1, 16).alias("org_hash")).agg(F.count("o_orderkey").alias("n"))
    return names.join(counts, "org_hash").select(F.col("c_custkey").alias("org_id"), "org_hash", "n")


@query(f"WITH {NOTICES_SQL} SELECT count(*) AS total FROM notices WHERE notice_type = 'tender' AND budget >= 50000")
def a01_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).filter(f.equals_given({"notice_type": "tender"}) & f.between_given("budget", 50000.0)).agg(F.count("*").alias("total"))


@query(f"WITH {NOTICES_SQL} SELECT platform, notice_type, count(*) AS n FROM notices GROUP BY platform, notice_type")
def a02_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).groupBy("platform", "notice_type").agg(F.count("*").alias("n"))


@query(f"""WITH {NOTICES_SQL} SELECT coalesce(sum(CAST(budget AS DECIMAL(18,2))), 0)::DOUBLE AS total,
 coalesce(sum(CAST(budget AS DECIMAL(18,2))) FILTER (notice_type = 'none'), 0)::DOUBLE AS none FROM notices""")
def a03_budget_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    none = F.sum(F.when(F.col("notice_type") == "none", money("budget")))
    return notices(spark, sf_dir).agg(zero(F.sum(money("budget"))).alias("total"), zero(none).alias("none"))


@query("""SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS n_direct, count(*) FILTER (l_returnflag = 'R') AS n_inferred,
 count(DISTINCT l_orderkey) AS n_notices, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) END AS verified
FROM lineitem""")
def a04_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, verified = F.count("*"), F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").agg(
        total.alias("n"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_direct"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_inferred"),
        F.count_distinct("l_orderkey").alias("n_notices"),
        F.when(total == 0, 0.0).otherwise(verified / total).alias("verified"),
    )


@query(f"""WITH {NOTICES_SQL}, {AWARDS_SQL} SELECT name, count(*) AS n FROM (SELECT purchaser AS name FROM notices UNION ALL SELECT winner FROM awards)
GROUP BY name""")
def a05_org_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = notices(spark, sf_dir).select(F.col("purchaser").alias("name"))
    return bought.unionByName(awards(spark, sf_dir).select(F.col("winner").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query(f"""WITH {NOTICES_SQL}, c AS (SELECT purchaser, count(*) AS n FROM notices GROUP BY purchaser), t AS (SELECT count(*) AS total FROM notices)
SELECT purchaser, n, n::DOUBLE / total AS share FROM c, t ORDER BY n DESC, purchaser LIMIT 3""")
def a06_top3_purchasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    top = rows.groupBy("purchaser").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "purchaser").limit(3)
    return top.join(F.broadcast(total)).select("purchaser", "n", (F.col("n") / F.col("total")).alias("share"))


@query(f"""WITH {AWARDS_SQL} SELECT purchaser, count(*) AS n, sum(CAST(win_amount AS DECIMAL(18,2)))::DOUBLE AS amount FROM awards GROUP BY purchaser
ORDER BY amount DESC, purchaser LIMIT 3""")
def a07_top3_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = awards(spark, sf_dir).groupBy("purchaser").agg(F.count("*").alias("n"), F.sum(money("win_amount")).cast("double").alias("amount"))
    return sums.orderBy(F.desc("amount"), "purchaser").limit(3)


@query("""WITH d AS (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2024-01-31' - INTERVAL 89 DAY, DATE '2024-01-31', INTERVAL 1 DAY) t(x)),
 c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT strftime(d.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.d = c.d""")
def a08_daily_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last 90 days, days without events included."""
    last = F.to_date(F.lit(EVENTS_AS_OF))
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 89), last)).alias("d"))
    counts = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return days.join(counts, "d", "left").select(day("d").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {NOTICES_SQL}, {AWARDS_SQL}, b AS (SELECT purchaser AS org, count(*) AS n_bought, sum(CAST(budget AS DECIMAL(18,2))) AS bought,
 count(*) FILTER (contains(notice_type, 'award')) AS n_award FROM notices GROUP BY purchaser)
SELECT org, n_bought, n_award, bought::DOUBLE AS bought FROM b""")
def a10_role_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).groupBy(F.col("purchaser").alias("org")).agg(
        F.count("*").alias("n_bought"),
        F.count_if(F.contains(F.col("notice_type"), F.lit("award"))).alias("n_award"),
        F.sum(money("budget")).cast("double").alias("bought"),
    )


@query(f"""WITH {NOTICES_SQL}, s AS (SELECT purchaser, notice_type IS NOT NULL AND notice_type <> 'correction' AS a, budget > 100000 AS b, region = 'ASIA' AS c FROM notices)
SELECT purchaser, 100.0 * sum(a::INT + b::INT + c::INT)::BIGINT / (3 * count(*)) AS completeness,
 concat_ws(',', CASE WHEN NOT bool_or(a) THEN 'type' END, CASE WHEN NOT bool_or(b) THEN 'budget' END, CASE WHEN NOT bool_or(c) THEN 'region' END) AS missing
FROM s GROUP BY purchaser""")
def a11_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of filled slots per organisation and the slots that it never fills."""
    slots = {"type": (F.col("notice_type") != "correction"), "budget": F.col("budget") > 100000, "region": F.col("region") == "ASIA"}
    filled = sum(F.coalesce(c, F.lit(False)).cast("int") for c in slots.values())
    missing = F.concat_ws(",", *(F.when(~F.bool_or(F.coalesce(c, F.lit(False))), F.lit(k)) for k, c in slots.items()))
    return notices(spark, sf_dir).groupBy("purchaser").agg(
        (F.lit(100.0) * F.sum(filled) / (3 * F.count("*"))).alias("completeness"), missing.alias("missing")
    )


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d') || ' - ' || strftime(max(ts), '%Y-%m-%d') AS range,
 count(DISTINCT CAST(ts AS DATE)) AS active_days FROM events GROUP BY user_id""")
def a12_ingest_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.concat(day(F.min("ts")), F.lit(" - "), day(F.max("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(span.alias("range"), F.count_distinct(F.to_date("ts")).alias("active_days"))


@query("""SELECT event_type AS platform, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS today, count(*) FILTER (value < 10) AS failed,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_fetch FROM events GROUP BY event_type""")
def a14_collector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("platform")).agg(
        F.count_if(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("today"),
        F.count_if(F.col("value") < 10).alias("failed"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_fetch"),
    )


@query("""SELECT event_id, coalesce(nullif(CAST(json_extract(props, '$.total') AS BIGINT), 0), CAST(json_extract(props, '$.k') AS BIGINT)) AS n
FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 5""")
def a15_json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda p: F.get_json_object("props", p).try_cast("long")
    done = table(spark, sf_dir, "events").filter("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)
    return done.select("event_id", F.coalesce(F.nullif(get("$.total"), F.lit(0)), get("$.k")).alias("n"))


@query(f"""WITH {AWARDS_SQL}, p AS (SELECT winner, purchaser, count(*) AS n FROM awards GROUP BY ALL),
 r AS (SELECT winner, purchaser, n, row_number() OVER (PARTITION BY winner ORDER BY n DESC, purchaser) AS k FROM p),
 t AS (SELECT winner, string_agg(purchaser, ',' ORDER BY k) AS main_purchasers FROM r WHERE k <= 5 GROUP BY winner),
 s AS (SELECT winner, count(*) AS n, sum(CAST(win_amount AS DECIMAL(18,2)))::DOUBLE AS amount, strftime(min(win_date), '%Y-%m-%d') AS first_day,
  strftime(max(win_date), '%Y-%m-%d') AS last_day FROM awards GROUP BY winner)
SELECT s.*, main_purchasers FROM s JOIN t ON s.winner = t.winner""")
def a16_supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = awards(spark, sf_dir).groupBy("winner", "purchaser").agg(
        F.count("*").alias("n"), F.sum(money("win_amount")).alias("amount"), F.min("win_date").alias("first"), F.max("win_date").alias("last")
    )
    rank = Window.partitionBy("winner").orderBy(F.desc("n"), "purchaser")
    top = F.when(F.col("k") <= 5, F.struct("k", "purchaser"))
    return (
        each.withColumn("k", F.row_number().over(rank))
        .groupBy("winner")
        .agg(
            big("n").alias("n"), F.sum("amount").cast("double").alias("amount"), day(F.min("first")).alias("first_day"), day(F.max("last")).alias("last_day"),
            F.array_join(F.transform(F.sort_array(F.collect_list(top)), lambda x: x["purchaser"]), ",").alias("main_purchasers"),
        )
    )


@query("""SELECT source, count(*) AS total, count(DISTINCT text) AS inserted, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source""")
def a17_ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("m"))
    return once.groupBy("source").agg(big("m").alias("total"), F.count("*").alias("inserted"), (big("m") - F.count("*")).alias("duplicates"))


@query("""WITH d AS (SELECT count(*) AS n, count(DISTINCT text) AS u FROM documents), l AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good,
 count(*) FILTER (toxic = 1) AS bad FROM labels)
SELECT 1 - u::DOUBLE / d.n AS dedup_rate, good::DOUBLE / l.n AS pass_rate, bad::DOUBLE / l.n AS penalty,
 ((1 - u::DOUBLE / d.n) + good::DOUBLE / l.n) / 2 * (1 - bad::DOUBLE / l.n) AS score FROM d, l""")
def a19_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("m")).agg(big("m").alias("n"), F.count("*").alias("u"))
    marks = table(spark, sf_dir, "labels").agg(F.count("*").alias("m"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad"))
    both = docs.join(F.broadcast(marks)).select((1 - F.col("u") / F.col("n")).alias("dedup_rate"), (F.col("good") / F.col("m")).alias("pass_rate"), (F.col("bad") / F.col("m")).alias("penalty"))
    return both.withColumn("score", (F.col("dedup_rate") + F.col("pass_rate")) / 2 * (1 - F.col("penalty")))


@query(f"""WITH {NOTICES_SQL} SELECT notice_type, sum(CAST(nullif(budget, 0) AS DECIMAL(18,2)))::DOUBLE AS total, count(nullif(budget, 0)) AS n,
 string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM notices GROUP BY notice_type""")
def a20_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("budget") != 0, money("budget"))
    return notices(spark, sf_dir).groupBy("notice_type").agg(
        F.sum(paid).cast("double").alias("total"), F.count(paid).alias("n"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms")
    )


@query(f"WITH {NOTICES_SQL} SELECT id, budget FROM notices ORDER BY budget DESC, id LIMIT 3")
def a21_top3_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).orderBy(F.desc_nulls_last("budget"), "id").limit(3).select("id", "budget")


@query(f"WITH {NOTICES_SQL} SELECT id, strftime(publish_time, '%Y-%m-%d') AS deadline FROM notices ORDER BY deadline, id LIMIT 3")
def a22_next_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", day("publish_time").alias("deadline")).orderBy("deadline", "id").limit(3)


@query("SELECT DISTINCT lang, source FROM documents")
def a32_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query(f"WITH {NOTICES_SQL} SELECT id, strftime(publish_time, '%Y-%m-%d') AS published FROM notices ORDER BY publish_time DESC, id LIMIT 20 OFFSET 40")
def k01_page_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).orderBy(F.desc("publish_time"), "id").offset(40).limit(20).select("id", day("publish_time").alias("published"))


@query("SELECT o_orderkey AS id FROM orders ORDER BY id DESC LIMIT 20 OFFSET 20")
def k02_page_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).orderBy(F.desc("id")).offset(20).limit(20)


@query("""WITH o(k, name) AS (VALUES (1, 'purchase'), (2, 'refund'), (3, 'view'), (4, 'signup')), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT k, name, coalesce(n, 0) AS n, n IS NULL AS absent FROM o LEFT JOIN c ON name = event_type""")
def k07_fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in a fixed order, with a placeholder for each that is absent."""
    order = spark.createDataFrame([(1, "purchase"), (2, "refund"), (3, "view"), (4, "signup")], "k int, name string")
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return order.join(counts, "name", "left").select("k", "name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("absent"))


@query("""SELECT DISTINCT l_suppkey AS a, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500 UNION ALL SELECT -1, count(*) FROM lineitem""")
def t05_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    large = items.groupBy(F.col("l_suppkey").alias("a")).agg(F.count("*").alias("n")).filter("n > 500")
    return large.unionByName(items.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("a"), "n"))


@query("""SELECT count(*) FILTER (s = 2) AS overlap, count(*) FILTER (s = 1) AS single FROM (SELECT doc_id, count(DISTINCT part) AS s FROM
 (SELECT doc_id, 'a' AS part FROM labels UNION ALL SELECT doc_id, 'b' FROM documents) GROUP BY doc_id)""")
def t01_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit("a").alias("part"))
    both = a.unionByName(table(spark, sf_dir, "documents").select("doc_id", F.lit("b").alias("part"))).groupBy("doc_id").agg(F.count_distinct("part").alias("s"))
    return both.agg(F.count_if(F.col("s") == 2).alias("overlap"), F.count_if(F.col("s") == 1).alias("single"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_shipdate DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1""")
def w01_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record per key by one aggregation, without a window's sort."""
    last = F.max(F.struct("l_shipdate", "l_linenumber"))["l_linenumber"]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(last.alias("l_linenumber"))


@query(f"""WITH {AWARDS_SQL}, c AS (SELECT winner, region, count(*) AS n FROM awards GROUP BY ALL)
SELECT winner, region, n, k FROM (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY n DESC, region) AS k FROM c) WHERE k <= 3""")
def w04_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = awards(spark, sf_dir).groupBy("winner", "region").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("winner").orderBy(F.desc("n"), "region")).cast("long")).filter("k <= 3")


@query("""SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS origin FROM orders""")
def w05_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.first("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", first.alias("origin"))


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT (SELECT count(*) FROM orders) AS notices_before, (SELECT count(*) FROM gone) AS notices_deleted,
 (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone)) AS fields_deleted,
 (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)) AS fields_kept""")
def d04_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion of a platform's notices and of what hangs on them: true counts."""
    from noticelake.operators.deletes import cascade

    tables = {"notices": table(spark, sf_dir, "orders"), "fields": table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")}
    kept, audit = cascade(tables, "notices", "o_orderkey", F.col("o_orderpriority") == "1-URGENT")
    before = tables["notices"].agg(F.count("*").alias("notices_before"))
    one = audit.agg(F.max(F.when(F.col("table") == "notices", F.col("deleted"))).alias("notices_deleted"), F.max(F.when(F.col("table") == "fields", F.col("deleted"))).alias("fields_deleted"))
    return before.join(F.broadcast(one)).join(F.broadcast(kept["fields"].agg(F.count("*").alias("fields_kept"))))
