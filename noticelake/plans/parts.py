"""Registered queries over parsers and displays: lots, timestamps, categories, shown amounts, platforms, bodies, fields of notices, due schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import notice_text, schedules
from noticelake.functions import scoring as sc
from noticelake.functions import text as tx
from noticelake.functions import values as v
from noticelake.operators.organisations import resolved_names
from noticelake.plans.scoring import pick
from noticelake.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


@query("""WITH l AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, (total * 10000)::DOUBLE AS lot_sum, l_orderkey % 4 = 0 AS differs FROM l""")
def v02_lot_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of each order, in ten thousands, against its total, which is a lot too much for every fourth; an order has few lots."""
    lots = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("万元"))).alias("lots"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    total = F.concat((F.col("total") + F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(0)).cast("string"), F.lit(".00万元"))
    told = v.lots_verdict(total, F.col("lots"))
    return lots.select("l_orderkey", told["lot_sum"].alias("lot_sum"), told["differs"].alias("differs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL WHEN o_orderkey % 8 IN (0, 3) THEN strftime(o_orderdate, '%Y-%m-%d') || ' 08:05:09' WHEN o_orderkey % 8 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 08:05:00' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS at FROM orders""")
def n14_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in the seven spellings, and one that is none."""
    day = lambda shape: F.date_format("o_orderdate", shape)
    text = pick(
        F.col("o_orderkey"), F.concat(day("yyyy-MM-dd"), F.lit(" 08:05:09")), F.concat(day("yyyy-M-d"), F.lit(" 8:5")), day("yyyy-MM-dd"), F.concat(day("yyyy/MM/dd"), F.lit(" 08:05:09")),
        day("yyyy/M/d"), day("yyyy年M月d日"), day("yyyy.MM.dd"), F.concat(F.lit("x"), day("yyyyMM")),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(v.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name || p_type), 'it') THEN 'IT' WHEN p_partkey % 4 = 0 THEN '工程' ELSE '其他' END AS category FROM part""")
def n23_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", "p_type", F.when(F.col("p_partkey") % 4 == 0, F.lit("装修")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", v.category(text).alias("category"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 10000 ELSE 100000000 END AS k, l_orderkey % 11 = 0 AS none FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN none THEN '-' ELSE q || '.00' || CASE k WHEN 1 THEN '元' WHEN 10000 THEN '万元' ELSE '亿元' END END AS shown FROM x""")
def n31_amount_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity").cast("long") * pick(F.col("l_linenumber"), F.lit(1.0), F.lit(1e4), F.lit(1e8)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.amount_shown(value).alias("shown"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'commercial' ELSE 'unknown' END AS kind FROM pages""")
def n33_platform_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(F.col("page_id"), F.concat(F.lit("CCGP:"), "url"), F.concat(F.lit("zhaobiao:"), "url"), F.concat(F.lit("web:gov"), "url"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", v.platform_type(name).alias("kind"))


@query("""SELECT doc_id, length('## x' || chr(10) || replace(text, chr(10), ' ') || chr(10) || 'last') AS n FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) = text AND text <> ''""")
def n36_clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies cut out of files that hold a head, noise lines and what follows the body."""
    blanks = " \t\n\r"
    docs = table(spark, sf_dir, "documents").filter((F.btrim("text", F.lit(blanks)) == F.col("text")) & (F.col("text") != ""))
    body = F.concat(F.lit("# t\n# URL: u\n## x\n分享 to\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n打印\nlast\n附件: a\nmore"))
    return docs.select("doc_id", F.length(tx.clean_body(body)).cast("long").alias("n"))


@query("""SELECT o_orderkey, c_name AS tender_org, 'BH-' || o_orderkey AS bid_number, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey * 10000)::DOUBLE END AS budget_amount, 'tender' AS notice_type FROM orders JOIN customer ON o_custkey = c_custkey""")
def p20_notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields parsed out of texts that state them."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(
        F.lit("采购单位：" ), "c_name", F.lit(" 行政区域：某市 项目编号：BH-"), F.col("o_orderkey").cast("string"), F.lit("，"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("预算金额："), F.col("o_custkey").cast("string"), F.lit("万元，"))).otherwise(F.lit("")),
    )
    parsed = rows.select("o_orderkey", notice_text.fields(text, F.lit("招标公告")).alias("f"))
    return parsed.select("o_orderkey", "f.tender_org.value", "f.bid_number.value", "f.budget_amount", "f.notice_type").toDF("o_orderkey", "tender_org", "bid_number", "budget_amount", "notice_type")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS kept FROM orders""")
def p22_fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pick(F.col("o_orderkey"), F.col("o_orderpriority"), F.lit(""), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", notice_text.fill_empty(own, F.col("o_orderstatus")).alias("kept"))


@query("""SELECT user_id, count(*) FILTER (hour(ts) < 8) > 0 AS ran, count(*) FILTER (event_type IS NOT NULL) AS n FROM events GROUP BY user_id""")
def st02_due_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of whose events any precedes the daily run at eight: the schedule is evaluated once an hour of the day, on the driver."""
    day = datetime(2024, 1, 2)
    due = [h for h in range(24) if schedules.due("0 8 * * *", day.replace(hour=h), day.replace(hour=8))]
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.hour("ts").isin(*due)) > 0).alias("ran"), F.count("event_type").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 4 <> 3 AS valid, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS BIGINT) || '.00元' WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN 'BH-' || (100000 + l_orderkey) END AS normalized FROM lineitem""")
def v07_field_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of four kinds, one of them unknown, by their validators."""
    line = F.col("l_linenumber")
    kind = pick(line, *map(F.lit, ("amount", "date", "project_identifier", "colour")))
    raw = pick(
        line, F.concat(F.lit("金额："), F.col("l_quantity").cast("long").cast("string"), F.lit("元")), F.date_format("l_shipdate", "yyyy.M.d"),
        F.concat(F.lit("bh-"), (F.col("l_orderkey") + 100_000).cast("string"), F.lit("（一标段）")), F.lit("red"),
    )
    told = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("l_linenumber"), sc.validate_field(kind, raw).alias("f"))
    return told.select("l_orderkey", "l_linenumber", "f.valid", "f.normalized")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE c_name END AS name FROM orders JOIN customer ON o_custkey = c_custkey""")
def n42_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of organisations that are asked for by entity id, by hash, by name, or by something unknown."""
    entities = table(spark, sf_dir, "customer").select(F.upper(F.lpad(F.concat(F.lit("E"), F.col("c_custkey").cast("string")), 26, "A")).alias("organization_id"), F.col("c_name").alias("name"), "c_custkey")
    asked = table(spark, sf_dir, "orders").join(entities, F.col("o_custkey") == F.col("c_custkey"))
    hashed = F.concat(F.lit("org_"), F.substring(F.sha1("name"), 1, 12))
    asked = asked.select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), F.col("organization_id"), hashed, F.col("name"), F.lit("org_000000000000")).alias("org_id"))
    return resolved_names(asked, entities).select(F.col("id").alias("o_orderkey"), "name")


@query("""SELECT o_orderkey, 'P ' || o_orderpriority AS project_name, 'BH-' || (100000 + o_orderkey) AS bid_number, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey * 10000)::DOUBLE END AS budget_amount, strftime(o_orderdate, '%Y-%m-%d') AS deadline,
 c_name AS tender_org, CASE WHEN o_orderkey % 3 = 0 THEN '0571-' || (10000000 + o_custkey) END AS contact_phone FROM orders JOIN customer ON o_custkey = c_custkey""")
def p21_attachment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the text of attachments, some of which state no budget or telephone."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("项目名称: P "), "o_orderpriority", F.lit("\n项目编号：BH-"), (key + 100_000).cast("string"), F.when(key % 2 == 0, F.concat(F.lit("\n控制价："), F.col("o_custkey").cast("string"), F.lit(" 万元"))).otherwise(F.lit("")),
        F.lit("\n截止时间："), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("。采购人："), "c_name", F.when(key % 3 == 0, F.concat(F.lit("；电话：0571-"), (F.col("o_custkey") + 10_000_000).cast("string"))).otherwise(F.lit("")),
    )
    parsed = rows.select("o_orderkey", sc.attachment_fields(text).alias("f"))
    return parsed.select("o_orderkey", "f.project_name", "f.bid_number", "f.budget_amount", F.date_format("f.deadline", "yyyy-MM-dd").alias("deadline"), "f.tender_org", "f.contact_phone")


@query("""SELECT event_id FROM events WHERE user_id = 3 AND event_id % 2 = 0""")
def f21_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user asks for, as far as it is theirs."""
    return table(spark, sf_dir, "events").filter((F.col("event_id") % 2 == 0) & (F.col("user_id") == 3)).select("event_id")
