"""Registered queries: scoring of values and evidence, keys and parts of notices, orders, splits and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions import scoring as sc
from noticelake.functions import values as v
from noticelake.operators import doc_metrics
from noticelake.operators import filters as f
from noticelake.operators import whitelist as wl
from noticelake.operators.evidence import occurrences
from noticelake.sources.tables import AWARDS_SQL, NOTICES_SQL, awards, notices, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


def pick(key: F.Column, *choices: F.Column) -> F.Column:
    """One of several columns by the remainder of a key."""
    chosen = choices[-1]
    for i in range(len(choices) - 2, -1, -1):
        chosen = F.when(key % len(choices) == i, choices[i]).otherwise(chosen)
    return chosen


# ---- dates, amounts and values


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS same, CASE o_orderkey % 4 WHEN 3 THEN '09:30' WHEN 2 THEN NULL ELSE '09:00' END AS p, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '09:00' END AS g FROM orders)
SELECT k, same AND (p IS NULL OR g IS NULL OR p = g) AS equal FROM x""")
def v08_date_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of each notice in one of four spellings against an annotation, which is a day off for every fifth."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    spelt = lambda d, shape: F.date_format(d, shape)
    predicted = pick(
        key, F.concat(spelt(day, "yyyy年MM月dd日"), F.lit(" 09时00分")), F.concat(spelt(day, "yyyy-MM-dd"), F.lit(" 09:00（北京时间）")),
        F.concat(F.lit("开标时间："), spelt(day, "yyyy-MM-dd")), F.concat(spelt(day, "yyyy-MM-dd"), F.lit("T09:30:00")),
    )
    real = F.when(key % 5 == 0, F.date_add(day, 1)).otherwise(day)
    gold = F.concat(spelt(real, "yyyy年M月d日"), F.when(key % 7 == 0, F.lit(" 00:00")).otherwise(F.lit(" 09:00")))
    return table(spark, sf_dir, "orders").select(key.alias("k"), sc.date_equal(predicted, gold).alias("equal"))


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, {_CENTS} AS c, {_CENTS} // 1000000 AS w, {_CENTS} // 10000 % 100 AS h, l_orderkey % 9 = 0 AS odd, l_orderkey % 6 = 0 AS off FROM lineitem)
SELECT k, n, CASE WHEN odd THEN NOT off ELSE abs(CAST((c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS DOUBLE)
 - CAST((w + CASE WHEN off THEN 1 ELSE 0 END) || '.' || lpad(CAST(h AS VARCHAR), 2, '0') AS DOUBLE) * 10000) <= 50 END AS equal FROM x""")
def v09_amount_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in yuan against annotations in ten thousands, some a unit off, some that are no amounts."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    written = lambda whole, part: F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 2, "0"))
    odd, off = F.col("l_orderkey") % 9 == 0, F.col("l_orderkey") % 6 == 0
    line = F.col("l_linenumber")
    predicted = F.when(odd, F.concat(F.lit("约"), line.cast("string"), F.lit("件"))).otherwise(F.concat(written(F.floor(cents / 100), cents % 100), F.lit("元")))
    near = F.concat(written(F.floor(cents / 1_000_000) + F.when(off, 1).otherwise(0), F.floor(cents / 10_000) % 100), F.lit("万元"))
    gold = F.when(odd, F.concat(F.lit("大约"), (line + F.when(off, 1).otherwise(0)).cast("string"))).otherwise(near)
    return spread(table(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("k"), line.alias("n"), sc.amount_equal(predicted, gold).alias("equal"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 4 <> 0 WHEN 1 THEN o_orderkey % 4 <> 1 ELSE o_orderkey % 2 = 0 END AS correct FROM orders""")
def v10_value_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates and other values against two annotated values each."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    field = pick(key, F.lit("amount"), F.lit("publish_date"), F.lit("platform"))
    predicted = pick(key, F.lit("1,234,500.00元"), F.date_format(day, "yyyy-MM-dd"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))
    # Days told by distance: a fixed one would be the right day of some order.
    after = lambda days: F.date_format(F.date_add(day, days), "yyyy年M月d日")
    wrong = pick(key, F.lit("99万元"), after(400), F.lit("#none#"))
    right = pick(
        key, F.when(key % 4 != 0, F.lit("123.45万元")).otherwise(F.lit("124万元")), F.when(key % 4 != 1, F.date_format(day, "yyyy年M月d日")).otherwise(after(1)),
        F.when(key % 2 == 0, F.substring("o_orderpriority", 1, 3)).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "orders").select(key.alias("k"), sc.value_correct(field, predicted, F.array(wrong, right)).alias("correct"))


_STATUS = ("present", "ambiguous", "multi_value", "absent", "not_applicable", "attachment_only", "unreadable", "other")
_STATUS_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATUS[:-1])) + " ELSE 'other' END"


@query(f"""WITH x AS (SELECT {_STATUS_SQL} AS s, quality FROM labels)
SELECT CASE WHEN s IN ('absent', 'not_applicable') THEN 'should_not_have_value' WHEN s IN ('attachment_only', 'unreadable') THEN s ELSE 'should_have_value' END AS class, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM x GROUP BY 1""")
def v11_gold_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations by what they ask for."""
    rows = table(spark, sf_dir, "labels").select(sc.gold_class(pick(F.col("doc_id"), *map(F.lit, _STATUS))).alias("class"), "quality")
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


@query(f"""WITH x AS (SELECT doc_id, {_STATUS_SQL} AS s, quality = 1 AS v, doc_id % 3 <> 0 AS e, toxic = 0 AS ok FROM labels)
SELECT doc_id, CASE WHEN s = 'absent' OR NOT coalesce(v, false) OR NOT e THEN 'low' WHEN coalesce(ok, false) THEN 'high' ELSE 'review' END AS grade FROM x""")
def g05_calibration_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    grade = sc.calibration_grade(pick(key, *map(F.lit, _STATUS)), F.col("quality") == 1, key % 3 != 0, F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


_UNITS = ("亿元", "亿", "万元", "万", "元", "", "x")


@query("""WITH x AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c, c_custkey % 7 AS u FROM customer)
SELECT c_custkey, CASE WHEN u = 6 THEN NULL WHEN u < 2 THEN c * 1000000.0 WHEN u < 4 THEN c * 100.0 ELSE c / 100.0 END::DOUBLE AS amount FROM x""")
def n13_decimal_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in seven spellings, with commas, as decimals."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("decimal(20,0)")
    text = F.concat(F.format_number(cents / F.lit(100).cast("decimal(5,0)"), 2), pick(F.col("c_custkey"), *map(F.lit, _UNITS)))
    return table(spark, sf_dir, "customer").select("c_custkey", sc.decimal_amount(text).cast("double").alias("amount"))


_ORGS = ("第一人民医院", "教育局", "有限公司", "研究院", "联合体", "")
_PLACES = ("广州", "杭州", "内蒙古", "某地")
_ORG_SQL = "[" + ", ".join(f"'{x}'" for x in ("医疗机构", "政府机构", "企业", "事业单位", "政府机构", "未知")) + "]"


@query(f"""SELECT c_custkey, {_ORG_SQL}[c_custkey % 6 + 1] AS kind, CASE WHEN c_custkey % 6 = 5 THEN '未知' ELSE ['广东', '浙江', '内蒙古', '未知'][c_custkey // 6 % 4 + 1] END AS region FROM customer""")
def n22_org_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and region of purchasers, whose names are made of a place and a kind."""
    key = F.col("c_custkey")
    place = pick(F.floor(key / 6), *map(F.lit, _PLACES))
    name = F.when(key % 6 == 5, F.lit("")).otherwise(F.concat(place, pick(key, *map(F.lit, _ORGS))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(F.array(sc.org_meta(name, F.lit("purchaser")))))


# ---- keys and parts


@query("""WITH x AS (SELECT page_id, html, length(html) - length(replace(html, '<h1>', '')) AS h, length(html) - length(replace(html, '<p>', '')) AS p FROM pages)
SELECT page_id, substr(sha256('plain|[(''h1'', ' || (h // 4) || '), (''p'', ' || (p // 3) || ')]|' || sha256(html)), 1, 16) AS signature FROM x""")
def n34_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of each page by the number of its headings and paragraphs and the hash of its text."""
    hits = lambda tag: F.floor((F.length("html") - F.length(F.replace("html", F.lit(f"<{tag}>"), F.lit("")))) / (len(tag) + 2))
    made = sc.signature(F.lit("plain"), F.create_map(F.lit("p"), hits("p"), F.lit("h1"), hits("h1")), F.sha2("html", 256))
    return table(spark, sf_dir, "pages").select("page_id", made.alias("signature"))


@query("""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
 n AS (SELECT page_id, CASE WHEN path = '' OR path LIKE '%/' THEN 'attachment' ELSE regexp_extract(path, '[^/]*$') END AS name FROM x)
SELECT page_id, substr(replace(trim(regexp_replace(name, '[\\\\:*?"<>|]', '_', 'g')), '..', ''), 1, 100) AS name FROM n""")
def n35_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.url_file_name(F.col("url")).alias("name"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sha256('[' || string_agg(event_id, ', ' ORDER BY event_id) || ']') AS hash FROM events GROUP BY ALL""")
def n37_push_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the ids that each user is sent on a day; a push holds a user's events of a day, not all of them."""
    pushes = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list("event_id").alias("ids"))
    return pushes.select("user_id", "day", sc.push_hash(F.col("ids")).alias("hash"))


@query("""SELECT p_partkey, sha256(regexp_replace(lower(p_name), '\\s+', '', 'g')) AS key FROM part""")
def n38_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sc.cache_key(F.col("p_name")).alias("key"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 AS m, strftime(o_orderdate, '%Y年%m月%d日') AS d, length(o_orderpriority) AS n FROM orders)
SELECT k, CASE m WHEN 0 THEN '投标截止时间：20' || substr(d, 3) || ' 09点30分止' ELSE '20' || substr(d, 3) || ' 09:30' END AS text, CASE m WHEN 0 THEN n + 1 ELSE n + 2 END AS start FROM x WHERE m < 2""")
def n39_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines in texts that state them in one of two ways, or not at all."""
    key, head = F.col("o_orderkey"), F.col("o_orderpriority")
    day = F.concat(F.lit("20"), F.substring(F.date_format("o_orderdate", "yyyy年MM月dd日"), 3, 99))
    text = pick(key, F.concat(head, F.lit("。投标截止时间："), day, F.lit(" 09点30分止。结束")), F.concat(head, F.lit("。于"), day, F.lit(" 09:30（北京时间）开标。")), F.concat(head, F.lit("。无")))
    found = table(spark, sf_dir, "orders").select(key.alias("k"), sc.deadline(text).alias("d")).filter("d is not null")
    return found.select("k", "d.text", F.col("d.start").cast("long").alias("start"))


@query("""WITH x AS (SELECT doc_id, text, trim(substr(text, 11, 9), ' ' || chr(9) || chr(10) || chr(13)) AS q, doc_id % 3 AS m FROM documents), y AS (SELECT *, strpos(text, q) AS found FROM x WHERE m < 2 AND q <> '')
SELECT doc_id, found - 1 AS start, found - 1 + length(q) AS "end" FROM y WHERE found > 0""")
def n40_find_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of quotes, some of which have blanks around them that the text does not have."""
    bare = F.regexp_replace(F.substring("text", 11, 9), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")
    quote = pick(F.col("doc_id"), bare, F.concat(F.lit("\t \n"), bare, F.lit(" \n\n")), F.lit("@@nowhere@@"))
    found = table(spark, sf_dir, "documents").select("doc_id", sc.find_span(F.col("text"), quote).alias("s")).filter("s is not null")
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'blog') OR contains(lower(url), 'www.') THEN 'b' WHEN contains(lower(url), '.org') THEN 'o' WHEN contains(lower(url), 'example') THEN 'e' END AS code FROM pages""")
def n41_platform_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = sc.first_code(F.col("url"), (("b", ("BLOG", "www.")), ("o", (".org",)), ("e", ("example",))))
    return table(spark, sf_dir, "pages").select("page_id", code.alias("code"))


@query("""WITH x AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, event_id % 4 AS m FROM events) SELECT event_id, CASE m WHEN 0 THEN substr(iso, 1, 10) WHEN 1 THEN substr(iso, 1, 7) ELSE substr(iso, 1, 4) END AS d FROM x""")
def n43_date_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    short = F.substring(iso, 1, 4)
    chosen = pick(F.col("event_id"), sc.date_prefix(iso), sc.date_prefix(iso, 7), sc.date_prefix(short), sc.date_prefix(short, 7))
    return table(spark, sf_dir, "events").select("event_id", chosen.alias("d"))


# ---- rows of notices


@query(f"""WITH {NOTICES_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN '未命名' ELSE substr(repeat(purchaser, 40), 1, 500) END AS project_name, CASE WHEN id % 3 = 0 THEN location ELSE region END AS location,
 CAST(CAST(round(budget * 100) AS BIGINT) // 100 AS DOUBLE) * 10000 AS budget_amount, strftime(publish_time, '%Y-%m-%d') AS publish_time, sha256(platform) AS contact_phone FROM notices""")
def p03_notice_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices from scraped items whose values stand under several names."""
    n, key = notices(spark, sf_dir), F.col("id")
    cents = F.round(F.col("budget") * 100).cast("long")
    picked = {
        "project_name": F.when(key % 5 != 0, F.repeat("purchaser", F.lit(40))),
        "location": F.coalesce(F.when(key % 3 == 0, F.col("location")), F.col("region")),
        "budget_amount": F.concat(F.floor(cents / 100).cast("string"), F.lit(" 万元")),
        "publish_time": F.date_format("publish_time", "yyyy/M/d"),
        "contact_phone": F.concat(F.lit(" "), F.col("platform")),
    }
    rows = n.select("id", *sc.notice_row(picked))
    return rows.select("id", "project_name", "location", F.col("budget_amount").cast("double").alias("budget_amount"), F.date_format("publish_time", "yyyy-MM-dd").alias("publish_time"), "contact_phone")


@query(f"""WITH {NOTICES_SQL} SELECT id, CASE id % 4 WHEN 0 THEN purchaser WHEN 1 THEN location WHEN 2 THEN region END AS tender_org FROM notices""")
def p04_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchaser from columns or from a list of fields, under any of its names."""
    key, none = F.col("id"), F.lit(None).cast("string")
    entry = lambda name, raw, value: F.struct(F.lit(name).alias("field_name"), raw.alias("raw_value"), value.alias("value"))
    fields = F.array(
        entry("title", F.lit("x"), F.lit("y")),
        pick(key, entry("采购人", F.lit("z"), none), entry("采购单位", F.col("location"), none), entry("purchaser_name", F.lit(""), F.col("region")), entry("other", F.lit("w"), none)),
    )
    own = {"tender_org": F.when(key % 4 == 0, F.col("purchaser")).otherwise(F.lit("")), "purchaser_name": none}
    return notices(spark, sf_dir).select("id", sc.by_alias(own, fields, "tender_org").alias("tender_org"))


_LEVELS, _ROLES = ("direct", "equivalent", "inferred", "unsupported"), ("primary", "supporting")


@query("""WITH x AS (SELECT doc_id, ['direct', 'equivalent', 'inferred', 'unsupported', 'sure'][doc_id % 5 + 1] AS s, ['primary', 'supporting', 'other'][doc_id % 3 + 1] AS r, doc_id % 4 <> 0 AS e FROM documents)
SELECT CASE WHEN s = 'sure' THEN 'support_level' WHEN NOT e AND s IN ('direct', 'equivalent') THEN 'no_evidence' WHEN e AND r = 'other' THEN 'evidence_role' END AS refusal, count(*) AS n FROM x GROUP BY 1""")
def e12_evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose evidence may not be written, by the first rule that they break."""
    key = F.col("doc_id")
    refusal = sc.evidence_refusal(pick(key, *map(F.lit, (*_LEVELS, "sure"))), pick(key, *map(F.lit, (*_ROLES, "other"))), key % 4 != 0, _LEVELS, _ROLES)
    return table(spark, sf_dir, "documents").select(refusal.alias("refusal")).groupBy("refusal").agg(F.count("*").alias("n"))


# ---- counts and orders


@query(f"""WITH {NOTICES_SQL} SELECT purchaser, count(*) AS n, count(*) FILTER (contains(coalesce(notice_type, ''), 'tender')) AS tenders, count(*) FILTER (contains(coalesce(notice_type, ''), 'award')) AS awards FROM notices GROUP BY purchaser""")
def a09_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of each purchaser by what their type contains."""
    n = lambda w: F.count_if(F.coalesce(F.contains("notice_type", F.lit(w)), F.lit(False)))
    return notices(spark, sf_dir).groupBy("purchaser").agg(F.count("*").alias("n"), n("tender").alias("tenders"), n("award").alias("awards"))


@query(f"""WITH {AWARDS_SQL}, c AS (SELECT winner, region, count(*) AS n, min(notice_id * 10 + lot) AS first FROM awards GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY n DESC, first) AS rank FROM c) SELECT winner, region, n, rank FROM r WHERE rank <= 5""")
def a34_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent regions of each winner; of equal ones the one that comes first."""
    counted = awards(spark, sf_dir).groupBy("winner", "region").agg(F.count("*").alias("n"), F.min(F.col("notice_id") * 10 + F.col("lot")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("winner").orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank.cast("long")).filter("rank <= 5").select("winner", "region", "n", "rank")


@query(f"""WITH {NOTICES_SQL}, s AS (SELECT id, publish_time, (contains(lower(location), 'a')::INT + contains(lower(platform), 'high')::INT) / 2.0 AS score FROM notices)
SELECT id, score::DOUBLE AS score FROM s ORDER BY score DESC, publish_time DESC NULLS LAST, id LIMIT 60""")
def k04_relevance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 most relevant notices, of equal ones the newest, that go on to extraction."""
    text = F.concat_ws(" ", F.when(F.contains(F.lower("location"), F.lit("a")), F.lit("ww1")), F.when(F.contains(F.lower("platform"), F.lit("high")), F.lit("ww2")))
    scored = notices(spark, sf_dir).select("id", "publish_time", v.relevance(text, "no such topic", ["ww1", "ww2"]).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc_nulls_last("publish_time"), "id").limit(60).select("id", "score")


@query(f"""WITH {NOTICES_SQL}, r AS (SELECT id, platform, row_number() OVER (PARTITION BY platform ORDER BY id DESC) AS k FROM notices) SELECT platform, count(*) AS n, min(id) AS oldest FROM r WHERE k <= 2000 GROUP BY platform""")
def k05_candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 2,000 notices of each platform, which a new one is compared with where the window is asked for."""
    newest = f.newest_of_each(notices(spark, sf_dir).select("id", "platform"), "platform", "id", 2_000)
    return newest.groupBy("platform").agg(F.count("*").alias("n"), F.min("id").alias("oldest"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM w""")
def t04_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each part, each once, in the order of their first occurrence."""
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


@query("""WITH t AS (SELECT doc_id FROM documents WHERE doc_id % 10 < 8), d AS (SELECT doc_id FROM documents WHERE doc_id % 10 BETWEEN 7 AND 8), n AS (SELECT (SELECT count(*) FROM t) AS first, (SELECT count(*) FROM d) AS second,
 (SELECT count(*) FROM (SELECT doc_id FROM t INTERSECT SELECT doc_id FROM d)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM t UNION SELECT doc_id FROM d))) AS missing)
SELECT *, shared = 0 AND missing = 0 AS disjoint_and_complete FROM n""")
def t05_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of two splits, what they share, what both miss, and whether they are disjoint and complete."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return f.split_check(docs, docs.filter("doc_id % 10 < 8"), docs.filter("doc_id % 10 BETWEEN 7 AND 8"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, count(*) AS n FROM events GROUP BY user_id""")
def x05_users_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in order of their first event, with the number of their events."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.count("*").alias("n")).orderBy("first", "user_id")
    return users.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("created"), "n")


@query("""SELECT page_id, CASE WHEN contains(url, '/list') OR contains(url, 'index') THEN 'list' WHEN regexp_matches(url, '\\.(pdf|docx?|xlsx?|zip)$') THEN 'attachment' ELSE 'detail' END AS kind,
 trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) AS title FROM pages""")
def x10_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each address and title of its page."""
    kind = F.when(F.contains("url", F.lit("/list")) | F.contains("url", F.lit("index")), "list").when(F.col("url").rlike("\\.(pdf|docx?|xlsx?|zip)$"), "attachment").otherwise("detail")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1)).alias("title"))


@query("""WITH c AS (SELECT n_name AS domain, event_id, ts, ['add', 'decommission', 'recommission'][event_id % 3 + 1] AS action, CASE WHEN event_id % 2 = 0 THEN 'why' ELSE '' END AS reason FROM events JOIN nation ON n_nationkey = user_id % 20),
 ok AS (SELECT * FROM c WHERE action <> 'decommission' OR reason <> ''), l AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY domain) AS changes FROM ok)
SELECT n_name AS domain, coalesce(CASE WHEN action = 'decommission' THEN 'decommissioned' ELSE 'active' END, 'active') AS status, CASE WHEN action = 'decommission' THEN reason END AS reason, coalesce(changes, 0) AS changes FROM nation LEFT JOIN (SELECT * FROM l WHERE k = 1) ON domain = n_name""")
def x08_whitelist_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each domain after additions, withdrawals, which need a reason, and returns, in order of status and domain."""
    domains = table(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), "n_nationkey")
    key = F.col("event_id")
    changes = table(spark, sf_dir, "events").join(domains, F.col("n_nationkey") == F.col("user_id") % 20).select(
        "domain", pick(key, *map(F.lit, ("add", "decommission", "recommission"))).alias("action"), F.when(key % 2 == 0, F.lit("why")).otherwise(F.lit("")).alias("reason"), F.struct("ts", "event_id").alias("at")
    )
    return wl.maintained(domains.select("domain"), changes).orderBy("status", "domain")


# ---- metrics of documents

_FIELDS_SQL = """f AS (SELECT doc_id, n, ['present', 'multi_value', 'absent'][(doc_id + n) % 3 + 1] AS status, strpos(text, substr(text, 11 + 20 * n, 14)) - 1 AS s, length(substr(text, 11 + 20 * n, 14)) AS len, 10 + 20 * n + (doc_id + n) % 12 AS g,
 (doc_id + n) % 4 <> 0 AS annotated FROM documents, range(3) r(n)),
 o AS (SELECT *, len > 0 AND s >= 0 AS found, CASE WHEN least(s + len, g + 14) > greatest(s, g) THEN (least(s + len, g + 14) - greatest(s, g))::DOUBLE / (greatest(s + len, g + 14) - least(s, g)) ELSE 0 END AS iou FROM f)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predicted quotes of each document, where they first stand, and an annotated span for most."""
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), n)
    rows = rows.withColumn("quote", F.substring("text", 11 + 20 * F.col("n"), F.lit(14)))
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    start = F.position(F.col("quote"), F.col("text")) - 1
    places = F.when((F.col("quote") != "") & (start >= 0), F.array(span(start, start + F.length("quote"))))
    gold = 10 + 20 * F.col("n") + (F.col("doc_id") + F.col("n")) % 12
    none = F.array().cast("array<struct<start:int,end:int>>")
    status = pick(F.col("doc_id") + F.col("n"), F.lit("present"), F.lit("multi_value"), F.lit("absent"))
    return rows.select(
        "doc_id", status.alias("gold_status"), F.array(F.coalesce(places, none)).alias("quotes"), F.when((F.col("doc_id") + F.col("n")) % 4 != 0, F.array(span(gold, gold + 14))).otherwise(none).alias("gold"), "text", "quote",
    )


@query(f"""WITH {_FIELDS_SQL} SELECT doc_id, count(*) AS fields_total, count(*) FILTER (status <> 'absent') AS fields_present, count(*) FILTER (annotated AND found AND iou >= 0.5) AS fields_found, count(*) AS evidences_pred,
 count(*) FILTER (annotated AND found) AS evidences_located, count(*) FILTER (annotated AND found AND iou >= 0.5) AS evidences_matched,
 round(count(*) FILTER (annotated AND found AND iou >= 0.5)::DOUBLE / greatest(count(*) FILTER (status <> 'absent'), 1), 4) AS recall, round(count(*) FILTER (annotated AND found AND iou >= 0.5)::DOUBLE / count(*), 4) AS precision,
 round(coalesce(sum(iou) FILTER (annotated AND found AND iou >= 0.5), 0) / count(*), 4) AS iou_avg, round(coalesce(sum(iou) FILTER (annotated AND found AND iou >= 0.5), 0) / greatest(count(*) FILTER (annotated AND found AND iou >= 0.5), 1), 4) AS iou_avg_matched FROM o GROUP BY doc_id""")
def m07_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each document with quotes at their first occurrence."""
    return doc_metrics.evidence_metrics(_fields(spark, sf_dir))


@query()
def m08_all_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each document with the best of up to 20 occurrences of each quote."""
    spans_type = "array<struct<start:int,end:int>>"
    rows = _fields(spark, sf_dir)
    spans = F.transform(occurrences(F.col("text"), F.col("quote")), lambda at: F.struct(at.alias("start"), (at + F.length("quote")).alias("end")))
    found = F.when(F.col("quote") != "", spans).otherwise(F.array().cast(spans_type))
    return doc_metrics.evidence_metrics(rows.withColumn("quotes", F.array(found)))


@query(f"""WITH {_FIELDS_SQL} SELECT doc_id, count(*) FILTER (annotated AND found) - count(*) FILTER (annotated AND found AND iou >= 0.5) AS gap FROM o GROUP BY doc_id HAVING gap > 0""")
def x03_located_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of whose located quotes some match nothing."""
    return doc_metrics.located_gap(_fields(spark, sf_dir))[0]


@query(f"""WITH {_FIELDS_SQL}, h AS (SELECT CASE WHEN iou = 0 THEN -1.0 WHEN iou < 0.1 THEN 0.0 WHEN iou < 0.3 THEN 0.1 WHEN iou < 0.5 THEN 0.3 WHEN iou < 0.7 THEN 0.5 WHEN iou < 0.9 THEN 0.7 ELSE 0.9 END::DOUBLE AS low FROM o WHERE annotated AND found)
SELECT low, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM h GROUP BY low""")
def x03_overlap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all located quotes; -1 stands for none at all."""
    return doc_metrics.located_gap(_fields(spark, sf_dir))[1]


@query("""WITH r AS (SELECT source AS doc, ['present', 'multi_value', 'absent'][d.doc_id % 3 + 1] AS s, quality = 1 AS hv, d.doc_id % 4 <> 0 AS he, d.doc_id % 4 > 1 AS ve, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE toxic = 0 END AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc, count(*) FILTER (s <> 'absent') AS fields_present, count(*) FILTER (s <> 'absent' AND hv) AS fields_found, count(*) FILTER (he) AS evidences_pred, count(*) FILTER (ve) AS evidences_matched, count(*) FILTER (he AND ve) AS overlap,
 count(*) FILTER (ok) AS fields_correct, count(*) FILTER (ok IS NOT NULL) AS fields_evaluable FROM r GROUP BY doc""")
def m13_interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of each project that intervals are drawn from."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc")).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc", pick(key, F.lit("present"), F.lit("multi_value"), F.lit("absent")).alias("gold_status"), (F.col("quality") == 1).alias("has_value"), (key % 4 != 0).alias("has_evidence"),
        (key % 4 > 1).alias("verified"), F.when(key % 7 != 0, F.col("toxic") == 0).alias("correct"),
    )
    return doc_metrics.interval_rows(rows, "doc")
