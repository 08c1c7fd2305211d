"""Registered queries: text, fingerprints, evidence, validation, lineage, signals, metrics, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as tx
from noticelake.functions import values as v
from noticelake.operators import evidence as ev
from noticelake.operators import facts, lineage, metrics, signals, simhash, versions
from noticelake.operators import filters as f
from noticelake.plans.relational import HOST_SQL
from noticelake.sources.scratch import stored
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


LICENSE = "Licensed under the Apache License, Version 2.0."


@query("""SELECT doc_id, length(text) AS raw_chars FROM documents""")
def n00_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("raw_chars"))


@query()
def n01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts with the sizes of their maps."""
    done = spread(table(spark, sf_dir, "documents")).select("doc_id", tx.normalize_text()("text").alias("n"))
    return done.select("doc_id", F.sha2("n.text", 256).alias("text_sha256"), F.size("n.forward").alias("n_forward"), F.size("n.reverse").alias("n_reverse"))


@query("""SELECT DISTINCT p_brand AS raw, CASE WHEN regexp_matches(lower(trim(p_brand)), '^[0-9,]+[.]?[0-9]*$') THEN replace(lower(trim(p_brand)), ',', '')
 ELSE lower(trim(p_brand)) END AS value FROM part UNION ALL SELECT DISTINCT CAST(p_size AS VARCHAR) || ',000', CAST(p_size AS VARCHAR) || '000' FROM part""")
def n07_value_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    numbers = part.select(F.concat(F.col("p_size").cast("string"), F.lit(",000")).alias("raw"))
    raw = part.select(F.col("p_brand").alias("raw")).distinct().unionByName(numbers.distinct())
    return raw.select("raw", tx.normalized_value(F.col("raw")).alias("value"))


@query("""WITH g AS (SELECT p_partkey, list_distinct([substr(p_name, i, 2) FOR i IN range(1, length(p_name))]) AS a, list_distinct([substr(p_type, i, 2) FOR i IN range(1, length(p_type))]) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS similarity FROM g""")
def n08_bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = tx.jaccard(tx.bigrams(F.col("p_name")), tx.bigrams(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", near.alias("similarity"))


@query("""SELECT c_custkey, CASE WHEN trim(c_name) <> '' THEN sha256(trim(c_name)) END AS contact FROM customer""")
def n16_contact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", v.contact_hash(F.col("c_name")).alias("contact"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content FROM documents")
def n17_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", v.content_hash(F.col("text")).alias("content"))


@query("SELECT doc_id, sha256(left(text, 500) || right(text, 500)) AS material FROM documents")
def n18_material_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", v.material_hash(F.col("text")).alias("material"))


@query("SELECT s_suppkey, substr(sha1(s_name), 1, 12) AS api_id, substr(md5(s_name), 1, 12) AS finance_id, substr(sha256(s_name), 1, 16) AS name_hash FROM supplier")
def n19_org_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = lambda c, n: F.substring(c, 1, n)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", short(F.sha1("s_name"), 12).alias("api_id"), short(F.md5("s_name"), 12).alias("finance_id"), short(F.sha2("s_name", 256), 16).alias("name_hash")
    )


@query(f"SELECT page_id, {HOST_SQL} AS host, CASE WHEN regexp_matches({HOST_SQL}, 'example[.]com$') THEN 'main' ELSE 'other' END AS platform FROM pages")
def n15_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = f.host("url")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.when(host.rlike("example\\.com$"), "main").otherwise("other").alias("platform"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the and') THEN 1.0 ELSE (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT)::DOUBLE / 2 END AS relevance
FROM conversations WHERE role = 'user'""")
def n24_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", v.relevance(F.col("text"), "the and", ["the", "and"]).cast("double").alias("relevance"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def n29_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace("props", "\\}$", ",}"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", v.lenient_json(fenced, "k long")["k"].alias("k"))


def fingerprints(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(id, more, simhash) of all documents, stored, as joins read it several times and each would make the fingerprints anew."""
    docs = spread(table(spark, sf_dir, "documents"))
    return stored(docs.select(F.col("doc_id").alias("id"), *more, simhash.simhash_column()("text").alias("simhash")))


SIMHASH_SQL = """t AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS d FROM documents),
 g AS (SELECT doc_id, unnest([substr(d, i, 2) FOR i IN range(1, length(d))]) AS gram FROM t),
 c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL),
 h AS (SELECT doc_id, n, CAST(concat('0x', substr(md5(gram), 1, 16)) AS UBIGINT) AS h FROM c),
 b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS s FROM h, range(64) r(i) GROUP BY ALL),
 f AS (SELECT doc_id, CAST(coalesce(sum(CAST(1 AS UBIGINT) << i) FILTER (s > 0), 0) AS UBIGINT) AS fp FROM b GROUP BY doc_id)"""


@query(f"""WITH {SIMHASH_SQL} SELECT doc_id, lower(printf('%016x', fp)) AS simhash FROM f""")
def n11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints by the pandas function; its twin in Spark functions is held equal in tests."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", simhash.simhash_column()("text").alias("h"))
    return docs.select("doc_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("simhash"))


@query(f"""WITH {SIMHASH_SQL} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.fp, b.fp)::UBIGINT::HUGEINT) AS INT) AS distance
FROM f a JOIN f b ON a.doc_id < b.doc_id AND bit_count(xor(a.fp, b.fp)::UBIGINT::HUGEINT) <= 3 WHERE a.fp <> 0 AND b.fp <> 0""")
def j06_simhash_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_rows(fingerprints(spark, sf_dir))


@query(f"""WITH {SIMHASH_SQL}, r AS (SELECT d.doc_id AS id, sha256(text) AS url, coalesce(fp, 0) AS fp FROM documents d LEFT JOIN f USING (doc_id)), k AS (SELECT * FROM r WHERE id % 2 = 1),
 n AS (SELECT *, url IN (SELECT url FROM k WHERE url IS NOT NULL) OR (url IS NOT NULL AND row_number() OVER (PARTITION BY url ORDER BY id) > 1) AS seen FROM r WHERE id % 2 = 0),
 close AS (SELECT DISTINCT n.id FROM n JOIN k ON n.fp <> 0 AND k.fp <> 0 AND bit_count(xor(n.fp, k.fp)::UBIGINT::HUGEINT) <= 3)
SELECT id, CASE WHEN seen THEN 'duplicate_url' WHEN close.id IS NOT NULL THEN 'duplicate_simhash' ELSE 'inserted' END AS verdict FROM n LEFT JOIN close USING (id)""")
def d01_ingest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents come in against odd ones that are known."""
    docs = fingerprints(spark, sf_dir, F.sha2("text", 256).alias("url"))
    return simhash.ingest_verdict(docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1"))


@query()
def d02_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints(spark, sf_dir)
    return simhash.keep_first(docs)


@query(f"""SELECT doc_id, strpos(text, '{LICENSE}') - 1 AS start, strpos(text, '{LICENSE}') - 1 + length('{LICENSE}') AS "end" FROM documents
WHERE contains(text, '{LICENSE}')""")
def e01_exact_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit(LICENSE)))
    span = docs.select("doc_id", ev.exact_spans(F.col("text"), F.lit(LICENSE)).alias("s"))
    return span.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(f"""SELECT doc_id, CAST((length(text) - length(replace(text, '{LICENSE}', ''))) / length('{LICENSE}') AS BIGINT) AS n FROM documents""")
def e08_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.occurrences(F.col("text"), F.lit(LICENSE), 1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


@query("""SELECT doc_id, trim(substr(text, 1 + doc_id % 50, 20)) = trim(substr(text, 11, 20)) AND 10 + 20 <= length(text) AND length(substr(text, 11, 20)) > 0 AS agrees FROM documents""")
def e09_verify_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.substring(F.col("text"), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(20))
    return table(spark, sf_dir, "documents").select("doc_id", ev.slice_agrees(F.col("text"), F.lit(10), F.lit(30), quote).alias("agrees"))


@query("""SELECT doc_id, substr(text, 61, 40) AS before, substr(text, 121, 40) AS after FROM documents WHERE length(text) >= 120""")
def e10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = ev.context(F.col("text"), F.lit(100), F.lit(120))
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 120).select("doc_id", around["before"].alias("before"), around["after"].alias("after"))


@query()
def e06_cascade_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title-cased start of each text, without its blanks, found again in it at some level."""
    docs = spread(table(spark, sf_dir, "documents"))
    quote = F.replace(F.substring(F.lower("text"), 20, 40), F.lit(" "), F.lit(""))
    found = docs.select("doc_id", ev.locate_column()("text", quote).alias("l"))
    return found.select("doc_id", "l.found", "l.level", "l.start", "l.end", "l.confidence", "l.support_level")


@query("""WITH b AS (SELECT doc_id, 10 + doc_id % 30 AS s, 60 + doc_id % 30 AS e FROM documents), g AS (SELECT doc_id, 30 AS s, 80 AS e FROM documents)
SELECT b.doc_id, CASE WHEN least(b.e, g.e) > greatest(b.s, g.s) THEN (least(b.e, g.e) - greatest(b.s, g.s))::DOUBLE / (greatest(b.e, g.e) - least(b.s, g.s)) ELSE 0.0 END AS iou,
 CASE WHEN least(b.e, g.e) > greatest(b.s, g.s) THEN (least(b.e, g.e) - greatest(b.s, g.s))::DOUBLE / (greatest(b.e, g.e) - least(b.s, g.s)) ELSE 0.0 END >= 0.5 AS matched
FROM b JOIN g ON b.doc_id = g.doc_id""")
def j11_span_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    found = ids.select("doc_id", (F.col("doc_id") % 30 + 10).alias("start"), (F.col("doc_id") % 30 + 60).alias("end"))
    gold = ids.select("doc_id", F.lit(30).cast("long").alias("start"), F.lit(80).cast("long").alias("end"))
    return ev.best_overlap(found, gold, ["doc_id"]).select("doc_id", "iou", "matched")


@query(
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS value, '{k}' AS category FROM documents" for k, p in facts.PATTERNS.items())
    + ") SELECT DISTINCT doc_id, category, trim(value) AS value FROM f"
)
def p23_fact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode_outer(facts.facts(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.category", "f.value").filter("category is not null")


@query()
def p26_content_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each document against the text with its digits changed by one rule."""
    docs = spread(table(spark, sf_dir, "documents")).withColumn("source_text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.translate("text", "3", "4")))
    return facts.check(docs, "doc_id", "text", "source_text")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN v >= 100000000 THEN printf('%.2f亿元', v / 100000000) WHEN v >= 10000 THEN printf('%.2f万元', v / 10000) ELSE printf('%.2f元', v) END AS normalized, v AS value
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 10000.0::DOUBLE ELSE 100000000.0::DOUBLE END AS v FROM lineitem)""")
def v01_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("元"), F.lit("万元"), F.lit("（亿元）")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    raw = F.concat(F.lit("中标金额：人民币"), F.col("l_quantity").cast("long").cast("string"), unit)
    parsed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.validate_amount(raw).alias("a"))
    return parsed.select("l_orderkey", "l_linenumber", F.col("a.normalized").alias("normalized"), F.col("a.value").alias("value"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' 09:30' ELSE '' END AS normalized FROM orders""")
def v03_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" 9时30分（北京时间）")).otherwise(F.lit("（原定）")))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.validate_date(raw)["normalized"].alias("normalized"))


@query("""SELECT o_orderkey, 'ZFCG-' || o_orderkey AS normalized FROM orders""")
def v04_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ｚｆｃｇ－ "), F.col("o_orderkey").cast("string"), F.lit("、XX"))).otherwise(
        F.concat(F.lit("见（招标编号：zfcg-"), F.col("o_orderkey").cast("string"), F.lit("）"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", v.validate_identifier(raw)["normalized"].alias("normalized"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 5000.0 END AS tolerance FROM part""")
def v06_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_size") % 4 + 1).cast("int"))
    shown, unit = pick("０．０１万元", "1元", "1万元", "1美元"), pick("", "", "", "美元")
    return table(spark, sf_dir, "part").select("p_partkey", v.precision_tolerance(shown, unit).alias("tolerance"))


@query(f"""SELECT page_id, CASE WHEN {HOST_SQL} = '' THEN 'unknown' WHEN length(trim(html)) < 10 THEN 'index_only' ELSE 'unknown' END AS role FROM pages""")
def l01_source_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", lineage.source_role(f.host("url"), F.col("html")).alias("role"))


@query("""SELECT l_orderkey, l_linenumber, substr(sha256(l_orderkey || '|' || l_returnflag || '|' || l_linestatus), 1, 16) AS fact_key FROM lineitem""")
def l03_fact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lineage.fact_key(F.col("l_orderkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("fact_key"))


@query("""WITH u AS (SELECT l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) AS k FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.k AS first, b.k AS second, CASE WHEN a.l_linestatus = b.l_linestatus THEN 'conflict' ELSE 'version_diff' END AS verdict
FROM u a JOIN u b ON a.l_orderkey = b.l_orderkey AND a.k < b.k AND a.l_returnflag <> b.l_returnflag""")
def j09_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return lineage.conflict_pairs(rows, ["l_orderkey"], "l_returnflag", "l_linenumber", "l_linestatus")


@query("""WITH k AS (SELECT doc_id % 5 AS s, doc_id % 4 AS r, doc_id % 3 AS t FROM labels)
SELECT s, r, t, count(*) AS n, CASE WHEN t = 0 OR s IN (3, 4) OR r = 0 THEN 'low' WHEN s IN (0, 1) AND r = 1 THEN 'high' ELSE 'review' END AS grade FROM k GROUP BY ALL""")
def g01_grade_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, *x: F.element_at(F.array(*map(F.lit, x)), (F.col(c) + 1).cast("int"))
    grade = lineage.display_grade(
        pick("s", "direct", "equivalent", "inferred", "unsupported", "contradicted"),
        pick("r", "unknown", "official_original", "official_repost", "commercial_repost"),
        pick("t", "absent", "present", "missing"),
    )
    keys = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("s"), (F.col("doc_id") % 4).alias("r"), (F.col("doc_id") % 3).alias("t"))
    return keys.groupBy("s", "r", "t").agg(F.count("*").alias("n")).withColumn("grade", grade)


@query(f"""WITH {AWARDS_SQL} SELECT winner, strftime(win_date, '%Y-%m') AS month, count(*) AS n, sum(CAST(win_amount AS DECIMAL(18,2)))::DOUBLE AS amount FROM awards GROUP BY ALL""")
def s01_activity_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.activity(awards(spark, sf_dir))


@query(f"""WITH {AWARDS_SQL}, c AS (SELECT winner, region AS value, count(*) AS n FROM awards GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY n DESC, value) AS k FROM c)
SELECT winner, sum(n)::BIGINT AS total, (sum(n) FILTER (k <= 3))::BIGINT AS top, (sum(n) FILTER (k <= 3))::DOUBLE / sum(n)::DOUBLE AS share FROM r GROUP BY winner""")
def s02_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.concentration(awards(spark, sf_dir), "region")


@query(f"""WITH {AWARDS_SQL}, u AS (SELECT DISTINCT notice_id, winner FROM awards) SELECT x.winner AS a, y.winner AS b, count(*) AS n FROM u x JOIN u y
ON x.notice_id = y.notice_id AND x.winner < y.winner GROUP BY ALL""")
def s06_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.co_occurrence(awards(spark, sf_dir), "winner", ["notice_id"])


@query(f"""WITH {AWARDS_SQL} SELECT winner AS org, count(*) AS n FROM awards GROUP BY winner""")
def s08_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.by_perspective(awards(spark, sf_dir))


@query("""WITH g AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS g, list_distinct(list_concat(list(l_linestatus || 'x'), coalesce(list(l_returnflag) FILTER (l_linenumber < 3), []))) AS p FROM lineitem GROUP BY l_orderkey),
 m AS (SELECT l_orderkey, len(list_intersect(g, p)) AS h, len(g) AS ng, len(p) AS np FROM g)
SELECT l_orderkey, h::DOUBLE / np AS precision, h::DOUBLE / ng AS recall, CASE WHEN h = 0 THEN 0.0 ELSE 2 * (h::DOUBLE / np) * (h::DOUBLE / ng) / (h::DOUBLE / np + h::DOUBLE / ng) END AS f1 FROM m""")
def m09_set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.collect_list(F.when(F.col("l_linenumber") < 3, F.col("l_returnflag")))
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("g"), F.array_union(F.collect_set(F.concat("l_linestatus", F.lit("x"))), early).alias("p")
    )
    return sets.select("l_orderkey", metrics.set_scores(F.col("g"), F.col("p")).alias("s")).select("l_orderkey", "s.precision", "s.recall", "s.f1")


@query("""SELECT l_suppkey, list_sort(list(l_quantity))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95 FROM lineitem GROUP BY l_suppkey""")
def k08_percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.index_percentiles(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 0.95, "p95")


@query("""SELECT l_suppkey, quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(l_quantity AS DOUBLE), 0.95) AS p95 FROM lineitem GROUP BY l_suppkey""")
def k09_percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x: F.percentile("l_quantity", F.lit(x))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("""WITH r AS (SELECT lang AS grp, n_chars > 1000 AS v, (n_chars > 1000)::INT = quality AS c, n_chars % 2 = 0 AS j, quality = 0 AS a FROM documents JOIN labels ON documents.doc_id = labels.doc_id)
SELECT grp AS "group", count(*) AS n, count(*) FILTER (v) AS n_values, count(*) FILTER (v AND c)::DOUBLE / nullif(count(*) FILTER (v), 0) AS precision,
 count(*) FILTER (v AND NOT j)::DOUBLE / nullif(count(*) FILTER (v), 0) AS unjustified_rate, count(*) FILTER (v AND a)::DOUBLE / nullif(count(*) FILTER (a), 0) AS null_false_positive_rate FROM r GROUP BY grp""")
def a23_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    value = F.col("n_chars") > 1000
    marked = rows.select(F.col("lang").alias("group"), value.alias("has_value"), (value.cast("int") == F.col("quality")).alias("correct"), (F.col("n_chars") % 2 == 0).alias("justified"), (F.col("quality") == 0).alias("gold_absent"))
    return metrics.group_summary(marked, "group")


@query("""WITH r AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'review' ELSE 'low' END AS grade, quality = 1 AS correct FROM labels), t AS (SELECT count(*) AS total FROM r),
 p AS (SELECT 'strict' AS point, * FROM r WHERE grade = 'high' UNION ALL SELECT 'loose', * FROM r WHERE grade <> 'low' UNION ALL SELECT 'audit', * FROM r)
SELECT point, count(*) AS kept, count(*)::DOUBLE / any_value(total) AS coverage, count(*) FILTER (correct)::DOUBLE / count(*) AS precision FROM p, t GROUP BY point""")
def a29_workpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.element_at(F.array(F.lit("high"), F.lit("review"), F.lit("low")), (F.col("doc_id") % 3 + 1).cast("int"))
    return metrics.workpoints(table(spark, sf_dir, "labels").select(grade.alias("grade"), (F.col("quality") == 1).alias("correct")))


@query("""WITH b(bucket) AS (SELECT * FROM range(6)), v AS (SELECT CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.04 THEN 1 WHEN l_discount < 0.06 THEN 2 WHEN l_discount < 0.08 THEN 3 WHEN l_discount < 0.1 THEN 4 ELSE 5 END AS bucket FROM lineitem)
SELECT b.bucket, count(v.bucket) AS n FROM b LEFT JOIN v ON b.bucket = v.bucket GROUP BY b.bucket""")
def a25_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = metrics.buckets(F.col("l_discount"), (0.02, 0.04, 0.06, 0.08, 0.1))
    counts = table(spark, sf_dir, "lineitem").groupBy(at.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(6).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def m12_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good labels with a confidence interval over sources as projects."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.bootstrap(rows.withColumn("one", F.lit(1)), "source", "quality", "one")


@query("""WITH e AS (SELECT user_id, event_type, event_id, CAST(floor(value / 50) AS BIGINT) AS content, ts FROM events),
 l AS (SELECT *, lag(content) OVER w AS previous, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
 c AS (SELECT *, sum(CASE WHEN k = 1 OR content IS DISTINCT FROM previous THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM l)
SELECT user_id, event_type, event_id, content, previous, version FROM c WHERE k = 1 OR content IS DISTINCT FROM previous""")
def w02_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.floor(F.col("value") / 50).alias("content"), "ts")
    return versions.version_chain(pages, ["user_id", "event_type"], ["ts", "event_id"], "content").drop("ts")


@query("""SELECT event_id, event_id >= coalesce(max(event_id) FILTER (event_type <> 'view') OVER (PARTITION BY user_id), event_id) AS is_current FROM events""")
def w06_is_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "view").alias("multi"))
    return versions.is_current(rows, ["user_id"], "event_id", "multi").select("event_id", "is_current")


@query(f"""WITH {NOTICES_SQL}, k AS (SELECT DISTINCT purchaser FROM notices WHERE notice_type = 'award')
SELECT DISTINCT purchaser AS normalized_name, substr(sha256(purchaser), 1, 26) AS organization_id FROM notices WHERE purchaser NOT IN (SELECT purchaser FROM k)""")
def l10_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = notices(spark, sf_dir).withColumnRenamed("purchaser", "normalized_name")
    return versions.organisations(names, names.filter("notice_type = 'award'"))


@query("""WITH d AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0))
SELECT url AS source_url, substr(sha256(url), 1, 26) AS source_id FROM d""")
def l09_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("source_url"), "page_id")
    new = versions.upsert_by_url(pages.filter("page_id % 3 <> 0").select("source_url"), pages.filter("page_id % 3 = 0"))
    return new.select("source_url", "source_id")
