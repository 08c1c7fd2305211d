"""Registered queries: acceptance of proposed values, checked responses, verification across sources, spans, quotes and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions import tabular
from noticelake.operators import ablation, acceptance, amounts, collectors, crossverify, deletes, lineage, profiles, quotes, resampling, spans
from noticelake.operators.facts import PATTERNS
from noticelake.plans.domain import LICENSE
from noticelake.plans.scoring import pick
from noticelake.sources import evolving, responses, scratch, selectors
from noticelake.sources.tables import AWARDS_SQL, awards, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


#: A quote that no text of the tables holds at any level.
ABSENT = "☃☃☃☃"
PROPOSALS_SQL = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, n_chars, source, coalesce(substr(text, 5, 12), '') AS q1,
  CASE WHEN doc_id % 5 = 0 THEN '{ABSENT}' ELSE coalesce(substr(text, 20, 12), '') END AS q2, coalesce(substr(text, 41, 15), '') AS q3 FROM documents),
 d1 AS (SELECT *, CASE WHEN regexp_matches(q1, '[^\\s]') THEN strpos(text, q1) - 1 ELSE -1 END AS s1 FROM d),
 e1 AS (SELECT *, CASE WHEN s1 >= 0 THEN s1 + length(q1) ELSE 0 END AS e1 FROM d1),
 d2 AS (SELECT *, CASE WHEN regexp_matches(q2, '[^\\s]') AND strpos(substr(text, e1 + 1), q2) > 0 THEN e1 + strpos(substr(text, e1 + 1), q2) - 1 ELSE -1 END AS s2 FROM e1),
 e2 AS (SELECT *, CASE WHEN s2 >= 0 THEN s2 + length(q2) ELSE e1 END AS e2 FROM d2),
 d3 AS (SELECT *, CASE WHEN doc_id % 8 <> 0 AND regexp_matches(q3, '[^\\s]') AND strpos(substr(text, e2 + 1), q3) > 0 THEN e2 + strpos(substr(text, e2 + 1), q3) - 1 ELSE -1 END AS s3 FROM e2),
 p AS (SELECT doc_id, text, 1 AS seq, 'amount' AS field_name, 'present' AS field_status, CASE doc_id % 3 WHEN 0 THEN n_chars || '元' WHEN 1 THEN n_chars || ' units' ELSE '' END AS raw_value,
   n_chars::VARCHAR AS known, true AS has_quote, s1 AS s, length(q1) AS n, doc_id % 3 = 0 AS valid FROM d3
  UNION ALL SELECT doc_id, text, 2, 'publish_date', CASE WHEN doc_id % 7 = 0 THEN 'ambiguous' ELSE 'present' END, CASE WHEN doc_id % 4 = 0 THEN '2024-13-01' ELSE '2024-02-29' END,
   '2024-02-29', true, s2, length(q2), doc_id % 4 <> 0 FROM d3
  UNION ALL SELECT doc_id, text, 3, CASE WHEN doc_id % 6 = 0 THEN 'colour' ELSE 'winner_name' END, 'present', source, source, doc_id % 8 <> 0, s3, length(q3), true FROM d3),
 g AS (SELECT *, raw_value <> '' AS has_value, s >= 0 AS located, CASE WHEN field_status = 'ambiguous' OR s < 0 THEN 'low' ELSE 'high' END AS display_grade FROM p),
 r AS (SELECT *, CASE WHEN field_name = 'colour' THEN 'unknown_field' WHEN NOT has_value THEN 'no_value' WHEN NOT has_quote THEN 'no_quote' WHEN NOT located THEN 'not_located'
  WHEN NOT valid THEN 'invalid_value' WHEN display_grade = 'low' THEN 'low_grade' END AS reason FROM g)"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three proposals for each document, with what is known about them: amounts, dates and names, some without a valid value or without a quote."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    chars, none = F.col("n_chars").cast("string"), F.array().cast("array<string>")
    amount = pick(key, F.concat(chars, F.lit("元")), F.concat(chars, F.lit(" units")), F.lit(""))
    second = F.when(key % 5 == 0, F.lit(ABSENT)).otherwise(F.substring(text, 20, 12))
    row = lambda seq, field, status, raw, known, quotes: F.struct(
        F.lit(seq).alias("seq"), field.alias("field_name"), status.alias("field_status"), raw.alias("raw_value"), known.alias("known"), quotes.alias("quotes")
    )
    present = F.lit("present")
    rows = F.array(
        row(1, F.lit("amount"), present, amount, chars, F.array(F.substring(text, 5, 12))),
        row(2, F.lit("publish_date"), F.when(key % 7 == 0, "ambiguous").otherwise(present), F.when(key % 4 == 0, "2024-13-01").otherwise("2024-02-29"), F.lit("2024-02-29"), F.array(second)),
        row(3, F.when(key % 6 == 0, "colour").otherwise("winner_name"), present, F.col("source"), F.col("source"), F.when(key % 8 == 0, none).otherwise(F.array(F.lit(ABSENT), F.substring(text, 41, 15)))),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(rows))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.accept(table(spark, sf_dir, "documents"), proposals(spark, sf_dir))


@query(f"""WITH {PROPOSALS_SQL} SELECT doc_id, seq, field_name, reason IS NULL AS accepted, reason, CASE WHEN located THEN s END::INT AS raw_start, CASE WHEN located THEN s + n END::INT AS raw_end,
 CASE WHEN located THEN substr(text, s + 1, n) END AS evidence_text, CASE WHEN located THEN substr(text, s + n + 1, 40) END AS context_after, display_grade FROM r""")
def e11_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected proposals with the first reason, quotes searched in order over each document."""
    names = ("field_name", "accepted", "reason", "raw_start", "raw_end", "evidence_text", "context_after", "display_grade")
    return _accepted(spark, sf_dir).select("doc_id", "seq", *names)


_SUMMARY_SQL = """SELECT grp AS "group", count(*) AS n, count(*) FILTER (has_value) AS n_values, count(*) FILTER (has_value AND output) AS n_judged,
 count(*) FILTER (has_value AND output AND told)::DOUBLE / nullif(count(*) FILTER (has_value AND output), 0) AS precision, count(*) FILTER (has_value AND NOT justified)::DOUBLE / nullif(count(*) FILTER (has_value), 0) AS unjustified_rate,
 count(*) FILTER (has_value AND output AND gold = '')::DOUBLE / nullif(count(*) FILTER (gold = ''), 0) AS null_false_positive_rate FROM x GROUP BY grp"""


@query(f"""WITH {PROPOSALS_SQL}, k AS (SELECT r.*, CASE WHEN quality = 1 THEN known ELSE '' END AS gold, field_status <> 'ambiguous' AND raw_value <> '' AS shown FROM r JOIN labels USING (doc_id)),
 t AS (SELECT *, has_value AND gold <> '' AND (contains(raw_value, gold) OR contains(gold, raw_value)) AS told FROM k),
 x AS (SELECT 'A' AS grp, has_value, false AS justified, true AS output, told, gold FROM t UNION ALL SELECT 'B', has_value, has_quote, true, told, gold FROM t
  UNION ALL SELECT 'C', has_value, located AND valid, true, told, gold FROM t
  UNION ALL SELECT 'D', has_value, field_status <> 'ambiguous' AND (has_value OR (located AND valid)), field_status <> 'ambiguous' AND (has_value OR (located AND valid)), told, gold FROM t) {_SUMMARY_SQL}""")
def m01_acceptance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups A to D over the rows of the acceptance chain, summed up."""
    gold = F.when(F.col("quality") == 1, F.col("known")).otherwise("").alias("gold")
    chained = _accepted(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return ablation.summary(ablation.group_rows(chained.withColumn("gold", gold)))


#: Responses as texts made of the columns of events; both sides read the JSON.
_NAMES = ("project_identifier", "amount", "winner_name", "colour", "publish_date", None)
_STATUS = ("present", "absent", "multi_value", "odd", None, "ambiguous", "present")
_KINDS = ("budget", "award", "", "gift", None)
_ROLES = ("primary", "context", "witness", None, "qualifier")


def _member_sql(name: str, key: str, values: tuple, word: str) -> str:
    """SQL and Spark share this text: a member with the value that ``key`` picks, nothing where it is None."""
    cases = " ".join(f"WHEN {i} THEN '{'' if v is None else chr(34) + name + chr(34) + ': ' + chr(34) + v + chr(34) + ', '}'" for i, v in enumerate(values))
    return f"CASE CAST({word} AS BIGINT) % {len(values)} {cases} END"


def _response_sql(props: str) -> str:
    head = " || ".join(
        (
            "'{' ",
            _member_sql("field_name", "", _NAMES, "event_id"),
            _member_sql("field_status", "", _STATUS, "user_id"),
            _member_sql("amount_type", "", _KINDS, "user_id"),
            f"'\"raw_value\": ' || CASE event_id % 4 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN {props} WHEN 2 THEN CAST(event_id AS STRING) ELSE 'null' END || ', '",
            "'\"currency\": ' || CASE WHEN event_id % 11 = 0 THEN '7' ELSE '\"CNY\"' END || ', '",
        )
    )
    quotes = "'\"candidate_evidences\": [' || CASE WHEN user_id % 9 = 8 THEN '' ELSE '{' || " + _member_sql("role", "", _ROLES, "event_id + user_id") + " || CASE WHEN user_id % 8 = 7 THEN '\"text\"' ELSE '\"evidence_text\"' END || ': \"' || event_type || '\"}' END || ']}'"
    whole = f"'{{\"fields\": [{{\"field_name\": \"winner_name\", \"raw_value\": {{\"a\": 1}}}}, ' || {head} || {quotes} || ']}}'"
    return f"CASE WHEN event_id % 37 = 0 THEN 'none' WHEN event_id % 41 = 0 THEN '{{\"fields\": []}}' WHEN event_id % 43 = 0 THEN '{{\"field\": 1}}' WHEN event_id % 47 = 0 THEN '{{\"fields\": 3}}' ELSE {whole} END"


_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""WITH t AS (SELECT event_id, {_response_sql("props").replace("AS STRING", "AS VARCHAR")} AS response FROM events),
 v AS (SELECT event_id, CASE WHEN json_valid(response) THEN response::JSON END AS v FROM t),
 f AS (SELECT event_id, unnest(json_extract(v, '$.fields[*]')) AS f, generate_subscripts(json_extract(v, '$.fields[*]'), 1) - 1 AS i FROM v WHERE json_type(v, '$.fields') = 'ARRAY'),
 q AS (SELECT event_id, i, unnest(json_extract(f, '$.candidate_evidences[*]')) AS q, generate_subscripts(json_extract(f, '$.candidate_evidences[*]'), 1) - 1 AS j FROM f),
 qf AS (SELECT event_id, i, j, CASE WHEN NOT json_exists(q, '$.evidence_text') THEN 'missing_evidence_text' WHEN json_exists(q, '$.role') AND q->>'role' NOT IN {_IN(responses.ROLES)} THEN 'bad_role' END AS fault FROM q),
 q1 AS (SELECT event_id, i, arg_min('candidate_evidences[' || j || ']: ' || fault, j) AS fault FROM qf WHERE fault IS NOT NULL GROUP BY ALL),
 ff AS (SELECT f.*, CASE WHEN NOT json_exists(f, '$.field_name') THEN 'missing_field_name' WHEN f->>'field_name' NOT IN {_IN(responses.FIELD_NAMES)} THEN 'bad_field_name'
  WHEN json_exists(f, '$.field_status') AND f->>'field_status' NOT IN {_IN(responses.STATUSES)} THEN 'bad_field_status'
  WHEN f->>'field_name' = 'amount' AND coalesce(f->>'amount_type', '') <> '' AND f->>'amount_type' NOT IN {_IN(responses.AMOUNT_TYPES)} THEN 'bad_amount_type' ELSE q1.fault END AS fault
  FROM f LEFT JOIN q1 USING (event_id, i)),
 f1 AS (SELECT event_id, arg_min('fields[' || i || ']: ' || fault, i) AS fault FROM ff WHERE fault IS NOT NULL GROUP BY ALL),
 r AS (SELECT v.event_id, v.v, CASE WHEN v.v IS NULL THEN 'not_json' WHEN NOT json_exists(v.v, '$.fields') THEN 'missing_fields' WHEN json_type(v.v, '$.fields') <> 'ARRAY' THEN 'fields_not_list'
  WHEN json_array_length(v.v, '$.fields') = 0 THEN 'fields_empty' ELSE f1.fault END AS reason FROM v LEFT JOIN f1 USING (event_id)),
 k AS (SELECT event_id, count(*) FILTER (json_type(f, '$.currency') IN ('UBIGINT', 'BIGINT')) AS n_dropped,
  string_agg(f->>'field_name' || '/' || coalesce(f->>'field_status', 'present') || '/' || coalesce(f->>'raw_value', '') || '/' || coalesce(f->>'$.candidate_evidences[0].role', CASE WHEN json_array_length(f, '$.candidate_evidences') > 0 THEN 'primary' ELSE '' END), ';' ORDER BY i)
   FILTER (coalesce(json_type(f, '$.currency'), '') NOT IN ('UBIGINT', 'BIGINT')) AS told FROM f GROUP BY event_id)
SELECT event_id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN n_dropped END::INT AS n_dropped, CASE WHEN reason IS NULL THEN replace(told, ' ', '') END AS told FROM r LEFT JOIN k USING (event_id)""")
def p27_checked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with the first fault of each, and the fields of those without one."""
    made = table(spark, sf_dir, "events").select("event_id", F.expr(_response_sql("props")).alias("response"))
    found = responses.checked(made)
    one = lambda f: F.concat_ws("/", f["field_name"], f["field_status"], F.coalesce(f["raw_value"], F.lit("")), F.coalesce(F.get(f["candidate_evidences"], F.lit(0))["role"], F.lit("")))
    told = F.replace(F.array_join(F.transform("fields", one), ";"), F.lit(" "), F.lit(""))
    return found.select("event_id", "valid", "reason", "n_dropped", told.alias("told"))


#: Suppliers of a nation whose balances lie within this of the next one's are taken as reposts of each other.
REPOST_GAP = 3000


@query(f"""WITH RECURSIVE s AS (SELECT s_suppkey AS id, lag(s_suppkey) OVER w AS prev, s_acctbal - lag(s_acctbal) OVER w AS gap FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)),
 l AS (SELECT id AS a, prev AS b FROM s WHERE gap <= {REPOST_GAP} UNION ALL SELECT prev, id FROM s WHERE gap <= {REPOST_GAP}),
 reach AS (SELECT s_suppkey AS id, s_suppkey AS c FROM supplier UNION SELECT l.b, c FROM reach JOIN l ON l.a = id), k AS (SELECT id, min(c) AS cluster FROM reach GROUP BY id),
 f AS (SELECT DISTINCT CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey::VARCHAR END AS project_id, 'status' AS field_name, l_linestatus AS value, l_suppkey AS page_id, n_regionkey AS platform, l_returnflag AS notice_type
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT f.*, cluster FROM f JOIN k ON page_id = k.id WHERE project_id IS NOT NULL),
 t AS (SELECT project_id, field_name, notice_type, count(DISTINCT value) > 1 AS contested FROM c GROUP BY ALL), o AS (SELECT project_id, field_name, count(DISTINCT value) > 1 AS several FROM c GROUP BY ALL),
 g AS (SELECT project_id, field_name, value, count(DISTINCT page_id) AS n_pages, count(DISTINCT cluster) AS n_sources, count(DISTINCT platform) AS n_platforms, bool_or(contested) AS contested, bool_or(several) AS several
  FROM c JOIN t USING (project_id, field_name, notice_type) JOIN o USING (project_id, field_name) GROUP BY ALL)
SELECT project_id, field_name, value, n_pages, n_sources, CASE WHEN contested THEN 'conflict' WHEN several THEN 'version_difference' WHEN n_pages = 1 THEN 'single_source' WHEN n_sources = 1 THEN 'same_origin'
 WHEN n_platforms > 1 THEN 'independent' ELSE 'consistent_unknown' END AS state FROM g""")
def g04_cross_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the status that suppliers state of an order: suppliers of near balances in a nation are reposts of each other, over any number of steps."""
    suppliers, order = table(spark, sf_dir, "supplier"), F.col("l_orderkey")
    by = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    near = suppliers.select(F.col("s_suppkey").alias("a"), F.lag("s_suppkey").over(by).alias("b"), (F.col("s_acctbal") - F.lag("s_acctbal").over(by)).alias("gap"))
    clusters = lineage.repost_clusters(near.filter(F.col("gap") <= REPOST_GAP))
    placed = suppliers.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    claims = table(spark, sf_dir, "lineitem").join(placed, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.when(order % 50 != 0, order.cast("string")).alias("project_id"),
        F.lit("status").alias("field_name"),
        F.col("l_linestatus").alias("value"),
        F.col("l_suppkey").alias("page_id"),
        F.col("n_regionkey").alias("platform"),
        F.col("l_returnflag").alias("notice_type"),
    )
    return crossverify.states(claims, clusters)


SPANS_SQL = """f AS (SELECT doc_id, k * 30 + doc_id % 7 AS s, k * 30 + doc_id % 7 + 15 + k % 20 AS e FROM (SELECT doc_id, unnest(range(0, n_chars // 30)) AS k FROM documents)),
 g AS (SELECT doc_id, k * 45 + doc_id % 11 AS s, k * 45 + doc_id % 11 + 25 AS e FROM (SELECT doc_id, unnest(range(0, n_chars // 45)) AS k FROM documents))"""


@query(f"""WITH {SPANS_SQL}, p AS (SELECT f.doc_id, f.s, f.e, max((least(f.e, g.e) - greatest(f.s, g.s))::DOUBLE / (greatest(f.e, g.e) - least(f.s, g.s))) AS iou FROM f JOIN g ON f.doc_id = g.doc_id AND f.s < g.e AND g.s < f.e GROUP BY ALL)
SELECT doc_id, f.s AS start, f.e AS "end", coalesce(iou, 0) AS iou, coalesce(iou, 0) >= 0.5 AS matched FROM f LEFT JOIN p USING (doc_id, s, e)""")
def m06_binned_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans all along each document with their best overlap; those of the gold side count from where a body begins."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    along = lambda step: docs.filter(F.col("n_chars") >= step).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / step) - 1)).alias("k"))
    start = F.col("k") * 30 + key % 7
    found = along(30).select("doc_id", start.alias("start"), (start + 15 + F.col("k") % 20).alias("end"))
    body = key % 4 * 5
    start = F.col("k") * 45 + key % 11 - body
    gold = along(45).select("doc_id", start.alias("start"), (start + 25).alias("end"))
    return spans.best_overlap(found, gold, ["doc_id"], offset=body)


@query("""WITH q AS (SELECT item_id * 100 + k AS quote_id, substr(text, 1 + 10 * k, 8) AS quote FROM (SELECT item_id, text, unnest(range(0, length(text) // 10)) AS k FROM benchmark) WHERE length(substr(text, 1 + 10 * k, 8)) = 8),
 w AS (SELECT doc_id, i AS start, substr(text, i + 1, 8) AS quote FROM (SELECT doc_id, text, unnest(range(0, length(text) - 7)) AS i FROM documents)),
 p AS (SELECT doc_id, quote_id, start FROM w JOIN q USING (quote)),
 m AS (SELECT doc_id, k * 200 + doc_id % 50 AS mark FROM (SELECT doc_id, unnest(range(0, n_chars // 200)) AS k FROM documents)),
 n AS (SELECT DISTINCT p.doc_id, start FROM p JOIN m ON p.doc_id = m.doc_id AND abs(start - mark) <= 50)
SELECT doc_id, quote_id, start::INT AS start, n.start IS NOT NULL AS near FROM p LEFT JOIN n USING (doc_id, start)""")
def x04_quotes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of pieces of all benchmark items in all documents, and whether one of the marks along a document is near."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    piece = F.substring("text", F.col("k") * 10 + 1, F.lit(8))
    cut = items.filter(F.length("text") >= 10).select("item_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 10).cast("int") - 1)).alias("k"))
    wanted = cut.select((F.col("item_id") * 100 + F.col("k")).alias("quote_id"), piece.alias("quote")).filter(F.length("quote") == 8)
    marks = docs.filter(F.col("n_chars") >= 200).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 200) - 1)).alias("k"))
    marks = marks.select("doc_id", (F.col("k") * 200 + F.col("doc_id") % 50).alias("start"))
    return quotes.near_annotations(quotes.all_places(docs, wanted), marks, ["doc_id"])


#: Tables of stored notices over the given ones, and the addresses to be forgotten.
FORGOTTEN = ("u3", "u17", "u250", "u77")
STORE_SQL = {
    "notice_sources": "SELECT o_orderkey AS notice_source_id, o_custkey AS notice_id, 'u' || (o_custkey % 500) AS source_url, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || (o_orderkey % 400) END AS origin_url FROM orders",
    "notice_versions": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS notice_source_id FROM lineitem",
    "notice_participants": "SELECT c_custkey AS id, c_custkey AS notice_id FROM customer",
    "tenders": "SELECT p_partkey AS id, 'u' || (p_partkey % 700) AS source_url FROM part",
    "extracted_fields": "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS tender_id FROM lineitem",
    "field_evidence_links": "SELECT l_orderkey * 10 + l_linenumber AS field_id, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN lag(l_partkey * 100000 + l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) END, l_partkey * 100000 + l_suppkey) AS evidence_id FROM lineitem",
    "evidence": "SELECT DISTINCT l_partkey * 100000 + l_suppkey AS id, l_partkey AS tender_id FROM lineitem",
    "party_roles": "SELECT s_suppkey AS id, s_suppkey AS tender_id FROM supplier",
    "push_logs": "SELECT event_id AS id, user_id AS tender_id FROM events",
    "scrape_jobs": "SELECT c_custkey AS id, 'u' || c_custkey AS url FROM customer",
}


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of STORE_SQL; the text is that of the stated result, read by Spark."""
    given = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "part", "supplier", "events")}
    named = lambda text: text.replace(" FROM ", " FROM {").rstrip() + "}"
    return {name: spark.sql(named(text), **{n: df for n, df in given.items() if text.endswith(f" {n}")}) for name, text in STORE_SQL.items()}


DOOMED_SQL = f"""{", ".join(f"{n} AS ({s})" for n, s in STORE_SQL.items())}, a AS (SELECT unnest([{", ".join(f"'{x}'" for x in FORGOTTEN)}]) AS u),
 c_notice_sources AS (SELECT *, notice_source_id AS k, CASE WHEN source_url IN (FROM a) THEN 'source_url' WHEN origin_url IN (FROM a) THEN 'origin_url' END AS cause, false AS stays FROM notice_sources),
 c_tenders AS (SELECT *, id AS k, CASE WHEN source_url IN (FROM a) THEN 'source_url' END AS cause, false AS stays FROM tenders),
 c_scrape_jobs AS (SELECT *, id AS k, CASE WHEN url IN (FROM a) THEN 'url' END AS cause, false AS stays FROM scrape_jobs),
 gs AS (SELECT notice_source_id FROM c_notice_sources WHERE cause IS NOT NULL), gn AS (SELECT notice_id FROM c_notice_sources WHERE cause IS NOT NULL), gt AS (SELECT id FROM c_tenders WHERE cause IS NOT NULL),
 c_notice_versions AS (SELECT *, id AS k, CASE WHEN notice_source_id IN (FROM gs) THEN 'notice_sources.notice_source_id' END AS cause, false AS stays FROM notice_versions),
 c_notice_participants AS (SELECT *, id AS k, CASE WHEN notice_id IN (FROM gn) THEN 'notice_sources.notice_id' END AS cause, false AS stays FROM notice_participants),
 c_extracted_fields AS (SELECT *, id AS k, CASE WHEN tender_id IN (FROM gt) THEN 'tenders.id' END AS cause, false AS stays FROM extracted_fields),
 gf AS (SELECT id FROM c_extracted_fields WHERE cause IS NOT NULL),
 c_field_evidence_links AS (SELECT *, field_id AS k, CASE WHEN field_id IN (FROM gf) THEN 'extracted_fields.id' END AS cause, false AS stays FROM field_evidence_links),
 c_evidence AS (SELECT *, id AS k, CASE WHEN tender_id IN (FROM gt) THEN 'tenders.id' END AS cause, id IN (SELECT evidence_id FROM c_field_evidence_links WHERE cause IS NULL) AS stays FROM evidence),
 c_party_roles AS (SELECT *, id AS k, CASE WHEN tender_id IN (FROM gt) THEN 'tenders.id' END AS cause, false AS stays FROM party_roles),
 c_push_logs AS (SELECT *, id AS k, CASE WHEN tender_id IN (FROM gt) THEN 'tenders.id' END AS cause, false AS stays FROM push_logs),
 marked AS ({" UNION ALL ".join(f"SELECT '{n}' AS tab, k, cause, stays FROM c_{n}" for n in STORE_SQL)})"""


def _forgotten(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return deletes.delete_closure(_store(spark, sf_dir), spark.createDataFrame([(u,) for u in FORGOTTEN], "address string"))


@query(f"""WITH {DOOMED_SQL} SELECT tab AS "table", k AS id FROM marked WHERE cause IS NULL OR stays""")
def d05_kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all tables that stay when some addresses are forgotten."""
    ids = {"notice_sources": "notice_source_id", "field_evidence_links": "field_id"}
    kept = [df.select(F.lit(n).alias("table"), F.col(ids.get(n, "id")).alias("id")) for n, df in _forgotten(spark, sf_dir)[0].items()]
    return reduce(DataFrame.unionByName, kept)


@query(f"""WITH {DOOMED_SQL} SELECT tab AS "table", cause, count(*) FILTER (NOT stays) AS deleted, count(*) FILTER (stays) AS spared, 'source_url' AS deletion_scope, '{",".join(FORGOTTEN)}' AS target, 'owner' AS operator,
 substr(sha256('source_url|{",".join(FORGOTTEN)}|request|owner|2024-01-31|' || tab || '|' || cause), 1, 16) AS audit_id FROM marked WHERE cause IS NOT NULL GROUP BY ALL""")
def d09_deletion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was deleted and what was spared, per table and cause, under the name of who asked for it."""
    audit = deletes.audit_record(_forgotten(spark, sf_dir)[1], "source_url", ",".join(FORGOTTEN), "request", "owner", "2024-01-31")
    return audit.drop("request_basis", "executed_at")


@query(f"""WITH {", ".join(f"{n} AS ({STORE_SQL[n]})" for n in ("notice_sources", "notice_versions", "notice_participants"))}, g AS (SELECT * FROM notice_sources WHERE notice_source_id % 1000 = 7)
SELECT 'notice_sources' AS "table", 'notice_source_id' AS cause, count(*) AS deleted, 0::BIGINT AS spared FROM g HAVING count(*) > 0
UNION ALL SELECT 'notice_versions', 'notice_sources.notice_source_id', count(*), 0 FROM notice_versions WHERE notice_source_id IN (SELECT notice_source_id FROM g) HAVING count(*) > 0
UNION ALL SELECT 'notice_participants', 'notice_sources.notice_id', count(*), 0 FROM notice_participants WHERE notice_id IN (SELECT notice_id FROM g) HAVING count(*) > 0""")
def d06_source_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the deletion of sources by their ids, with their versions and participants."""
    own = ("notice_sources", "notice_versions", "notice_participants")
    tables = {n: df for n, df in _store(spark, sf_dir).items() if n in own}
    ids = tables["notice_sources"].filter("notice_source_id % 1000 = 7").select("notice_source_id")
    return deletes.delete_closure(tables, ids, roots={"notice_sources": ("notice_source_id",)})[1]


@query("""WITH u AS (SELECT DISTINCT CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey END AS project, l_returnflag AS value, l_linestatus AS kind FROM lineitem), v AS (SELECT * FROM u WHERE project IS NOT NULL)
SELECT project, value, kind, (SELECT count(*) FROM v b WHERE b.project = a.project AND b.kind = a.kind AND b.value <> a.value) AS n_conflicts,
 (SELECT count(*) FROM v b WHERE b.project = a.project AND b.kind <> a.kind AND b.value <> a.value) AS n_version_diffs FROM v a""")
def l07_conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What contradicts each assertion about an order; a tenth of the rows has no project."""
    project = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select(project.alias("project"), F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("kind"))
    return lineage.conflict_counts(rows, ["project"], "value", "kind")


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>.*?</li>')) AS li, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>.*?</li>'), 1) - 1 AS item FROM pages),
 a AS (SELECT *, regexp_extract(li, '<a href="([^"]*)"', 1) AS href, regexp_extract(li, '<a [^>]*>([^<]*)</a>', 1) AS t FROM l)
SELECT page_id, item::INT AS item, replace(t, '&amp;', '&') AS title, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(href, '&amp;', '&') ELSE nullif(replace(href, '&amp;', '&'), '') END AS url FROM a""")
def src07_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the navigation of every page by selectors, with their texts and absolute addresses."""
    return selectors.scrape(table(spark, sf_dir, "pages"), selectors.NAVIGATION)


@query("""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages)
SELECT page_id, 0::INT AS item, CASE WHEN body LIKE '%<h1>%' THEN trim(replace(regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&')) END AS title,
 CASE WHEN html LIKE '%<nav>%<a href="/%</nav>%' THEN replace(regexp_extract(html, '<a href="/[^"]*">([^<]*)</a>', 1), '&amp;', '&') END AS link FROM a""")
def src08_article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every article and the text of the page's first inner link, by a template without a list."""
    return selectors.scrape(table(spark, sf_dir, "pages"), selectors.ARTICLE).drop("first")


@query()
def m10_exact_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents with its interval, sources resampled with exactly as many draws as there are sources."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("one", F.lit(1))
    return resampling.interval(rows, "source", "quality", "one", replicates=500)


@query(f"""WITH p AS (SELECT doc_id, string_split(text, '{LICENSE}') AS parts FROM documents WHERE contains(text, '{LICENSE}')),
 k AS (SELECT doc_id, parts, unnest(range(0, len(parts) - 1)) AS number FROM p)
SELECT doc_id, number::INT AS number, (list_sum(list_transform(parts[1:number + 1], lambda x: length(x))) + number * {len(LICENSE)})::INT AS start FROM k""")
def e08_lateral_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a quote in every document, by a table function in a LATERAL join; only texts that hold the quote are handed to Python."""
    tabular.register(spark)
    holding = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit(LICENSE))).select("doc_id", "text")
    return spark.sql(f"SELECT doc_id, o.number, o.start FROM {{docs}} AS d, LATERAL occurrences(d.text, '{LICENSE}', CAST(NULL AS INT)) AS o", docs=holding)


@query(
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS fact, '{k}' AS category FROM documents" for k, p in PATTERNS.items())
    + ") SELECT DISTINCT doc_id, source, category, trim(fact) AS fact FROM f"
)
def p23_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every document, by a table function over the documents as a partitioned table; its schema comes from theirs."""
    tabular.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spark.sql("SELECT * FROM facts(TABLE(SELECT * FROM {docs}) PARTITION BY (doc_id), 'text')", docs=docs)


#: The columns of the batches that x11_evolving_table writes, in the order in which they were added.
EVOLVED = [
    evolving.Added("id", "bigint"), evolving.Added("amount", "decimal(20,2)"), evolving.Added("published", "timestamp"),
    evolving.Added("kind", "string", "tender", 2), evolving.Added("checked", "boolean", False, 3), evolving.Added("score", "double", None, 3),
]


@query("""WITH b AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS INT) AS amount, CAST(o_orderdate AS DATE)::TIMESTAMP AS published, 'tender' AS kind, false AS checked, NULL::DOUBLE AS score, 1 AS schema_version FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)), o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, false, NULL, 2 FROM orders WHERE o_orderkey % 3 = 1
 UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)), o_orderdate, o_orderstatus, o_custkey % 2 = 0, o_custkey / 4, 3 FROM orders WHERE o_orderkey % 3 = 2)
SELECT schema_version, kind, checked, count(*) AS n, count(score) AS n_scored, sum(amount)::DOUBLE AS amount, min(published) AS first_published FROM b GROUP BY ALL""")
def x11_evolving_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as three batches, before and after columns were added and types widened, and read back as one table."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price, at = F.col("o_totalprice"), F.col("o_orderdate")
    batches = (
        orders.filter(key % 3 == 0).select(key.alias("id"), F.floor(price).cast("int").alias("amount"), at.cast("date").alias("published")),
        orders.filter(key % 3 == 1).select(key.alias("id"), price.cast("decimal(18,2)").alias("amount"), at.alias("published"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("kind")),
        orders.filter(key % 3 == 2).select(key.alias("id"), price.cast("decimal(18,2)").alias("amount"), at.alias("published"), F.col("o_orderstatus").alias("KIND"), (F.col("o_custkey") % 2 == 0).alias("checked"), (F.col("o_custkey") / 4).cast("float").alias("score"), F.lit(1).alias("left_out")),
    )
    paths = [scratch.written(b) for b in batches]
    whole = evolving.read_evolving(spark, paths, EVOLVED)
    sums = (F.count("*").alias("n"), F.count("score").alias("n_scored"), F.sum("amount").cast("double").alias("amount"), F.min("published").alias("first_published"))
    return whole.groupBy("schema_version", "kind", "checked").agg(*sums)


@query(f"""WITH {AWARDS_SQL}, s AS (SELECT winner AS organisation, count(*) AS n_winner, sum(CAST(win_amount AS DECIMAL(18,2))) AS won FROM (SELECT 'org' || (notice_id % 211) AS winner, win_amount FROM awards) GROUP BY ALL),
 b AS (SELECT 'org' || (o_custkey % 307) AS organisation, count(*) AS n_purchaser, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS bought FROM orders GROUP BY ALL)
SELECT organisation, coalesce(n_winner, 0) AS n_winner, coalesce(won, 0)::DOUBLE AS amount_winner, coalesce(n_purchaser, 0) AS n_purchaser, coalesce(bought, 0)::DOUBLE AS amount_purchaser,
 (coalesce(won, 0) + coalesce(bought, 0))::DOUBLE AS total FROM s FULL JOIN b USING (organisation)""")
def a10_both_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What organisations have won and bought, some of them both."""
    won = awards(spark, sf_dir).select(F.concat(F.lit("org"), (F.col("notice_id") % 211).cast("string")).alias("who"), "win_amount")
    bought = table(spark, sf_dir, "orders").select(F.concat(F.lit("org"), (F.col("o_custkey") % 307).cast("string")).alias("who"), "o_totalprice")
    return profiles.role_sums({"winner": (won, "who", "win_amount"), "purchaser": (bought, "who", "o_totalprice")})


def _top_sql(column: str) -> str:
    return f"SELECT winner, string_agg(v, ',' ORDER BY k) AS {column} FROM (SELECT winner, {column} AS v, row_number() OVER (PARTITION BY winner ORDER BY count(*) DESC, {column}) AS k FROM w WHERE coalesce({column}, '') <> '' GROUP BY winner, {column}) WHERE k <= 5 GROUP BY winner"


@query(f"""WITH {AWARDS_SQL}, w AS (SELECT awards.*, CASE WHEN lot % 4 <> 0 THEN 'agency ' || (notice_id % 13) WHEN lot % 8 = 0 THEN '' END AS agency FROM awards),
 p AS ({_top_sql("purchaser")}), a AS ({_top_sql("agency")}), r AS ({_top_sql("region")}),
 s AS (SELECT winner, count(*) AS win_count, sum(CAST(win_amount AS DECIMAL(18,2)))::DOUBLE AS total_win_amount, strftime(min(win_date), '%Y-%m-%d') AS first_win_date, strftime(max(win_date), '%Y-%m-%d') AS last_win_date FROM w GROUP BY winner)
SELECT s.*, coalesce(purchaser, '') AS purchaser, coalesce(agency, '') AS agency, coalesce(region, '') AS region FROM s LEFT JOIN p USING (winner) LEFT JOIN a USING (winner) LEFT JOIN r USING (winner)""")
def a16_full_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of suppliers with their main purchasers, agencies and regions."""
    lot = F.col("lot")
    agency = F.when(lot % 4 != 0, F.concat(F.lit("agency "), (F.col("notice_id") % 13).cast("string"))).when(lot % 8 == 0, "")
    found = profiles.supplier_profiles(awards(spark, sf_dir).withColumn("agency", agency))
    return found.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("purchaser", "agency", "region")})


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey % 6 AS t, (l_orderkey + l_linenumber) % 7 AS f FROM lineitem),
 v AS (SELECT *, CASE t WHEN 0 THEN NULL WHEN 1 THEN 'award' WHEN 2 THEN 'unknown' WHEN 3 THEN 'gift' WHEN 4 THEN 'budget' ELSE '' END AS kind, CASE f WHEN 3 THEN 0 ELSE q END AS n,
  CASE f WHEN 0 THEN '元' WHEN 1 THEN '万元' WHEN 2 THEN '亿元' WHEN 3 THEN '' WHEN 4 THEN '万元' END AS unit FROM l),
 e AS (SELECT *, CASE WHEN f = 6 THEN 'empty' WHEN kind = 'gift' THEN 'bad_type' WHEN f = 5 THEN 'bad_format' END AS error, n * CASE unit WHEN '万元' THEN 10000.0::DOUBLE WHEN '亿元' THEN 100000000.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM v)
SELECT l_orderkey, l_linenumber, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN value END AS value, CASE WHEN error IS NULL THEN CASE f WHEN 4 THEN 'USD' ELSE 'CNY' END END AS currency,
 CASE WHEN error IS NULL AND kind IN ('award', 'budget') THEN kind END AS amount_type, CASE WHEN error IS NULL THEN CASE WHEN n = 0 THEN 1 ELSE 0 END END::INT AS n_warnings,
 CASE WHEN error IS NULL THEN nullif(concat_ws(' | ', CASE WHEN kind = 'unknown' THEN 'amount_type=unknown→None' END,
  CASE WHEN f = 1 THEN '剥离前缀: ''中标金额：人民币' || q || '万元（含税）...'' → ''' || q || '万元（含税）''' END,
  CASE WHEN f = 2 THEN '括号单位展开: ''（亿元）'' → ''亿元''' END, CASE WHEN f = 1 THEN '剥离后缀: ''（含税）''' END,
  CASE WHEN unit = '亿元' THEN q || '.0亿 × 10^8 = ' || q || '00000000.0元' WHEN unit = '万元' THEN q || '.0万 × 10^4 = ' || q || '0000.0元' END), '') END AS derivation_rule FROM e""")
def v01_amount_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in seven shapes and with six kinds of types, with errors, warnings and rules."""
    q = F.col("l_quantity").cast("long").cast("string")
    cat = lambda *x: F.concat(*(F.lit(i) if isinstance(i, str) else i for i in x))
    shape = pick(F.col("l_orderkey") + F.col("l_linenumber"), cat(q, "元"), cat("中标金额：人民币", q, "万元（含税）"), cat(q, " （亿元）"), F.lit("0"), cat("$", q, "万元"), cat("about ", q), F.lit("  "))
    kind = pick(F.col("l_partkey"), F.lit(None).cast("string"), F.lit("award"), F.lit("unknown"), F.lit("gift"), F.lit("budget"), F.lit(""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shape.alias("raw"), kind.alias("kind"))
    a = amounts.validated(rows, "raw", "kind")
    return a.select("l_orderkey", "l_linenumber", "amount.valid", "amount.error", "amount.value", "amount.currency", "amount.amount_type", F.when(F.col("amount.valid"), F.size("amount.warnings")).alias("n_warnings"), "amount.derivation_rule")


#: Jobs and notices of collectors over events and orders; the day that counts as today.
TODAY, PLATFORMS = "2024-01-29", ("p0", "p1", "p2", "p3", "p9")
JOBS_SQL = """j AS (SELECT event_id AS job_id, 'p' || (user_id % 6) AS code, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND user_id % 6 <> 2 THEN 'running' WHEN event_type = 'click' AND user_id % 5 = 0 AND user_id % 6 = 1 THEN 'pending' ELSE 'completed' END AS status,
  ts AS created_at, ts + INTERVAL 1 HOUR AS completed_at, CASE event_id % 4 WHEN 0 THEN '{"ingest": {"duplicates": ' || (event_id % 10) || '}}' WHEN 1 THEN '{"duplicates": ' || (event_id % 7) || '}' WHEN 2 THEN '{"ingest": 3}' ELSE 'broken' END AS result_data FROM events),
 n AS (SELECT 'p' || (event_id % 5) AS code, ts AS created_at FROM events WHERE event_type = 'purchase')"""


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events, key, user, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    status = F.when(kind == "error", "failed").when((kind == "signup") & (user % 6 != 2), "running").when((kind == "click") & (user % 5 == 0) & (user % 6 == 1), "pending").otherwise("completed")
    data = pick(key, F.concat(F.lit('{"ingest": {"duplicates": '), text(key % 10), F.lit("}}")), F.concat(F.lit('{"duplicates": '), text(key % 7), F.lit("}")), F.lit('{"ingest": 3}'), F.lit("broken"))
    at = F.col("ts").cast("timestamp")
    jobs = events.select(key.alias("job_id"), F.concat(F.lit("p"), text(user % 6)).alias("code"), status.alias("status"), at.alias("created_at"), (at + F.expr("INTERVAL 1 HOUR")).alias("completed_at"), data.alias("result_data"))
    return jobs, events.filter(kind == "purchase").select(F.concat(F.lit("p"), text(key % 5)).alias("code"), at.alias("created_at"))


@query(f"""WITH {JOBS_SQL}, f AS (SELECT unnest(['{"', '".join(PLATFORMS)}']) AS code),
 a AS (SELECT code, count(*) FILTER (status IN ('pending', 'running')) AS active, count(*) FILTER (status = 'failed') AS failed_count, max(completed_at) FILTER (status = 'completed') AS completed FROM j WHERE created_at >= TIMESTAMP '{TODAY}' GROUP BY code),
 b AS (SELECT code, count(*) AS collected, max(created_at) AS fetched FROM n WHERE created_at >= TIMESTAMP '{TODAY}' GROUP BY code)
SELECT code, CASE WHEN active > 0 THEN 'running' WHEN failed_count > 0 THEN 'failed' ELSE 'idle' END AS status, coalesce(collected, 0) AS collected, coalesce(failed_count, 0) AS failed_count,
 strftime(greatest(completed, fetched), '%Y-%m-%d %H:%M:%S') AS last_fetch FROM f LEFT JOIN a USING (code) LEFT JOIN b USING (code)""")
def a14_platform_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each fixed platform today: running beats failed, which beats idle."""
    found = collectors.platform_states(*_jobs(spark, sf_dir), list(PLATFORMS), TODAY)
    return found.withColumn("last_fetch", F.date_format("last_fetch", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {JOBS_SQL}, c AS (SELECT * FROM j WHERE status = 'completed' AND completed_at >= TIMESTAMP '{TODAY}' ORDER BY completed_at DESC, job_id DESC LIMIT 50),
 d AS (SELECT coalesce(sum(CASE job_id % 4 WHEN 0 THEN job_id % 10 WHEN 1 THEN job_id % 7 ELSE 0 END), 0)::BIGINT AS today_deduplicated FROM c)
SELECT count(*) FILTER (status IN ('pending', 'running')) AS active_jobs, (SELECT count(*) FROM n WHERE created_at >= TIMESTAMP '{TODAY}') AS today_collected,
 count(*) FILTER (status = 'failed' AND created_at >= TIMESTAMP '{TODAY}') AS today_failed, (SELECT today_deduplicated FROM d) AS today_deduplicated FROM j""")
def a14_collector_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs, and what was collected, failed and found twice today."""
    return collectors.totals(*_jobs(spark, sf_dir), TODAY)
