"""Registered queries over whole tables beside those whose SQL states a part: all of the text, rows and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as tx
from noticelake.operators import evidence as ev
from noticelake.operators import facts, lineage, signals, simhash
from noticelake.operators import filters as f
from noticelake.sources.scratch import stored
from noticelake.sources.tables import AWARDS_SQL, awards, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


@query("""SELECT doc_id, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'th', ''))) // 2)::BIGINT AS n FROM documents""")
def x04_occurrences_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places, overlapping ones too, of a short quote in whole texts."""
    n = ev.overlapping_occurrences(F.col("text"), "th")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n"))


@query("""WITH g AS (SELECT p_partkey, list_distinct([substr(p_name, i, 2) FOR i IN range(1, length(p_name))]) AS a, list_distinct([substr(p_type, i, 2) FOR i IN range(1, length(p_type))]) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS similarity FROM g""")
def n08_jaccard_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of name and type of every part."""
    near = tx.jaccard(tx.bigrams(F.col("p_name")), tx.bigrams(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", near.alias("similarity"))


@query(f"""WITH {AWARDS_SQL} SELECT winner, count(*) AS n, string_agg(DISTINCT region, ',' ORDER BY region) AS items FROM awards GROUP BY winner""")
def s03_links_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each winner over all lots."""
    listed = signals.link_lists(awards(spark, sf_dir), "winner", "region")
    return listed.select("winner", "n", F.array_join("items", ",").alias("items"))


@query()
def p23_facts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all seven categories."""
    found = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode_outer(facts.facts(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.category", "f.value").filter("category is not null")


@query()
def l06_reposts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all pairs of pages whose texts are within the fingerprint's radius, by what address and html hold.

    The table names no project, kind, publisher or date of a page: these four features are null and never agree.
    """
    none = F.lit(None).cast("string")
    bare = F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1\\s*>|<title\\b.*?</title\\s*>|<!--.*?-->|<[^>]*>", " ")
    content = F.trim(F.regexp_replace(bare, "\\s+", " "))
    read = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("id"), "url", "html", content.alias("content"))
    read = read.withColumn("simhash", simhash.simhash_column()("content"))
    # Of a text the verdict asks whether it is empty and which marks it has, so pairs carry its marks and not the text.
    marks = F.concat_ws(" ", F.lit("x"), *(F.regexp_extract("content", m, 0) for m in (lineage.REPOST_MARKS, lineage.UPSTREAM_MARKS)))
    content = F.when(F.col("content") == "", "").when(F.col("content").isNotNull(), marks).alias("content")
    page = F.struct(
        f.host("url").alias("host"), content, none.alias("identifier"), none.alias("notice_type"),
        F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1).alias("title"), "simhash", none.alias("publisher"), none.alias("published"),
        F.regexp_extract_all("html", F.lit("(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+\\.(?:pdf|docx?|xlsx?|zip|rar))"), F.lit(1)).alias("links"),
    )
    told = stored(read.select("id", "simhash", page.alias("x")).select("id", "simhash", lineage.repost_told("x").alias("x")))
    # A row that is near stands for all rows of its page.
    rows = told.select("id", "simhash").join(told.select("id", "x"), "id")
    met = simhash.near_lists(rows, F.struct("id", "x"))
    pairs = met.select("same", "r", F.explode("l").alias("l")).select("same", "l", F.explode("r").alias("r"))
    a, b = F.col("l.id"), F.col("r.id")
    verdict = lineage.told_verdict(F.col("l.x"), F.col("r.x"))
    return pairs.filter((a < b) | ((a > b) & ~F.col("same"))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), verdict.alias("verdict"))


@query("""WITH RECURSIVE big AS (SELECT l_orderkey AS o, l_suppkey AS b FROM lineitem WHERE l_quantity > 45), first AS (SELECT o, min(b) AS a FROM big GROUP BY o), e AS (SELECT DISTINCT a, b FROM big JOIN first USING (o)),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def l14_clusters_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster): the cluster of each organisation by shared large awards, named by its least member."""
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("b"))
    first = big.groupBy("o").agg(F.min("b").alias("a"))
    return lineage.repost_clusters(big.join(first, "o").select("a", "b").distinct()).select("id", "cluster")
