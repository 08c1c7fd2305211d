"""Readers of notice texts, gold annotations, checkpoints and stored pages, and the writers that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "array<struct<role:string,start:int,end:int,text:string>>"
GOLD_LIST = f"array<struct<field_name:string,gold_status:string,values:array<struct<raw_value:string,normalized_value:string,acceptable_evidence_spans:{SPAN}>>>>"
GOLD_DICT = f"map<string,struct<status:string,values:array<string>,acceptable_evidence_spans:{SPAN}>>"
GOLD_VALUE = "array<struct<field_name:string,gold_status:string,value:string>>"


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Raw notice files: four "# " header lines, then a body that begins at the first "## "."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), "value")
    part = F.split("value", "\n", 5)
    head = lambda i, key: F.trim(F.regexp_replace(F.try_element_at(part, F.lit(i)), f"^#\\s*{key}", ""))
    at = F.locate("## ", F.col("value")) - 1
    return whole.select(
        "document_id",
        head(1, "").alias("title"),
        head(2, "URL:").alias("source_url"),
        head(3, "Type:").alias("notice_type"),
        head(4, "Fetched:").alias("fetched"),
        F.when(at >= 0, F.substring("value", at + 1, F.length("value"))).otherwise("").alias("body"),
        at.alias("body_offset"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold files in any of three shapes as (document_id, field_name, gold_status, values)."""
    docs = spark.read.schema("document_id string, fields string").option("multiLine", True).json(path)
    listed, named, single = (F.from_json("fields", t) for t in (GOLD_LIST, GOLD_DICT, GOLD_VALUE))
    row = lambda name, status, values: F.struct(name.alias("field_name"), status.alias("gold_status"), values.alias("values"))
    of_list = F.transform(listed, lambda f: row(f["field_name"], f["gold_status"], F.transform(f["values"], lambda v: v["raw_value"])))
    of_dict = F.transform(F.map_entries(named), lambda e: row(e["key"], e["value"]["status"], e["value"]["values"]))
    of_value = F.transform(single, lambda f: row(f["field_name"], f["gold_status"], F.when(f["value"].isNotNull(), F.array(f["value"])).otherwise(F.array().cast("array<string>"))))
    has_values = F.exists(listed, lambda f: f["values"].isNotNull())
    shape = F.when(F.startswith(F.ltrim("fields"), F.lit("{")), of_dict).when(has_values, of_list).otherwise(of_value)
    return docs.select("document_id", F.inline(shape))


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Last record per key of JSON lines that are appended to, files in the order of their paths; lines that do not parse are passed over.

    Spark deals files to tasks by size; a line's place is its file, the block that it was read in, and its row within the block.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("line"))
    parsed = lines.select("line", F.from_json("value", schema).alias("r")).filter(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(f"r.{key}").agg(F.max_by("r", "line").alias("r")).select("r.*")


@dataclass(frozen=True)
class Template:
    """Patterns of a platform's pages: fields by a regular expression, and the fields that are addresses."""

    name: str
    fields: dict[str, str]
    addresses: tuple[str, ...] = ("url",)


TEMPLATES = {"plain": Template("plain", {"title": "(?is)<title[^>]*>(.*?)</title>", "url": "(?is)<a[^>]+href=[\"']([^\"']+)"})}


def absolute(base: Column, link: Column) -> Column:
    """An address relative to a page's own."""
    root = F.regexp_extract(base, "^[a-z]+://[^/]+", 0)
    return F.when(link.rlike("^[a-z]+://"), link).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(root, F.lit("/"), link))


def scrape(pages: DataFrame, template: Template, url: str = "url", html: str = "html") -> DataFrame:
    """Fields of stored pages by a template; addresses are made absolute."""
    found = {k: F.trim(F.regexp_extract(html, p, 1)) for k, p in template.fields.items()}
    made = [(absolute(F.col(url), c) if k in template.addresses else c).alias(f"found_{k}") for k, c in found.items()]
    return pages.select(*[c for c in pages.columns if c != html], *made)


def append_table(df: DataFrame, path: str, batch: str, partition: list[str] | None = None) -> None:
    """Write one batch under its own name, so that a repeated write replaces it and nothing is doubled."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch", *(partition or [])).parquet(path)
