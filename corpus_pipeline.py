"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of ``documents``; the last adds the tokens.
Tables that a stage needs besides ``docs`` are read from ``sf_dir``.

Defined results: empty tables give empty ones; a null text counts as an empty one and
stays null until its tokens, of which it has none, are counted; texts are read whole,
whatever their length; a null in any other column stays; columns beyond those of
``documents`` pass through all stages, and a result whose name is taken gets another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import bpe, decontam, neardup, pii, quality_zstd
from noticelake.llm.common import fresh, table
from noticelake.llm.scratch import stored

#: Shingle size and least percentage of similarity of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Rows without an id are scored by their text like all others; repeated rows all go or all stay; a score at the threshold stays.
    """
    return quality_zstd.keep_good(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id.

    Rows without an id and texts without words stay; of rows that repeat an id, one stays if the id does.
    """
    return neardup.keep_one(docs, SHINGLE, PERCENT)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; equal texts all go or all stay, with or without an id; empty ones stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows the text and is null for a null one."""
    redacted = pii.redact_pii(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids (packed little-endian uint32), n_tokens, and whether they decode to the text; none is left out."""
    return bpe.with_tokens(docs, *fresh(docs, "token_ids", "n_tokens", "restored"))


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontam", decontam_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
#: No stage's method is one that SQL expresses; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
