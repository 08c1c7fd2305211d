"""Operator 9: token counts by a map-side look-up in two tiers.

The first tier is a compact table, broadcast to all tasks, of the token lengths
of frequent pre-tokens; the second is each worker's cache, which encodes what it
has not met. No pre-token of the corpus is shuffled. The table only saves time:
whatever it holds, every count is exact, so it is drawn from a bounded sample of
``sample_rows`` documents and holds at most ``table_size`` pre-tokens.

Defined results: a null text is an empty one with no tokens; strings of special
tokens inside texts count as one; repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.bpe import CACHE_CHARS, ByteBpe, shared_vocabulary, vocabulary_path
from noticelake.llm.common import bounded_batches, whole_text

SAMPLE_ROWS, TABLE_SIZE, TOKEN_LIMIT = 4_000, 16_384, 512

#: The coder of the table that a worker met last.
_coders: dict[str, ByteBpe] = {}


@lru_cache(maxsize=2)
def _plain(source: str) -> ByteBpe:
    return ByteBpe(source)


def frequent_lengths(docs: DataFrame, source, sample_rows: int, table_size: int, text_col: str) -> dict[str, int]:
    """Token lengths of the pre-tokens that are frequent in a bounded sample.

    The sample is of rows on average, drawn with a fixed seed over all partitions.
    """
    rows = docs.count()  # answered from Parquet footers
    if not rows:
        return {}
    sample = docs.select(whole_text(text_col).alias("text")).sample(min(1.0, sample_rows / rows), seed=9)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, seen = _plain(source.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                for part, special in coder.parts(text):
                    if not special:
                        seen.update(p for p in coder.pre_tokens(part) if len(p) <= CACHE_CHARS)
            if len(seen) > 8 * table_size:
                seen = Counter(dict(seen.most_common(2 * table_size)))
        top = seen.most_common(table_size)
        if top:
            yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top], "length": [len(coder.encode_piece(p)) for p, _ in top]})

    partial = sample.mapInPandas(counted, "piece string, n long, length int")
    # What the sample holds once is not frequent, and need not go to the driver.
    best = partial.groupBy("piece", "length").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "piece").limit(table_size)
    return {r["piece"]: r["length"] for r in best.collect()}


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    limit: int = TOKEN_LIMIT,
    sample_rows: int = SAMPLE_ROWS,
    table_size: int = TABLE_SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and over_limit."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = shared_vocabulary(spark, path or vocabulary_path())
    lengths = spark.sparkContext.broadcast(frequent_lengths(docs, source, sample_rows, table_size, text_col))

    key = uuid4().hex

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        coder = _coders.get(key)
        if coder is None:
            _coders.clear()
            coder = _coders[key] = ByteBpe(source.value, lengths.value)
        return pd.Series([coder.count(t) for t in texts], dtype="int64")

    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
