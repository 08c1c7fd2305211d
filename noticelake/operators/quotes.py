"""All places of many quotes in many texts, in one pass over the texts.

The quotes become tables of hashed heads, which a task builds once from the broadcast list; a
text's windows are then looked up in them, whatever the number of quotes, and every place of
every quote comes out, overlapping ones too. What is broadcast is bounded: quotes beyond
BLOCK_CHARS characters are dealt by hash into blocks, and each block takes a pass.

Defined results: null and empty quotes are nowhere, null texts hold nothing; quotes of equal
text are found at the same places, each under its own id; repeated rows of texts are texts of
their own; places count code points; empty tables give empty results; other columns of the
texts are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import code_points

#: Characters of the quotes that one pass looks for.
BLOCK_CHARS = 4_000_000
#: Starts of windows that are hashed at a time, so that a long text takes no array of its length.
PIECE = 250_000
#: Odd factors by which halves of a window are told apart.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: How far a place may be from an annotated start.
NEAR = 50


class Windows:
    """Places of different, not empty words by hashes of windows.

    A word is kept under its head, whose size is the greatest power of two that fits. The hashes of all windows of one
    size come from those of half the size by one array operation, so a text costs a few of these for a size, whatever
    the number of words; where a window's hash is that of a head, the words of that head are compared with the text.
    """

    def __init__(self, words: list[str]):
        self.longest = max(map(len, words), default=0)
        self.of: dict[int, dict[int, dict[int, dict[str, int]]]] = {}
        for number, word in enumerate(words):
            size = 1 << (len(word).bit_length() - 1)
            *_, (_, head) = self.hashes(word[:size], size)
            self.of.setdefault(size, {}).setdefault(int(head[0]), {}).setdefault(len(word), {})[word] = number
        self.heads = {size: np.array(sorted(heads), np.uint64) for size, heads in self.of.items()}

    @staticmethod
    def hashes(text: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(size, hash of the window that starts at each place) for the powers of two up to ``most``."""
        size, now = 1, code_points(text).astype(np.uint64)
        while size <= most and len(now):
            yield size, now
            now = now[: max(len(now) - size, 0)] * np.uint64(FACTORS[size.bit_length() % len(FACTORS)]) + now[size:]
            now ^= now >> np.uint64(29)
            size *= 2

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(number of a word, start) of every place, piece by piece."""
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE + self.longest - 1]
            for size, now in self.hashes(part, max(self.heads, default=0)):
                if size not in self.heads:
                    continue
                heads, of = self.heads[size], self.of[size]
                now = now[:PIECE]
                near = np.minimum(np.searchsorted(heads, now), len(heads) - 1)
                for i in np.flatnonzero(heads[near] == now).tolist():
                    for n, words in of[int(now[i])].items():
                        number = words.get(part[i : i + n])
                        if number is not None:
                            yield number, at + i


def _block(texts: DataFrame, key: str, text: str, rows: list, ids: str) -> DataFrame:
    of_word: dict[str, list] = defaultdict(list)
    for r in rows:
        of_word[r["quote"]].append(r[0])
    shared = texts.sparkSession.sparkContext.broadcast(dict(of_word))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = list(shared.value)
        windows, owners = Windows(words), [shared.value[w] for w in words]
        for batch in batches:
            for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                found = [(i, q, at) for w, at in windows.places(t) for q in owners[w]]
                if found:
                    yield pd.DataFrame(found, columns=[key, ids, "start"])

    kinds = f"{key} {texts.schema[key].dataType.simpleString()}, {ids} long, start int"
    return texts.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInPandas(hits, kinds)


def all_places(texts: DataFrame, quotes: DataFrame, key: str = "doc_id", text: str = "text", quote_id: str = "quote_id", quote: str = "quote") -> DataFrame:
    """(key, quote_id, start): every place of every quote in every text."""
    rows = quotes.select(F.col(quote_id).cast("long").alias(quote_id), F.col(quote).alias("quote")).filter(f"{quote_id} is not null and length(quote) > 0").distinct()
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("quote"))).first()[0] or 0) / BLOCK_CHARS))
    parts = [rows.filter(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == i).collect() for i in range(blocks)]
    return reduce(DataFrame.unionByName, [_block(texts, key, text, part, quote_id) for part in parts])


def near_annotations(places: DataFrame, annotated: DataFrame, keys: list[str], within: int = NEAR) -> DataFrame:
    """``places`` with near: whether an annotated start of the same keys is at most ``within`` characters away.

    Starts are met in bins as wide as that, so a place sees those of three bins and not all of its text. Different
    starts of three bins are few, so they come to a place as one list, and places are made and joined once.
    """
    wide = lambda c: F.floor(F.col(c) / (within + 1))
    marks = annotated.filter("start is not null").select(*keys, F.col("start").alias("mark"))
    marks = marks.select(*keys, "mark", F.explode(F.array(*(wide("mark") + i for i in (-1, 0, 1)))).alias("_bin"))
    binned = marks.groupBy(*keys, "_bin").agg(F.collect_set("mark").alias("_marks"))
    near = F.exists("_marks", lambda m: F.abs(F.col("start") - m) <= within)
    found = places.withColumn("_bin", wide("start")).join(binned, [*keys, "_bin"], "left")
    return found.select(*(F.col(c) for c in places.columns), F.coalesce(near, F.lit(False)).alias("near"))
