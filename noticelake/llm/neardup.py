"""Operator 10: near-duplicate documents by SuperMinHash, banding, checks and union-find.

Each document becomes the set of its distinct word shingles. Documents of equal sets,
told by a 128-bit digest of the sets' hashes, form a class; classes get SuperMinHash signatures (one permutation per element, cut
short as soon as no later rank can lower a minimum), whose bands go into buckets.
No bucket is ever expanded into all its pairs:

1. Each class of a bucket is compared with the bucket's most central class, the one
   that shares most buckets with others. Links are confirmed on whole sets.
2. Confirmed links give components. Where a bucket still holds several, the classes
   outside its largest one are compared with all classes of such buckets that can
   reach the threshold at all: a link between sets of sizes x and y needs an overlap
   of t/(100+t)*(x+y), so two sets whose rarest shingles, up to what that overlap
   leaves over, have none in common cannot be linked (the prefix bound). This step is
   exact and has no cap; hot groups of copies leave few candidates in it.

The bands are chosen so that a pair at the threshold shares no bucket with a
probability below one in a million.

Defined results: a null text is an empty one; a document without words has an empty
set, is linked with nothing and is its own component; with fewer words than a shingle
the whole sequence is the one shingle; rows without an id are linked with nothing and
have a null component; repeated rows are repeated in the result; where an id comes with
several texts each of them is linked by its own set, and the row has the component of its
text; of texts with equal sets the one of the least id, then of the least hash, stands for
all; empty tables give empty results; long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import bounded_batches, fresh, whole_text
from noticelake.llm.components import components
from noticelake.llm.scratch import stored

SIZE, PERCENT = 3, 85
#: Signature length; rows of a band by the least percentage that they suit.
SLOTS = 128
ROWS = ((85, 5), (70, 4), (50, 3), (0, 2))
#: Words that one step of the sketches holds, members that share a copy of a leader's text, classes of sizes per unit of ln(size).
STEP_WORDS, SHARE, SIZE_STEPS = 80_000, 64, 50
#: Parts that the pairs of a leader with more than SHARE of them are dealt into.
SALTS = 32
#: Ids that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FRACTION = 25
_EMPTY = np.uint32(0xFFFFFFFF)


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case; only the six ASCII blanks part words."""
    return text.encode().lower().split()


def shingle_set(text: str, size: int) -> frozenset:
    """The distinct shingles of a text; the whole sequence where there are fewer words."""
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words, made when missing, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingle_hashes(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of several texts, sorted within each text, and the index of their text."""
    counts = np.array([len(w) for w in texts], dtype=np.int64)
    flat = np.fromiter((_hashes[x] for w in texts for x in w), dtype=np.uint64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(flat))  # words from here to the end of the text
    if not len(flat):
        return flat, doc
    starts_short = (np.arange(len(flat)) == (ends - counts)[doc]) & (counts[doc] < size)
    value = np.zeros(len(flat), dtype=np.uint64)
    for i in range(size):
        there = left > i
        part = np.where(there, np.roll(flat, -i), np.uint64(0x5BD1E995 + i))
        value = mixed(value * _GOLDEN + part + np.uint64(i + 1))
    used = (left >= size) | starts_short
    value, doc = value[used], doc[used]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def super_minhash(hashes: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures: slot p[j] of an element gets rank j plus a fraction, the least of all wins.

    Ranks are dealt level by level; a document whose slots all hold a rank below the
    next level is done, which for most documents is after one or two levels.
    """
    least = np.full(n_docs * slots, _EMPTY, dtype=np.uint32)
    order = None
    for level in range(slots):
        if not len(hashes):
            break
        draw = mixed(hashes + np.uint64((level + 1) * int(_GOLDEN) % 2**64))
        pick = (level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32))).astype(np.int64)
        if level == 0:
            target, first = pick, pick
        else:
            if order is None:  # the permutation after its first swap
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(hashes), 1))
                rows = np.arange(len(hashes))
                order[rows, first] = 0
                order[:, 0] = first
            rows = np.arange(len(hashes))
            target = order[rows, pick]
            order[rows, pick] = order[:, level]
            order[:, level] = target
        rank = (np.uint32(level) << np.uint32(_FRACTION)) | (draw >> np.uint64(64 - _FRACTION)).astype(np.uint32)
        np.minimum.at(least, doc * slots + target, rank)
        open_ = (least.reshape(n_docs, slots).max(axis=1) >> np.uint32(_FRACTION)) > level
        keep = open_[doc]
        if level == 0:
            first = first[keep]
        else:
            order = order[keep]
        hashes, doc = hashes[keep], doc[keep]
    return least.reshape(n_docs, slots)


def band_rows(percent: int) -> int:
    return next(rows for least, rows in ROWS if percent >= least)


def sketch(texts: list[str], size: int, rows: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Per text: the number of shingles, the two halves of the set's hash, and the keys of its bands."""
    tokens = [words_of(t) for t in texts]
    values, doc = shingle_hashes(tokens, size)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    signatures = super_minhash(values, doc, len(texts))
    bands = SLOTS // rows
    parts = signatures[:, : bands * rows].reshape(len(texts), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(texts), bands)).copy()
    for i in range(rows):
        keys = mixed(keys * _GOLDEN + parts[:, :, i] + np.uint64(i + 1))
    keys = keys.view(np.int64)
    for i in range(len(texts)):
        own = values[bounds[i] : bounds[i + 1]]
        if len(own):
            digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
            yield len(own), int(digest[0]), int(digest[1]), keys[i]
        else:
            yield 0, 0, 0, keys[i, :0]


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold a bounded number of characters, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > 6 * STEP_WORDS:
            yield start, i
            start, total = i, 0
        total += len(t)
    if texts:
        yield start, len(texts)


def sketches(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, s1, s2, bands) of (doc_id, text_key, text)."""
    rows = band_rows(percent)
    schema = T.StructType([texts.schema["doc_id"], texts.schema["text_key"]])
    for name, kind in (("n", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()), ("bands", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, whole = batch["doc_id"], batch["text_key"], batch["text"].tolist()
            for a, b in _steps(whole):
                done = pd.DataFrame(sketch(whole[a:b], size, rows), columns=["n", "s1", "s2", "bands"])
                done.insert(0, "doc_id", ids.iloc[a:b].to_numpy())
                done.insert(1, "text_key", keys.iloc[a:b].to_numpy())
                yield done

    return texts.mapInPandas(made, schema)


@lru_cache(maxsize=8)
def _cached_set(text: str, size: int) -> frozenset:
    return shingle_set(text, size)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold.

    ``a`` may be in many pairs: copies of its text are shared by up to SHARE of them,
    so that no task gets all pairs of one leader.
    """

    @F.pandas_udf(T.BooleanType())
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = _cached_set(x, size), shingle_set(y, size)
            small, large = sorted((len(x), len(y)))
            if 100 * small < percent * large:
                out.append(False)
                continue
            shared = len(x & y)
            out.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies"))
    texts = texts.hint("merge")  # the same plan at every size
    own = lambda side: (F.col(f"{side}.id") == F.col("doc_id")) & (F.col(f"{side}.set") == F.col("text_key"))
    leaders = (
        copies.join(texts.withColumnRenamed("text", "a_text"), own("a"))
        .select("a", "a_text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    )
    # Only leaders with several copies have a row here, one for each part of their pairs, so that no task reads all of them.
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    hot = copies.filter("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
    dealt = pairs.select("a", "b", salt).join(hot, ["a", "salt"], "left").select("a", "b", F.coalesce("copies", F.lit(1)).alias("copies"))
    members = (
        dealt.join(texts.withColumnRenamed("text", "b_text"), own("b"))
        .select("a", "b", "b_text", F.pmod(F.xxhash64("b", F.lit(1)), F.col("copies")).cast("int").alias("copy"))
    )
    both = members.join(leaders, ["a", "copy"])
    return both.filter(linked("a_text", "b_text")).select("a", "b").distinct()


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rest(buckets: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Pairs still to compare: of classes outside the largest component of their bucket."""
    known = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = known.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed_ = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("members"), F.max(F.struct("m", "label")).alias("top"))
    mixed_ = mixed_.filter("parts > 1 and members > 2").select("key", F.col("top.label").alias("main"))
    open_ = stored(
        known.join(mixed_, "key").groupBy("node", "label", "n").agg(F.max((F.col("label") != F.col("main")).cast("int")).alias("outside"))
    )
    if open_.filter("outside = 1").isEmpty():
        return None

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes([words_of(t)], size)[0].view(np.int64) for t in batch], dtype=object)

    tokens = stored(
        open_.join(texts.hint("merge"), (F.col("node.id") == F.col("doc_id")) & (F.col("node.set") == F.col("text_key")))
        .select("node", "label", "n", "outside", hashes("text").alias("tokens"))
        .select("node", "label", "n", "outside", F.explode("tokens").alias("token"))
    )
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    listed = (
        tokens.join(common, "token")
        .groupBy("node", "label", "n", "outside")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    )
    # Shingles of one document only come first in the order; they match nothing and only take up ranks.
    alone = (F.col("n") - F.size("shared")).cast("int")
    ranked = F.posexplode(F.slice("shared", 1, F.greatest(F.lit(0), F.col("reach") - alone)))
    class_of = lambda c: F.floor(F.log(c) * SIZE_STEPS).cast("int")
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = stored(
        listed.withColumn("reach", reach)
        .select("node", "label", "n", "outside", alone.alias("alone"), ranked.alias("pos", "t"))
        .select("node", "label", "n", "outside", (F.col("alone") + F.col("pos") + 1).alias("rank"), F.col("t.token").alias("token"))
    )
    right = prefix.select(
        "token", class_of(F.col("n")).alias("size"), F.col("node").alias("y"), F.col("label").alias("y_label"), F.col("n").alias("y_n"), F.col("rank").alias("y_rank")
    )
    low, high = class_of(F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100))), class_of(F.floor(F.col("n") * 100 / percent))
    overlap = lambda x, y: F.ceil((x + y) * percent / (100 + percent) - 1e-6)
    floor_of = F.greatest(F.lit(1), F.floor(F.exp(F.col("size") / SIZE_STEPS)))
    left = (
        prefix.filter("outside = 1")
        .withColumn("size", F.explode(F.sequence(low, high)))
        .filter(F.col("rank") <= F.col("n") - overlap(F.col("n"), floor_of) + 1)
        .select("token", "size", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("rank").alias("x_rank"))
    )
    need = overlap(F.col("x_n"), F.col("y_n"))
    able = (F.col("x_rank") <= F.col("x_n") - need + 1) & (F.col("y_rank") <= F.col("y_n") - need + 1) & (need <= F.least("x_n", "y_n"))
    both = left.join(right, (left["token"] == right["token"]) & (left["size"] == right["size"]) & (F.col("x_label") != F.col("y_label")) & able)
    pairs = both.select("x", "y")
    return pairs.select(*_ordered(F.col("x"), F.col("y"))).distinct()


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n (the size of its set) and label, the least (id, text_key) that it is linked to; null without words or an id."""
    bounded_batches(docs.sparkSession)
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    drawn = stored(sketches(texts, size, percent))
    texts = texts.filter(F.col("doc_id").isNotNull())
    classes = (
        drawn.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        .groupBy("s1", "s2", "n")
        .agg(F.min(F.struct("doc_id", "text_key", "bands")).alias("first"))
        .select("s1", "s2", "n", F.struct(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("set")).alias("node"), "first.bands")
    )
    classes = stored(classes)
    rows = classes.select("node", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = stored(rows.join(sizes, "key"))
    weights = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    leaders = buckets.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    stars = buckets.join(leaders, "key").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    # Whole texts are shuffled once; what follows reads only those of documents that share a bucket.
    shared = buckets.select(F.col("node.id").alias("doc_id"), F.col("node.set").alias("text_key")).distinct().hint("merge")
    texts = stored(texts.join(shared, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]))
    links = stored(confirmed(stored(stars), texts, size, percent))
    labels = components(links)
    more = _rest(buckets, labels, texts, size, percent)
    if more is not None:
        # Both sides of these pairs may be in many of them; the one in more pairs shares its text.
        more = stored(confirmed(stored(more), texts, size, percent))
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    found = classes.join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
    linked = drawn.join(found, ["s1", "s2"], "left")
    return linked.select("doc_id", "text_key", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("label")).alias("label"))


def near_duplicates(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    component = F.coalesce("label.id", "doc_id")
    return _grouped(docs, size, percent, id_col, text_col).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, of which one of each group stays: that of the least id and, within it, the least hash of its text.

    Rows are known by id and text, so an id with several texts loses only those that stand in the groups of others.
    Of rows that repeat an id and its text the one stays whose JSON comes first; rows without an id all stay.
    """
    id_of, key_of, key = fresh(docs, "dropped_id", "dropped_key", "text_key")
    keyed = docs.withColumn(key, F.xxhash64(whole_text(text_col)))
    first = F.col("label").isNull() | ((F.col("label.id") == F.col("doc_id")) & (F.col("label.set") == F.col("text_key")))
    found = _grouped(docs, size, percent, id_col, text_col).filter("doc_id is not null").groupBy(F.col("doc_id").alias(id_of), F.col("text_key").alias(key_of))
    found = stored(found.agg(F.bool_and(first).alias("first"), F.count("*").alias("n")))
    bounded = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    same = (F.col(id_col) == F.col(id_of)) & (F.col(key) == F.col(key_of))
    kept = keyed.join(bounded(found.filter("not first").select(id_of, key_of)), same, "left_anti")
    # Repeated rows are rare in a table of documents; only these are compared.
    again = found.filter("first and n > 1").select(id_of, key_of)
    if again.isEmpty():
        return kept.drop(key)
    again = bounded(again)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.join(again, same, "left_semi").groupBy(id_col, key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(again, same, "left_anti").drop(key).unionByName(one)
