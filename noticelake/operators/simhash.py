"""SimHash of texts, and similarity joins within a Hamming radius by bands.

Tokens are two-character grams without white space, counted; a token's hash is the
first eight bytes of its MD5. A bit of the fingerprint is set where the counted votes
are positive. Two fingerprints at a distance of at most 3 agree in at least three of six
blocks, so an equi join on the 20 choices of three blocks, of 32 bits on average, finds
every pair, and hardly any other, however many fingerprints there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.functions.text import bigrams, code_points, held

BITS, BLOCKS, RADIUS = 64, 6, 3


@lru_cache(maxsize=200_000)
def token_hash(first: int, second: int = -1) -> int:
    """Hash of the token of these code points."""
    token = chr(first) + (chr(second) if second >= 0 else "")
    return int.from_bytes(md5(token.encode()).digest()[:8], "big")


def simhash_of(text: str) -> int:
    """Signed 64-bit fingerprint; 0 for a text without tokens."""
    points = code_points("".join(text.split())).astype(np.uint64)
    if not len(points):
        return 0
    if len(points) == 1:
        hashes, counts = [token_hash(int(points[0]))], np.ones(1, dtype=np.int64)
    else:
        grams, counts = np.unique(points[:-1] << np.uint64(32) | points[1:], return_counts=True)
        hashes = list(map(token_hash, (grams >> np.uint64(32)).tolist(), (grams & np.uint64(0xFFFFFFFF)).tolist()))
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
    votes = 2 * (counts @ bits) - counts.sum()
    return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little", signed=True)


def simhash_column() -> object:
    """Arrow function of a text column; null counts as empty."""

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in held(batches):
            yield pa.array([simhash_of(t or "") for t in texts], pa.int64())

    return run


def simhash_native(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, simhash) in Spark functions: grams are counted per document before any bit is summed."""
    dense = docs.select(id_col, F.regexp_replace(F.coalesce(text_col, F.lit("")), "[\\s\\u3000]+", "").alias("dense"))
    grams = dense.select(id_col, F.explode_outer(bigrams(F.col("dense"))).alias("gram")).groupBy(id_col, "gram").agg(F.count("gram").alias("n"))
    hashed = grams.withColumn("h", F.conv(F.substring(F.md5("gram"), 1, 16), 16, -10).cast("long"))
    votes = hashed.groupBy(id_col).agg(
        *(F.sum(F.when(F.getbit("h", F.lit(i)) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"b{i}") for i in range(BITS))
    )
    value = F.lit(0).cast("long")
    for i in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < BITS - 1 else -(1 << i))).otherwise(F.lit(0)).cast("long"))
    return votes.select(id_col, value.alias("simhash"))


#: Borders of the blocks, and the choices of blocks that a pair within the radius shares one of.
EDGES = tuple(BITS * i // BLOCKS for i in range(BLOCKS + 1))
CHOICES = tuple(combinations(range(BLOCKS), BLOCKS - RADIUS))


def _mask(choice: tuple[int, ...]) -> int:
    bits = sum(1 << i for k in choice for i in range(EDGES[k], EDGES[k + 1]))
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def bands(column: str) -> F.Column:
    """(band, value) of each choice of blocks: the fingerprint with the other blocks set to zero."""
    return F.array(*(F.struct(F.lit(b).alias("band"), F.col(column).bitwiseAND(F.lit(_mask(c))).alias("value")) for b, c in enumerate(CHOICES)))


def first_band(apart: F.Column) -> F.Column:
    """The first choice of blocks in which two fingerprints, given by their difference, agree."""
    return F.coalesce(*(F.when(apart.bitwiseAND(F.lit(_mask(c))) == 0, F.lit(b)) for b, c in enumerate(CHOICES)))


def near_prints(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(x, y) of all different fingerprints of two tables (simhash) within the radius, each pair once; 0 pairs with nothing.

    Neither side is broadcast: each has twenty rows a fingerprint, which the size of a file does not tell.
    """
    if radius > RADIUS:
        raise ValueError("the blocks guarantee a radius of 3")
    of = lambda df: df.filter("simhash <> 0").select("simhash").distinct().select("simhash", F.explode(bands("simhash")).alias("k"))
    x, y = of(left).withColumnRenamed("simhash", "x"), of(right).withColumnRenamed("simhash", "y")
    apart = F.col("x").bitwiseXOR(F.col("y"))
    return x.join(y.hint("merge"), "k").filter((F.bit_count(apart) <= radius) & (F.col("k.band") == first_band(apart))).select("x", "y")


def near_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of all pairs from (id, simhash) tables within the radius; fingerprint 0 pairs with nothing.

    Equal fingerprints are joined once and only then expanded to their rows.
    """
    close = near_prints(left, right, radius)
    return (
        left.select(F.col("id").alias("a"), F.col("simhash").alias("x"))
        .join(close, "x")
        .join(right.select(F.col("id").alias("b"), F.col("simhash").alias("y")), "y")
        .select("a", "b", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("distance"))
    )


#: Rows of one fingerprint that stand in a list, on average.
LIST = 64


def near_lists(rows: DataFrame, item: F.Column, radius: int = RADIUS) -> DataFrame:
    """(l, r, same, distance): lists of the items of rows (id, simhash) within the radius, each two lists once; 0 pairs with nothing.

    Rows of a fingerprint are dealt to lists by their id, so that the pairs of a large group come from many keys and what
    is shuffled for them grows with its lists, not with its pairs. Of two lists the one of the smaller group is moved to
    the other. ``same`` marks a list that meets itself.
    """
    if radius > RADIUS:
        raise ValueError("the blocks guarantee a radius of 3")
    held = rows.filter("simhash <> 0")
    sizes = held.groupBy("simhash").agg(F.count("*").alias("n"))
    parts = lambda n: F.ceil(F.col(n) / LIST).cast("int")
    dealt = held.join(sizes, "simhash").select("simhash", F.when(F.col("n") > LIST, F.pmod(F.xxhash64("id"), parts("n"))).otherwise(0).cast("int").alias("part"), item.alias("item"))
    lists = dealt.groupBy("simhash", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    of = lambda x, n: sizes.select(F.col("simhash").alias(x), F.col("n").alias(n), F.explode(bands("simhash")).alias("k"))
    apart = F.col("x").bitwiseXOR(F.col("y"))
    once = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("x") <= F.col("y")))
    near = of("x", "m").join(of("y", "n").hint("merge"), "k").filter(once & (F.bit_count(apart) <= radius) & (F.col("k.band") == first_band(apart)))
    last = lambda n: parts(n) - 1
    left = lists.select(F.col("simhash").alias("x"), F.col("part").alias("i"), F.col("items").alias("l"))
    right = lists.select(F.col("simhash").alias("y"), F.col("part").alias("j"), F.col("items").alias("r"))
    moved = near.select("x", "y", "n", F.explode_outer(F.sequence(F.lit(0), last("m"))).alias("i")).join(left.hint("shuffle_hash"), ["x", "i"])
    first = F.when(F.col("x") == F.col("y"), F.col("i")).otherwise(0)
    met = moved.select("x", "y", "i", "l", F.explode_outer(F.sequence(first, last("n"))).alias("j")).join(right.hint("shuffle_hash"), ["y", "j"])
    same = (F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))
    return met.select("l", "r", same.alias("same"), F.bit_count(apart).alias("distance"))


def near_rows(rows: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of rows (id, simhash) within the radius, each once and the lesser id first; rows of one id are no pair."""
    met = near_lists(rows, F.col("id"))
    pairs = met.select("same", "distance", "r", F.explode("l").alias("a")).select("same", "distance", "a", F.explode("r").alias("b"))
    a, b = F.col("a"), F.col("b")
    return pairs.filter((a < b) | ((a > b) & ~F.col("same"))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "distance")


def first_match(new: DataFrame, existing: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each new row the earliest existing row within the radius; fingerprints are matched, not rows."""
    first = existing.filter("simhash <> 0").groupBy(F.col("simhash").alias("y")).agg(F.min("id").alias("match"))
    close = near_prints(new, first.select(F.col("y").alias("simhash")), radius).join(first, "y")
    best = close.groupBy("x").agg(F.min(F.struct("match", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("distance"))).alias("m"))
    return new.join(best, F.col("simhash") == F.col("x")).select("id", "m.match", "m.distance")


def ingest_verdict(new: DataFrame, known: DataFrame, within_batch: bool = True) -> DataFrame:
    """(id, verdict) of new rows (id, url, simhash): duplicate_url, duplicate_simhash or inserted.

    With ``within_batch`` the first row of a batch with an address counts as known to the later ones.
    """
    verdict = new.join(known.select("url").distinct().withColumn("seen", F.lit(True)), "url", "left")
    if within_batch:
        first = F.row_number().over(Window.partitionBy("url").orderBy("id"))
        verdict = verdict.withColumn("seen", F.coalesce("seen", (first > 1) & F.col("url").isNotNull()))
    near = first_match(new.select("id", "simhash"), known.select("id", "simhash")).select("id", F.lit(True).alias("near"))
    kind = F.when(F.col("seen"), "duplicate_url").when(F.col("near"), "duplicate_simhash").otherwise("inserted")
    return verdict.join(near, "id", "left").select("id", kind.alias("verdict"))


def keep_first(rows: DataFrame) -> DataFrame:
    """(id, kept) in order of id: a row is dropped if an earlier kept row is within the radius.

    Not a transitive closure. Equal fingerprints keep their first row; the rest is settled in rounds: a
    fingerprint stays once all earlier neighbours are dropped, and is dropped once an earlier neighbour stays.
    Each round settles at least the first open fingerprint of every component, so the rounds end when none is open.
    """
    from noticelake.sources.scratch import stored

    once = rows.filter("simhash <> 0").groupBy("simhash").agg(F.min("id").alias("id"))
    edges = stored(near_pairs(once, once).filter("a > b").select(F.col("a").alias("id"), F.col("b").alias("earlier")))
    state = stored(once.select("id").join(edges.select("id").distinct().withColumn("open", F.lit(True)), "id", "left").select("id", F.when(F.col("open"), F.lit(None)).otherwise(F.lit(True)).cast("boolean").alias("kept")))
    while not state.filter("kept is null").isEmpty():
        of = edges.join(state.select(F.col("id").alias("earlier"), F.col("kept").alias("e")), "earlier")
        seen = of.groupBy("id").agg(F.bool_or(F.coalesce("e", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("e"), F.lit(False))).alias("free"))
        next_ = F.when(F.col("hit"), F.lit(False)).when(F.col("free"), F.lit(True))
        state = stored(state.join(seen, "id", "left").select("id", F.coalesce("kept", next_).alias("kept")))
    chosen = state.filter("kept").select("id").withColumn("first", F.lit(True))
    return rows.join(chosen, "id", "left").select("id", (F.coalesce("first", F.lit(False)) | (F.col("simhash") == 0)).alias("kept"))
