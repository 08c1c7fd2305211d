"""Operator 6: benchmark passages in documents, in Spark functions only.

Every document is cut into windows as long as a benchmark item, at every place; what is
a window of an item's size is fixed by the item alone, in shingles of ``SIZE`` words.
Windows and items get 64-bit SimHash fingerprints of their shingles, and a multi-index
over the items finds, for each window, all items of its size whose fingerprint is within
``RADIUS``: fingerprints are cut into ``BLOCKS`` blocks, of which two within the radius
have one that differs in at most ``PROBE`` bits, and the index holds every block of every
item with all its values at that distance. Neither an item's id nor a shared shingle is a
key of that search. What it finds is confirmed by the weighted Jaccard similarity of the
shingle counts, at least ``PERCENT``.

Windows that can reach the similarity with no item are left out before they get a
fingerprint, without loss. The similarity needs K = PERCENT / (100 + PERCENT) * (window +
item) common shingles, so a window needs K places whose shingle is one of any item of that
size, in whatever order. Moving a window to its first such place loses nothing, so windows
that begin there stand for all; at a document's begin, where windows are cut off, those
that end at such a place do. The look-up of shingles is broadcast while the items have no
more than ``BROADCAST_ROWS``, and shuffled beyond that; the same holds for the index and
for the keys of the texts whose windows are cut out.

The radius is the method's own bound: of two windows at the similarity of 0.8, 9.7 of 64
bits differ on average with a deviation of 2.9, so that it leaves out 1 in 10,000 of the
pairs that are no better than the bar, and fewer of the others.

Words are runs of letters and digits in lower case. An item of fewer than five words
has itself as its only shingle. Equal texts are compared once.

Defined results: null or empty texts and items have no words and match nothing;
repeated rows of documents give repeated rows of pairs, repeated items count once;
an item is its id and its words, so that an id with several texts is searched by all
of them and reported once a document with its best window, the first of equal ones, and
an item without an id is searched too and reported with a null one; rows without a doc_id
are reported with a null one; a window over the edge of a document is cut off there; other
columns pass through the filter untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import fresh, whole_text
from noticelake.llm.scratch import stored

SIZE, PERCENT = 5, 80
BITS, RADIUS, BLOCKS, PROBE = 64, 20, 7, 2
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def grams(listed: Column, size: int) -> Column:
    """Hashes of the shingles of ``size`` words at each place of an array of words."""
    last = F.size(listed) - (size - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.element_at(listed, i + F.lit(k)) for k in range(size))))


def fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is set if more than half of the hashes have it."""

    def bit(i: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, F.lit(i)).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.lit(1 << i if i < BITS - 1 else -(1 << i))).otherwise(F.lit(0))

    total = bit(0).cast("long")
    for i in range(1, BITS):
        total = total.bitwiseOR(bit(i).cast("long"))
    return total


#: Borders of the blocks.
EDGES = tuple(BITS * i // BLOCKS for i in range(BLOCKS + 1))


def block(print_: Column, k: int) -> Column:
    """The value of a block of a fingerprint."""
    return F.shiftrightunsigned(print_, EDGES[k]).bitwiseAND(F.lit((1 << (EDGES[k + 1] - EDGES[k])) - 1)).cast("long")


def blocks(print_: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    return F.array(*(F.struct(F.lit(k).alias("block"), block(print_, k).alias("value")) for k in range(BLOCKS)))


def probes(print_: Column) -> Column:
    """(block, value) of all values that differ from a block of a fingerprint in at most PROBE bits."""
    masks = lambda k: [m for m in range(1 << (EDGES[k + 1] - EDGES[k])) if m.bit_count() <= PROBE]
    near = lambda k: F.transform(
        F.lit(masks(k)), lambda m: F.struct(F.lit(k).alias("block"), block(print_, k).bitwiseXOR(m.cast("long")).alias("value"))
    )
    return F.flatten(F.array(*(near(k) for k in range(BLOCKS))))


def first_block(x: Column, y: Column) -> Column:
    """The first block in which two fingerprints differ in at most PROBE bits."""
    apart = x.bitwiseXOR(y)
    return F.coalesce(*(F.when(F.bit_count(block(apart, k)) <= PROBE, F.lit(k)) for k in range(BLOCKS)))


def numbered(df: DataFrame, grams_col: str, out: str) -> DataFrame:
    """``df`` with an array that holds each shingle once for each of its places, told apart by number.

    The common elements of two such arrays are the lesser counts of all shingles.
    """
    runs, sorted_ = fresh(df, "runs", "sorted")
    df = df.withColumn(sorted_, F.sort_array(grams_col))
    at = lambda i: F.element_at(sorted_, i)
    begins = F.filter(F.sequence(F.lit(1), F.size(sorted_)), lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))
    df = df.withColumn(runs, F.when(F.size(sorted_) > 0, begins).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice(runs, 2, F.greatest(F.lit(0), F.size(runs))), F.array(F.size(sorted_) + 1))
    each = F.zip_with(runs, F.when(F.size(runs) > 0, ends).otherwise(F.array().cast("array<int>")), lambda b, e: F.transform(F.sequence(F.lit(1), e - b), lambda k: F.xxhash64(at(b), k)))
    return df.withColumn(out, F.flatten(each)).drop(runs, sorted_)


def possible_windows(places: Column, n: Column, m: Column) -> Column:
    """(start, length) of the windows of an item's ``m`` shingles, of the ``n`` of a text, that can reach the similarity.

    ``places`` are the places, in order and from 0, of shingles that items of that size hold.
    """
    need = lambda w: F.ceil((w + m) * PERCENT / (100 + PERCENT)).cast("int")
    window = lambda start, length, able: F.struct(start.alias("start"), length.alias("length"), F.coalesce(able, F.lit(False)).alias("able"))
    ahead = F.transform(places, lambda p, i: window(p, F.least(m, n - p), F.get(places, i + need(F.least(m, n - p)) - 1) < p + F.least(m, n - p)))
    cut = F.transform(places, lambda p, i: window(F.lit(0), p + 1, (p + 1 < F.least(m, n)) & (i + 1 >= need(p + 1))))
    return F.filter(F.concat(ahead, cut), lambda w: w["able"])


def _item_key(item_id: Column, listed: Column) -> Column:
    """Key of an id, null or not, and words (which hold no blanks)."""
    return F.sha2(F.concat(F.when(item_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.hex(item_id.cast("string")))), F.lit(" "), F.array_join(listed, " ")), 256)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, size, item_grams) of all items that have words; ``item`` is a key of the id and the words."""
    listed = benchmark.select(F.col(item_col).alias("item_id"), plain_words(whole_text(text_col)).alias("words"))
    listed = listed.filter(F.size("words") > 0).withColumn("item", _item_key(F.col("item_id"), F.col("words")))
    size = F.least(F.size("words"), F.lit(SIZE)).alias("size")
    own = grams(F.col("words"), SIZE)
    for k in range(SIZE - 1, 0, -1):
        own = F.when(F.size("words") == k, grams(F.col("words"), k)).otherwise(own)
    return stored(listed.select("item", "item_id", size, own.alias("item_grams")).dropDuplicates(["item"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(content, item_id, start, similarity): the best window of each matching text and item.

    ``content`` is the md5 of the whole text, ``start`` the window's first word.
    """
    text = whole_text(text_col)
    items = _items(benchmark, item_col, "text")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # five values at most
    known = stored(items.select("size", F.size("item_grams").alias("m"), F.explode("item_grams").alias("gram")).distinct())
    bounded = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    known = bounded(known, known.count())
    hashed = docs.select(F.md5(text).alias("content"), F.xxhash64(text).alias("key"), text.alias("text"))
    whole = hashed.select("content", "key", plain_words(F.col("text")).alias("words"))
    listed = whole.select("content", "key", F.array(*(F.struct(F.lit(k).alias("size"), grams(F.col("words"), k).alias("g")) for k in sizes)).alias("all"))
    if len(sizes) == 1:  # the usual case, without an array of arrays
        listed = whole.select("content", "key", F.lit(sizes[0]).alias("size"), grams(F.col("words"), sizes[0]).alias("g"))
    elif sizes:
        listed = listed.select("content", "key", F.explode_outer("all").alias("one")).select("content", "key", "one.size", "one.g")
    else:
        listed = whole.select("content", "key", F.lit(SIZE).alias("size"), grams(F.col("words"), SIZE).alias("g"))
    # The outer form: for the inner one Spark adds a filter on the array's size and computes the array anew for it.
    placed = listed.select("content", "key", "size", F.size("g").alias("n"), F.posexplode_outer("g").alias("pos", "gram"))
    # Equal texts have equal places, which each task gathers once.
    hits = placed.join(known, ["size", "gram"]).groupBy("content", "size", "m").agg(
        F.min("key").alias("key"), F.min("n").alias("n"), F.sort_array(F.collect_set("pos")).alias("places")
    )
    windows = hits.select("content", "key", "size", "m", F.explode(possible_windows(F.col("places"), F.col("n"), F.col("m"))).alias("w"))
    windows = stored(windows.select("content", "key", "size", "m", "w.start", "w.length"))
    keys = windows.select("key").distinct()
    keys = bounded(keys, keys.count())  # within the bound only the texts in question are shuffled
    texts = hashed.join(keys, "key", "left_semi").dropDuplicates(["content"]).select("content", plain_words(F.col("text")).alias("words"))
    own = grams(F.col("words"), SIZE)
    for k in range(SIZE - 1, 0, -1):
        own = F.when(F.col("size") == k, grams(F.col("words"), k)).otherwise(own)
    by_size = texts.join(windows.select("content", "size").distinct(), "content").select("content", "size", own.alias("g"))
    cut = windows.join(by_size, ["content", "size"]).select("content", "size", "m", "start", "length", F.slice("g", F.col("start") + 1, F.col("length")).alias("grams"))
    cut = stored(numbered(cut.withColumn("print", fingerprint(F.col("grams"))), "grams", "window_grams").drop("grams"))
    items = stored(numbered(items.withColumn("print", fingerprint(F.col("item_grams"))), "item_grams", "numbered").select("item", "item_id", "size", F.size("numbered").alias("m"), F.col("numbered").alias("item_grams"), F.col("print").alias("item_print")))

    index = stored(items.select("item", "size", "m", "item_print", F.explode(probes(F.col("item_print"))).alias("b")))
    n_index = index.count()
    blocked = cut.select("content", "size", "m", "start", "length", "print", F.explode(blocks(F.col("print"))).alias("b"))
    found = blocked.join(bounded(index, n_index), ["size", "m", "b"])
    near = found.filter((F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS) & (F.col("b.block") == first_block(F.col("print"), F.col("item_print"))))
    pairs = near.select("content", "item", "size", "m", "start", "length").join(cut.drop("print"), ["content", "size", "m", "start", "length"])
    pairs = pairs.join(bounded(items.select("item", "item_id", "item_grams"), n_index), "item")
    shared = F.size(F.array_intersect("window_grams", "item_grams"))
    pairs = pairs.select("content", "item_id", "start", shared.alias("shared"), (F.size("window_grams") + F.size("item_grams")).alias("both"))
    similarity = F.col("shared") / (F.col("both") - F.col("shared"))
    confirmed = pairs.filter(100 * F.col("shared") >= PERCENT * (F.col("both") - F.col("shared"))).withColumn("similarity", similarity)
    best = confirmed.groupBy("content", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("place"))).alias("top"))
    return stored(
        best.select("content", "item_id", (-F.col("top.place")).alias("start"), F.col("top.similarity").alias("similarity"))
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents and items: doc_id, item_id, start (word) and similarity."""
    found = contaminated(docs, benchmark, text_col)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.md5(whole_text(text_col)).alias("content"))
    return ids.join(found, "content").select("doc_id", "item_id", "start", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose text holds no benchmark passage."""
    (name,) = fresh(docs, "content")
    found = contaminated(docs, benchmark, text_col).select(F.col("content").alias(name)).distinct()
    if found.count() <= BROADCAST_ROWS:  # then no text is shuffled
        found = F.broadcast(found)
    return docs.withColumn(name, F.md5(whole_text(text_col))).join(found, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
