"""Operator 7: rules of quality and a hashed n-gram likelihood ratio, in Spark functions only.

Words and word pairs are hashed into slots, whose number grows with the corpus: it is
``SLOT_RATE`` times the square root of its bytes, ``MIN_SLOTS`` at least, as the number of
different n-grams grows slower than the text, so that a slot mixes about as many of them
at any size. Two multinomials over the slots, one of trusted texts and one of all raw
texts, both counted over all their rows, give each slot a log-likelihood ratio. Both are
smoothed by ``SMOOTHING`` raw n-grams a slot, the trusted one by as many as its share, so
that a slot that neither holds says nothing.

No text is measured by its own counts: an n-gram of a text counts one less in the raw
multinomial and, where the text is trusted, in the trusted one, and its length is taken
from the sums of those. Without that a text that is trusted scores higher than one as good
that is not. The score is the mean ratio over a text's n-grams. A document is kept if it
passes the base rules and its score reaches ``THRESHOLD``, a fixed value, so that verdicts
are deterministic; it was set on labelled texts of which half were not trusted.

The n-grams of a document are looked up and summed in the task that reads it: the table of
ratios, one row for each slot that occurs, is broadcast while the corpus has no more than
``BROADCAST_SLOTS`` slots, and joined by slot beyond that, after each document's n-grams
are counted.

Defined results: a null text is an empty one and fails the base rules; n-grams of a
document without words give the score 0; repeated rows give repeated results and
count repeatedly in the raw multinomial; all rows of a trusted id are trusted; where there
are no trusted texts every score is 0; empty tables give empty results; long texts are read whole; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import whole_text, words
from noticelake.llm.scratch import stored

SLOT_RATE, MIN_SLOTS, SMOOTHING, THRESHOLD = 3, 16_384, 60, -0.08
#: Slots up to which their ratios are broadcast: some 100 MB.
BROADCAST_SLOTS = 1 << 22
#: Ids of trusted texts that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: The base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3


def number_of_slots(raw: DataFrame, text_col: str = "text") -> int:
    """Slots for a corpus, by the bytes of all its texts."""
    size = raw.select(F.sum(F.octet_length(whole_text(text_col)))).first()[0] or 0
    return max(MIN_SLOTS, ceil(SLOT_RATE * sqrt(size)))


def ngram_slots(listed: Column, slots: int) -> Column:
    """Slots of the words of a text, then of its word pairs."""
    slot = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(slots))
    following = F.slice(listed, 2, F.greatest(F.lit(0), F.size(listed)))
    pairs = F.slice(F.zip_with(listed, following, lambda a, b: slot(a, b)), 1, F.greatest(F.lit(0), F.size(listed) - 1))
    return F.concat(F.transform(listed, lambda w: slot(w)), pairs)


def flagged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, own) of every row: whether its id is one of the trusted. No text is shuffled while their ids can be broadcast."""
    ids = trusted.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    small = ids.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    joined = rows.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("own"))
    return joined if small else stored(joined)


def slot_counts(rows: DataFrame, slots: int) -> DataFrame:
    """(slot, n, g) over all rows (text, own), g of those that are trusted; each task sums its own slots before the shuffle."""
    listed = rows.select("own", words(F.col("text")).alias("words"))
    # The outer form: for the inner one Spark adds a filter on the array's size and computes the array anew for it.
    found = listed.select("own", F.explode_outer(ngram_slots(F.col("words"), slots)).alias("slot"))
    return found.groupBy("slot").agg(F.count("slot").alias("n"), F.count_if("own").alias("g")).filter("slot is not null")


@dataclass(frozen=True)
class Multinomials:
    """``logs`` (slot, plain, trusted): the logarithm of the ratio of both counts for an n-gram of a text that is not trusted, and of one that is; the sums of both counts; slots."""

    logs: DataFrame
    good: int
    raw: int
    slots: int

    def score(self, total: Column, n: Column, trusted: Column) -> Column:
        """The mean ratio of ``n`` n-grams from the sum of their logarithms, without the text's own counts."""
        share = SMOOTHING * self.good / self.raw if self.raw else 0.0
        good = F.lit(self.good) - F.when(trusted, n).otherwise(0) + share * self.slots
        raw = F.lit(self.raw) - n + SMOOTHING * self.slots
        return total / n - F.log(good) + F.log(raw)


def multinomials(rows: DataFrame, slots: int) -> Multinomials:
    """Counts of all rows (text, own) and of the trusted ones among them, in one pass."""
    counts = stored(slot_counts(rows, slots))
    raw_total, good_total = (x or 0 for x in counts.agg(F.sum("n"), F.sum("g")).first())
    share = SMOOTHING * good_total / raw_total if raw_total else 0.0
    below = F.log(F.greatest(F.col("n") - 1, F.lit(0)) + F.lit(SMOOTHING))
    logs = counts.select("slot", (F.log(F.col("g") + share) - below).alias("plain"), (F.log(F.greatest(F.col("g") - 1, F.lit(0)) + share) - below).alias("trusted"))
    return Multinomials(stored(logs), good_total, raw_total, slots)


def _repeated_words(listed: Column) -> Column:
    """Number of words that stand in a window which the text holds at least twice.

    Hashes of the windows are sorted with their places; equal neighbours are repeats,
    and the places of repeats, in order, each cover up to WINDOW words not yet covered.
    """
    at = lambda i, k: F.element_at(listed, i + F.lit(k))
    last = F.size(listed) - (WINDOW - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str | None = None) -> DataFrame:
    """doc_id, a hash of the text, the array ``words`` and the base counts of every row, with one more of its columns."""
    more = [kept] if kept else []
    text = whole_text(text_col)
    inner = "[^ \\t-\\r]"
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(inner))
    docs = docs.select(F.col(id_col).alias("doc_id"), *more, text.alias("text"), words(text).alias("words"), lines.alias("lines"))
    docs = docs.select(
        "doc_id",
        *more,
        F.xxhash64("text").alias("text_key"),
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("windows"),
    )
    # Only texts with a repeated window need the places; most have none.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("sorted", F.when(some, placed)).drop("windows")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform("sorted", lambda s: s["h"]))
    after = F.concat(F.transform(F.slice("sorted", 2, F.size("sorted")), lambda s: s["h"]), F.array(F.lit(None).cast("bigint")))
    marked = F.zip_with(
        F.zip_with("sorted", before, lambda s, b: F.struct(s["h"].alias("h"), s["i"].alias("i"), b.alias("b"))),
        after,
        lambda s, a: F.when((s["h"] == s["b"]) | (s["h"] == a), s["i"]),
    )
    hit = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    docs = docs.withColumn("hit", F.when(F.col("sorted").isNotNull(), hit)).drop("sorted")
    gaps = F.zip_with(F.slice("hit", 2, F.size("hit")), F.slice("hit", 1, F.size("hit") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    return docs.withColumn("n_repeat_words", F.coalesce(F.when(F.size("hit") > 0, covered), F.lit(0)).cast("long")).drop("hit")


def quality_report(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: the base counts, base_failed, kept and the score. ``trusted`` (doc_id, text) holds those rows of ``docs`` that are."""
    slots = number_of_slots(docs, text_col)
    rows = flagged(docs, trusted, id_col, text_col)
    found = multinomials(rows, slots)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = ("doc_id", "text_key", "own", *counts)
    grams = base_columns(rows, kept="own").select(*own, F.explode_outer(ngram_slots(F.col("words"), slots)).alias("slot"))
    logs, n = found.logs, F.count("*")
    value = F.when(F.col("own"), F.col("trusted")).otherwise(F.col("plain"))
    if slots <= BROADCAST_SLOTS:
        logs = F.broadcast(logs)
    else:
        grams = grams.groupBy(*own, "slot").agg(F.count("*").alias("n"))
        n, value = F.sum("n"), F.col("n") * value
    # Equal rows of equal id are summed together; their number is that of their n-grams by that of one of them.
    summed = grams.join(logs, "slot", "left").groupBy(*own).agg(n.alias("n"), F.sum(value).alias("total"))
    each = F.greatest(F.lit(1), 2 * F.col("n_words") - 1)
    copies = F.greatest(F.lit(1), (F.col("n") / each).cast("long"))
    total = F.col("total") / copies
    known = (F.col("n_words") > 0) & F.lit(found.good > 0)
    score = F.when(known, F.round(found.score(total, each, F.col("own")), 9)).otherwise(F.lit(0.0))
    base = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return base.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (score >= threshold)).alias("kept"),
        score.alias("score"),
    )


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` that ``labels`` marks as good."""
    good = labels.filter("quality = 1").select(F.col(id_col).alias("doc_id")).distinct()
    if good.count() <= BROADCAST_ROWS:  # then no text is shuffled; beyond it each text is, once
        good = F.broadcast(good)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(good, "doc_id", "left_semi")
