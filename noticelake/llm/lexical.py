"""Operator 11: ranked lexical search by MaxScore with bounds on pairs of terms.

The queries are a stated set of items. Texts are read once into a forward index of the
items' terms; from it every task builds shards of a bounded number of documents, each a
row with the posting lists of its documents, so that a term of all documents is spread
over all shards. Beside the lists a shard holds, for every pair of terms that some item
has next to each other in its order of weights, how many documents hold both, the
greatest joint impact of the two, and its best joint impacts.

* Lower bounds: the 50th best impact of a term or a pair over all shards is reached by
  50 documents, so an item's threshold is at least the greatest of them.
* Upper bounds: for the lightest k terms of an item, the least sum over all ways to take
  them one by one (greatest impact) or as neighbouring pairs (greatest joint impact of
  either or both), by dynamic programming. Two rare terms that no document of the shard
  shares so count once, where independent maxima count both.

A shard whose bound is below an item's threshold is skipped. In others only documents of
terms beyond the bound are looked at, and those go on from term to term as long as what
they have and the bound of the rest reach the threshold. Scores are exact integers.

Defined results: a null text is an empty one and has no terms; rows of documents are
documents of their own, repeated ones too, and those without an id come last among equal
scores; an item is its id (null is one), repeated rows add nothing, several texts of an
id put their terms together; items without terms, and documents of score 0, give no
rows; empty tables give empty results; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.common import bounded_batches, whole_text
from noticelake.llm.scratch import stored

#: Documents returned for each item.
TOP = 50
#: Documents and postings that a shard holds at most, but for one document.
SHARD_DOCS, SHARD_POSTINGS = 20_000, 2_000_000
#: Terms of items that one pass over the documents serves; more items take more passes.
BLOCK_TERMS = 500_000
#: Impacts are counted in steps of this size for the lower bounds.
STEP = 1 << 24
#: What parts terms: all of ASCII but digits and letters.
PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c > 127 else 32 for c in range(256))

FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = (
    "doc_ids array<long>, terms array<int>, starts array<int>, docs array<int>, impacts array<long>, "
    "pairs array<int>, common array<int>, joint array<long>, keys array<int>, steps array<int>, reached array<int>"
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def forward_index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): per document its number of terms and its counts of those in ``vocabulary``, by their place in it."""
    known = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for batch in batches:
            totals, sizes, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found = terms_of(text)
                own = Counter(map(place, found))
                own.pop(None, None)
                totals.append(len(found))
                terms += own.keys()
                tfs += own.values()
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text")).mapInArrow(counted, FORWARD)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items over the same vocabulary: each item's terms by weight, and the pairs of neighbours in that order."""

    def __init__(self, terms: dict[int | None, list[int]], weights: np.ndarray):
        self.ids = list(terms)
        self.terms = [np.array(sorted(t, key=lambda x: (weights[x], x)), dtype=np.int64) for t in terms.values()]
        pairs: dict[tuple[int, int], int] = {}
        self.pairs = [np.array([pairs.setdefault((int(a), int(b)), len(pairs)) for a, b in zip(t, t[1:])], dtype=np.int64) for t in self.terms]
        self.of_pair = np.array(list(pairs), dtype=np.int64).reshape(-1, 2)
        self.weights = weights


def _best(impacts: np.ndarray, top: int) -> np.ndarray:
    return impacts if len(impacts) <= top else np.partition(impacts, len(impacts) - top)[len(impacts) - top :]


def shard_of(doc_ids: list, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, items: Items, n_docs: int, total: int) -> list:
    """The row of INDEX for some documents: posting lists by term, and what their pairs of terms reach together."""
    m = 50 + (50 * lengths * n_docs) // total
    doc = np.repeat(np.arange(len(sizes)), sizes)
    impact = items.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
    order = np.lexsort((doc, terms))
    order = order[impact[order] > 0]
    terms, doc, impact = terms[order], doc[order].astype(np.int32), impact[order]
    own, starts = np.unique(terms, return_index=True)
    ends = np.append(starts, len(terms))[1:]
    span = {int(t): slice(a, b) for t, a, b in zip(own, starts, ends, strict=True)}
    keys, steps, reached = [], [], []

    def note(key: int, impacts: np.ndarray) -> None:
        step, n = np.unique(_best(impacts, TOP) // STEP, return_counts=True)
        keys.append(np.full(len(step), key))
        steps.append(step)
        reached.append(n)

    for t, s in span.items():
        note(t, impact[s])
    pairs, common, joint = [], [], []
    held = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(items.of_pair[:, 0], kind="stable")
    last = None
    for k in order:
        a, b = map(int, items.of_pair[k])
        if a not in span or b not in span:
            continue
        if a != last:
            if last is not None:
                held[doc[span[last]]] = 0
            held[doc[span[a]]] = impact[span[a]]
            last = a
        other = held[doc[span[b]]]
        both = (other + impact[span[b]])[other > 0]
        if len(both):
            pairs.append(int(k))
            common.append(len(both))
            joint.append(int(both.max()))
            note(len(items.weights) + int(k), both)
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return [doc_ids, own, np.append(starts, len(terms)), doc, impact, pairs, common, joint, flat(keys), flat(steps), flat(reached)]


def pair_index(forward: DataFrame, items: Items, n_docs: int, total: int) -> DataFrame:
    """Rows of INDEX, each a shard of at most SHARD_DOCS documents; no document leaves the task that read it."""
    shared = forward.sparkSession.sparkContext.broadcast(items)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in INDEX.split(", ")]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            ids, lengths, terms, tfs, sizes = zip(*held, strict=True)
            row = shard_of([x for part in ids for x in part], *(np.concatenate(x) for x in (lengths, terms, tfs, sizes)), shared.value, n_docs, total)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in zip(row, kinds, strict=True)], names)

        docs = postings = 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, at = np.concatenate(([0], np.cumsum(sizes))), 0
            terms, tfs = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            lengths, ids = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_pylist()
            while at < len(sizes):
                room = int(np.searchsorted(starts, starts[at] + max(0, SHARD_POSTINGS - postings), side="right")) - 1
                upto = min(len(sizes), at + SHARD_DOCS - docs, max(room, at + (not docs)))
                if upto > at:
                    a, b = starts[at], starts[upto]
                    held.append((ids[at:upto], lengths[at:upto], terms[a:b], tfs[a:b], sizes[at:upto]))
                    docs, postings, at = docs + upto - at, postings + int(b - a), upto
                if at < len(sizes):
                    yield made()
                    held, docs, postings = [], 0, 0
        if held:
            yield made()

    return forward.select("doc_id", "n", "terms", "tfs").mapInArrow(shards, INDEX)


def lower_bounds(index: DataFrame) -> dict[int, int]:
    """For terms and pairs that TOP documents hold: an impact that TOP documents reach. One row a key comes to the driver."""
    reached = index.select(F.explode(F.arrays_zip("keys", "steps", "reached")).alias("x")).select("x.*").groupBy("keys", "steps").agg(F.sum("reached").alias("reached"))
    so_far = F.sum("reached").over(Window.partitionBy("keys").orderBy(F.desc("steps")))
    least = reached.withColumn("so_far", so_far).filter(F.col("so_far") >= TOP).groupBy("keys").agg(F.max("steps").alias("steps"))
    return {r["keys"]: r["steps"] * STEP for r in least.collect()}


class Shard:
    """Posting lists and pair bounds of one row of INDEX."""

    def __init__(self, row: dict, n_terms: int, n_pairs: int):
        self.n = len(row["doc_ids"])
        self.terms, starts = row["terms"], row["starts"]
        self.docs = dict(zip(self.terms.tolist(), np.split(row["docs"], starts[1:-1]), strict=True)) if len(self.terms) else {}
        self.impacts = dict(zip(self.terms.tolist(), np.split(row["impacts"], starts[1:-1]), strict=True)) if len(self.terms) else {}
        self.most = np.zeros(n_terms, dtype=np.int64)
        for t, x in self.impacts.items():
            self.most[t] = x.max()
        self.joint = np.zeros(n_pairs, dtype=np.int64)
        self.joint[row["pairs"]] = row["joint"]

    def bounds(self, terms: np.ndarray, pairs: np.ndarray, by_pairs: bool = True) -> np.ndarray:
        """Upper bounds of what the first 0, 1, 2 ... of ``terms`` can give a document together."""
        out = np.zeros(len(terms) + 1, dtype=np.int64)
        most = self.most[terms]
        both = np.maximum(self.joint[pairs], np.maximum(most[:-1], most[1:]))
        for k, x in enumerate(most.tolist(), 1):
            out[k] = out[k - 1] + x
            if by_pairs and k > 1:
                out[k] = min(out[k], out[k - 2] + both[k - 2])
        return out

    def add(self, docs: np.ndarray, scores: np.ndarray, term: int) -> None:
        """Add the impacts of ``term`` to the scores of ``docs``."""
        there = self.docs.get(term)
        if there is not None:
            at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
            scores += np.where(there[at] == docs, self.impacts[term][at], 0)

    def search(self, terms: np.ndarray, pairs: np.ndarray, least: int, by_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with their scores, of which none below the TOP best of the shard matters, and how many were looked at."""
        nothing = np.zeros(0, dtype=np.int64)
        upto, bar, seen = self.bounds(terms, pairs, by_pairs), max(1, least), 0
        if upto[-1] < bar:
            return nothing, nothing, 0
        # The documents of the heaviest terms, scored in full, raise the bar.
        first, held = [], 0
        for t in terms[::-1].tolist():
            if t in self.docs:
                first.append(self.docs[t])
                held += len(first[-1])
                if held >= TOP:
                    break
        docs = np.unique(np.concatenate(first))
        if len(docs) >= TOP:
            scores = np.zeros(len(docs), dtype=np.int64)
            for t in terms.tolist():
                self.add(docs, scores, t)
            seen = len(docs)
            bar = max(bar, int(_best(scores, TOP).min()))
        # Documents that hold none of the terms from here on are below the bar.
        rest = int(np.searchsorted(upto, bar, side="left")) - 1
        total = np.zeros(self.n, dtype=np.int64)
        for t in terms[rest:].tolist():
            if t in self.docs:
                total[self.docs[t]] += self.impacts[t]
        docs = np.flatnonzero(total)
        scores = total[docs]
        seen += len(docs)
        for k in range(rest, 0, -1):
            able = scores + upto[k] >= bar
            docs, scores = docs[able], scores[able]
            if not len(docs):
                break
            self.add(docs, scores, int(terms[k - 1]))
        good = scores >= bar
        return docs[good], scores[good], seen


def found_in(index: DataFrame, items: Items, least: list[int]) -> DataFrame:
    """(item_id, doc_id, score): the candidates of every shard, at most TOP for each item."""
    shared = index.sparkSession.sparkContext.broadcast((items, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in batch.schema.names if name != "doc_ids"}
                listed = batch.column("doc_ids")[i].values
                ids, named = listed.fill_null(0).to_numpy(zero_copy_only=False), listed.is_valid().to_numpy(zero_copy_only=False)
                shard = Shard(row | {"doc_ids": ids}, len(items.weights), len(items.of_pair))
                out: tuple[list, list, list] = ([], [], [])
                for item, terms, pairs, bar in zip(items.ids, items.terms, items.pairs, least, strict=True):
                    docs, scores, _ = shard.search(terms, pairs, bar)
                    best = np.lexsort((ids[docs], ~named[docs], -scores))[:TOP]
                    out[0].extend([item] * len(best))
                    out[1].extend(listed.take(pa.array(docs[best])).to_pylist())
                    out[2].extend(scores[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    columns = ("doc_ids", "terms", "starts", "docs", "impacts", "pairs", "joint")
    return index.select(*columns).mapInArrow(search, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): each term of an item once."""
    folded = F.translate(whole_text(text_col), UPPER, LOWER)
    term = F.explode(F.split(folded, PARTS)).alias("term")
    return items.select(F.col(id_col).cast("long").alias("item_id"), term).filter("term <> ''").distinct()


def _ranked(spark: SparkSession, docs: DataFrame, rows: list, id_col: str, text_col: str) -> DataFrame | None:
    """Candidates of all shards for a block of items, given as rows (item_id, term)."""
    vocabulary = sorted({r["term"] for r in rows})
    place = {t: i for i, t in enumerate(vocabulary)}
    own: dict[int | None, list[int]] = {}
    for r in rows:
        own.setdefault(r["item_id"], []).append(place[r["term"]])
    forward = stored(forward_index(docs, vocabulary, id_col, text_col))
    n_docs, total = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    items = Items(own, np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64))
    index = stored(pair_index(forward, items, n_docs, total))
    bounds = lower_bounds(index)
    keys = [[*t.tolist(), *(p + len(vocabulary)).tolist()] for t, p in zip(items.terms, items.pairs, strict=True)]
    return found_in(index, items, [max((bounds.get(k, 0) for k in own), default=0) for own in keys])


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's TOP best documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    terms = stored(item_terms(items, item_col, item_text))
    blocks = math.ceil(terms.count() / BLOCK_TERMS)
    found = []
    for i in range(blocks):
        block = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        if block and (part := _ranked(spark, docs, block, id_col, text_col)) is not None:
            found.append(part)
    schema = "item_id long, doc_id long, score long"
    both = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return both.withColumn("rank", rank).filter(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
