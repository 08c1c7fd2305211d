"""Operator 13: hard-negative mining with the method of the Four Russians.

Components become integers. A candidate's integers, less the least of all, are written as
bit planes, eight components to a byte. For an anchor there is, for every eight components,
a table of the 256 sums of a subset of them; a candidate's score is then the sum over
planes and groups of the table entries that its bytes name, each plane shifted by its
number, plus the anchor's sum times the least integer. Scores are exact.

Anchors are a stated query set. They are taken in blocks of at most about BLOCK_ANCHORS,
whose tables go to all tasks; each block meets all candidates twice: once for the best
rows of the anchor's own label, its positives, and once for the best rows of other labels
between the bounds that each positive's score sets. Tasks keep the best per anchor, or
per anchor and positive, of the candidates that they read; a ranking joins what they found.

Defined results: rows with a null label, a null vector, a null or non-finite component, or
no id take no part; a shorter vector counts as if zeros followed; equal rows count once;
rows of the anchor's own id are not its positives; rows that repeat an id with other vectors or labels are
rows of their own, and are ordered among equal scores by a hash; a positive without any
row within its bounds gives no rows; empty tables give empty results; components whose
scores could leave 64 bits are an error; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.common import bounded_batches
from noticelake.llm.scratch import stored

#: Every row whose id this divides is an anchor; the label of every row whose id the other divides is one further, of LABELS.
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score, in percent of the positive's.
LEAST, MOST = 30, 90
SCALE = 256
#: Anchors whose tables are in memory at once, and candidates scored in one step.
BLOCK_ANCHORS, STEP_ROWS = 2_000, 4_096
_NONE = np.iinfo(np.int64).min
#: The bits of every byte, lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def rows_taking_part(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, key, label, values): each row once, with its integers and a hash that tells rows of one id apart."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label, number = F.col(label_col).cast("long"), F.col(id_col).cast("long")
    moved = F.when(number % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    values = F.transform(v, lambda x: F.floor(SCALE * x.cast("double")))
    part = vectors.filter(number.isNotNull() & label.isNotNull() & v.isNotNull() & finite)
    return part.select(number.alias("id"), F.xxhash64(label, v).alias("key"), moved.alias("label"), values.alias("values")).dropDuplicates(["id", "key"])


def bit_planes(values: np.ndarray, least: int, planes: int) -> np.ndarray:
    """Bytes (row, plane, group) of the bits of ``values`` - ``least``; columns are padded to whole groups."""
    rows, dims = values.shape
    groups = -(-dims // 8)
    wide = np.zeros((rows, groups * 8), dtype=np.int64)
    wide[:, :dims] = values - least
    bits = (wide[:, None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, planes, groups, 8), axis=-1, bitorder="little")[..., 0]


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (anchor, group, byte): the sum of the components that the bits of a byte name."""
    rows, dims = anchors.shape
    wide = np.zeros((rows, -(-dims // 8) * 8), dtype=np.int64)
    wide[:, :dims] = anchors
    return wide.reshape(rows, -1, 8) @ _BITS.T


def scores(table: np.ndarray, planes: np.ndarray, offset: int) -> np.ndarray:
    """Scores of all candidates with the anchor of ``table`` (group, byte); ``planes`` is (plane, group, row)."""
    total = np.full(planes.shape[2], offset, dtype=np.int64)
    for k, plane in enumerate(planes):
        sums = table[0].take(plane[0])
        for group in range(1, len(plane)):
            sums += table[group].take(plane[group])
        total += sums << k
    return total


class Anchors:
    """A block of anchors with their tables; ``wanted``: per anchor its positives as (score, id, key)."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, values: np.ndarray, least: int, wanted: list[list[tuple]] | None = None):
        self.ids, self.keys, self.labels, self.wanted = ids, keys, labels, wanted
        self.tables, self.offsets = subset_sums(values), values.sum(axis=1) * least


def packed(rows: DataFrame, dims: int, least: int, planes: int) -> DataFrame:
    """(id, key, label, planes): the bit planes of every row as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = bit_planes(_matrix(batch.column("values"), dims), least, planes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in out], pa.binary())], ["id", "key", "label", "planes"])

    return rows.select("id", "key", "label", "values").mapInArrow(pack, "id long, key long, label long, planes binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, with zeros behind the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _first(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` first by score, then id, then key."""
    if len(score) > top:
        able = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
    else:
        able = np.arange(len(score))
    return able[np.lexsort((keys[able], ids[able], -score[able]))[:top]]


def _steps(batches: Iterator[pa.RecordBatch], n_planes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, keys, labels and planes (plane, group, row) of at most STEP_ROWS candidates."""
    for whole in batches:
        for at in range(0, whole.num_rows, STEP_ROWS):
            batch = whole.slice(at, STEP_ROWS)
            planes = np.frombuffer(b"".join(batch.column("planes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, n_planes, -1)
            ids, keys, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key", "label"))
            yield ids, keys, labels, np.ascontiguousarray(planes.transpose(1, 2, 0))


FOUND = "anchor int, positive int, id long, key long, score long"


def _best_of_tasks(candidates: DataFrame, anchors: Anchors, planes: int) -> DataFrame:
    """FOUND: per task and anchor the first rows of its label, or per task, anchor and positive those of other labels within the bounds."""
    shared = candidates.sparkSession.sparkContext.broadcast(anchors)

    def wanted_of(a: int, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, same: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        anchors = shared.value
        if anchors.wanted is None:
            able = np.flatnonzero(same & (ids != anchors.ids[a]))
            yield 0, able[_first(score[able], ids[able], keys[able], POSITIVES)]
            return
        bounds = [(-(-LEAST * p // 100), MOST * p // 100) for p, *_ in anchors.wanted[a]]
        able = np.flatnonzero(~same & (score >= min(low for low, _ in bounds)) & (score <= max(high for _, high in bounds)))
        able = able[np.lexsort((keys[able], ids[able], -score[able]))]
        falling = -score[able]
        for i, (low, high) in enumerate(bounds):
            start, stop = np.searchsorted(falling, -high, side="left"), np.searchsorted(falling, -low, side="right")
            yield i, able[start : min(stop, start + NEGATIVES)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        top = POSITIVES if anchors.wanted is None else NEGATIVES
        best: dict[tuple[int, int], np.ndarray] = {}
        for ids, keys, labels, bytes_ in _steps(batches, planes):
            for a in range(len(anchors.ids)):
                if anchors.wanted is None or anchors.wanted[a]:
                    score = scores(anchors.tables[a], bytes_, int(anchors.offsets[a]))
                    for i, rows in wanted_of(a, score, ids, keys, labels == anchors.labels[a]):
                        if len(rows):
                            found = np.stack((ids[rows], keys[rows], score[rows]))
                            if (a, i) in best:
                                found = np.concatenate((best[a, i], found), axis=1)
                                found = found[:, _first(found[2], found[0], found[1], top)]
                            best[a, i] = found
        if best:
            sizes = [x.shape[1] for x in best.values()]
            ends = [pa.array(np.repeat([k[i] for k in best], sizes), pa.int32()) for i in (0, 1)]
            rows = np.concatenate(list(best.values()), axis=1)
            yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, rows)], ["anchor", "positive", "id", "key", "score"])

    return candidates.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, top: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(candidates: DataFrame, block: list, dims: int, least: int, planes: int) -> DataFrame:
    """RESULT for a block of anchors, given as rows (id, key, label, values)."""
    values = np.zeros((len(block), dims), dtype=np.int64)
    for row, r in zip(values, block, strict=True):
        row[: len(r["values"])] = r["values"]
    ids, keys, labels = (np.array([r[c] for r in block], dtype=np.int64) for c in ("id", "key", "label"))
    anchors = Anchors(ids, keys, labels, values, least)
    wanted: list[list[tuple]] = [[] for _ in block]
    # At most POSITIVES rows for each anchor of the block.
    for r in _ranked(_best_of_tasks(candidates, anchors, planes), POSITIVES, "anchor").orderBy("anchor", "rank").collect():
        wanted[r["anchor"]].append((r["score"], r["id"], r["key"]))
    anchors.wanted = wanted
    found = _ranked(_best_of_tasks(candidates, anchors, planes), NEGATIVES, "anchor", "positive")
    spark = candidates.sparkSession
    named = [(a, i, int(ids[a]), pid, score) for a, own in enumerate(wanted) for i, (score, pid, _) in enumerate(own)]
    names = spark.createDataFrame(named, "anchor int, positive int, anchor_id long, positive_id long, positive_score long")
    joined = found.join(F.broadcast(names), ["anchor", "positive"])
    return joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """RESULT: for each anchor and positive the first negatives within the bounds of the positive's score."""
    spark: SparkSession = vectors.sparkSession
    bounded_batches(spark)
    rows = stored(rows_taking_part(vectors, id_col, vector_col, label_col))
    is_anchor: Column = F.col("id") % ANCHOR_EVERY == 0
    least, most, dims, n = rows.agg(
        F.coalesce(F.min(F.array_min("values")), F.lit(0)), F.coalesce(F.max(F.array_max("values")), F.lit(0)), F.max(F.size("values")), F.count_if(is_anchor)
    ).first()
    if not n or not dims:
        return spark.createDataFrame([], RESULT)
    least, most = min(least, 0), max(most, 0)
    if (most - least) * max(-least, most) * dims * 4 >= 2**63:
        raise ValueError("components are too large for scores of 64 bits")
    planes = max(1, (most - least).bit_length())
    candidates = stored(packed(rows, dims, least, planes))
    blocks = math.ceil(n / BLOCK_ANCHORS)
    of_block = F.pmod(F.xxhash64("id", "key"), F.lit(blocks))
    found = []
    for i in range(blocks):
        block = rows.filter(is_anchor & (of_block == i)).orderBy("id", "key").collect()
        if block:
            found.append(stored(_mined(candidates, block, dims, least, planes)) if blocks > 1 else _mined(candidates, block, dims, least, planes))
    return reduce(DataFrame.unionByName, found)
