"""Operator 5: a quality classifier by compression.

Two zstandard dictionaries are built, one from lines of good labelled text and one
from lines of bad. A whole text is compressed block by block with both; the
difference of the two sizes, normalised in three ways, and the ratio of the
compressed to the plain size go through a logistic calibration that was fitted on
labelled documents which the dictionaries have not seen.

Only rows of ``labels`` whose crc32 of the id as text leaves a remainder other
than 0 when divided by 5 are learnt from: remainders 2 to 4 give the dictionaries,
1 the calibration. What is learnt from is bounded by ``FIT_DOCS`` documents for
each dictionary, ``FIT_LINES`` pieces of lines for each, and ``CALIBRATION_DOCS``.

Defined results: a null or empty text is compressed as an empty block and gets the
score that follows; a null id is never held out and never learnt from; where the
labels hold no good or no bad rows to learn from, every score is 0.5; repeated rows
get equal scores; other columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import bounded_batches, fresh, whole_text

FIT_DOCS, FIT_LINES, CALIBRATION_DOCS = 6_000, 12_000, 5_000
#: Code points in a block, bytes in a dictionary, compression level, bytes of a frame's own head.
BLOCK, DICTIONARY_BYTES, LEVEL, FRAME = 1024, 64 << 10, 3, 6
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries for good and bad text and the weights of the calibration; no weights: nothing was learnt."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = ()


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if known:
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


@lru_cache(maxsize=1)
def _compressors(good: bytes, bad: bytes) -> tuple:
    return _compressor(good), _compressor(bad)


def features(text: str, model: QualityModel) -> list[float]:
    """Normalised size differences (whole, worst block, per byte) and the compressed share of a text."""
    with_good, with_bad = _compressors(model.good, model.bad)
    good, bad, size, worst = 0, 0, 0, 1.0
    for at in range(0, max(1, len(text)), BLOCK):
        block = text[at : at + BLOCK].encode()
        g, b = len(with_good.compress(block)) - FRAME, len(with_bad.compress(block)) - FRAME
        good, bad, size = good + g, bad + b, size + len(block)
        worst = min(worst, (b - g) / max(1, b + g + 40))
    raw = ((bad - good) / max(1, bad + good + 8), worst, (bad - good) / (size + 20), (good + FRAME) / (size + 20))
    return [min(1.0, max(-1.0, x)) for x in raw]


def score(text: str, model: QualityModel) -> float:
    """Probability that the text is good."""
    if not model.weights:
        return 0.5
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], features(text, model), strict=True))
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method, the constant first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Dictionaries and calibration from bounded samples of the labelled rows."""
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("mark"))
        .filter(F.col("id").isNotNull() & F.col("mark").isin(0, 1) & (_fold("id") != HELD_OUT))
        .groupBy("id")
        .agg(F.min("mark").alias("mark"))
        .withColumn("turn", F.xxhash64(F.col("id").cast("string")))
    )
    fit, rest = marks.filter(_fold("id") != CALIBRATION), marks.filter(_fold("id") == CALIBRATION)
    first = lambda df, n: df.orderBy("turn", "id").limit(n).select("id", "mark")
    chosen = first(fit.filter("mark = 0"), FIT_DOCS).unionByName(first(fit.filter("mark = 1"), FIT_DOCS))
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    # Pieces of lines that stand in one class only; a piece is never longer than a block.
    line = F.explode(F.split("text", "\n"))
    piece = F.explode(F.expr(f"transform(sequence(1, greatest(1, length(line)), {BLOCK}), i -> substring(line, i, {BLOCK}))"))
    lines = texts.join(F.broadcast(chosen), "id").select("mark", line.alias("line"))
    own = (
        lines.select("mark", piece.alias("piece"))
        .groupBy("piece")
        .agg(F.min("mark").alias("mark"), F.max("mark").alias("most"))
        .filter((F.col("mark") == F.col("most")) & (F.length("piece") > 0))
        .withColumn("turn", F.xxhash64("piece"))
    )
    pieces = {
        q: [r["piece"].encode() for r in own.filter(F.col("mark") == q).orderBy("turn", "piece").limit(FIT_LINES).select("piece").collect()]
        for q in (0, 1)
    }
    if not pieces[0] or not pieces[1]:
        return QualityModel(b"", b"")
    bare = QualityModel(_dictionary(pieces[1]), _dictionary(pieces[0]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(batch: pd.Series) -> pd.Series:
        return pd.Series([features(t, bare) for t in batch], dtype=object)

    seen = texts.join(F.broadcast(first(rest, CALIBRATION_DOCS)), "id").select("mark", measured("text").alias("x")).collect()
    if len({r["mark"] for r in seen}) < 2:
        return QualityModel(b"", b"")
    weights = _logistic(np.array([r["x"] for r in seen]), np.array([r["mark"] for r in seen], dtype=float))
    return QualityModel(bare.good, bare.bad, weights)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is good."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def scored(batch: pd.Series) -> pd.Series:
        return pd.Series([score(t, model) for t in batch], dtype=float)

    return docs.withColumn(out, scored(whole_text(text_col)))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    bounded_batches(docs.sparkSession)
    model = fit_quality(docs, labels, id_col, text_col)
    (name,) = fresh(docs, "score")
    scored = score_quality(docs.select(id_col, text_col), model, text_col, name)
    return scored.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(_fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose score reaches the threshold."""
    (name,) = fresh(docs, "score")
    scored = score_quality(docs, fit_quality(docs, labels, id_col, text_col), text_col, name)
    return scored.filter(F.col(name) >= THRESHOLD).drop(name)


def held_out(doc_id: object) -> bool:
    """The fold rule in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT
