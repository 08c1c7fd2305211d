"""Windows of an item's size against brute force: passages in another order, mixed with other words, edited, and repeated."""

import numpy as np
import pytest

from noticelake.llm import decontam

from .test_corpus_operators import leaks


def words(rng, n, of=5000, head="w"):
    return [f"{head}{x}" for x in rng.integers(0, of, n)]


def found(spark, docs, items):
    df = spark.createDataFrame(list(docs), "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contamination_report(df, bench).collect()}


@pytest.mark.parametrize("bound", [decontam.BROADCAST_ROWS, 0])
def test_passages_in_another_order(spark, monkeypatch, bound):
    """With a bound of 0 nothing is broadcast."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(7)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    around = words(rng, 40, head="x")
    sentences = [words(rng, 45) for _ in range(6)]
    items = [(1, " ".join(a + b)), (2, " ".join(sum(sentences, []))), (3, " ".join(c)), (None, " ".join(d))]
    docs = [
        (0, " ".join(b + a)),
        (1, " ".join(around + b + a + around)),
        (2, " ".join(around + sum((sentences[i] for i in (3, 0, 5, 1, 4, 2)), []))),
        (3, " ".join(sum(zip(c, around, strict=False), ()))),
        (4, " ".join(c[:55] + around)),
        (5, " ".join(around + c[5:])),
        (6, " ".join(c[4:] + around)),
        (7, " ".join(around + d + c + around)),
        (8, " ".join(around)),
        (9, " ".join(a[:20] + around + b[:20])),
    ]
    want = leaks(docs, [(k, t) for k, t in items])
    assert {(0, 1), (1, 1), (2, 2)} <= want and not {i for i, _ in want} & {3, 8, 9}
    assert found(spark, docs, items) == want


def test_repeated_shingles_count_as_often_as_they_stand(spark):
    refrain = "we sing the same song again and again "
    items = [(1, refrain * 6), (2, refrain * 2 + "until the very last of us has gone home to sleep")]
    docs = [(0, refrain * 6), (1, refrain * 5), (2, refrain * 3), (3, refrain * 12), (4, "x " + refrain * 2 + "until the very last of us has gone home to rest"), (5, refrain)]
    assert found(spark, docs, items) == leaks(docs, items)


def test_recall_at_the_bar(spark):
    """Passages with random edits, many of them just above and just below the similarity of 0.8."""
    rng = np.random.default_rng(11)
    items = [(i, " ".join(words(rng, int(rng.integers(14, 90))))) for i in range(24)]
    docs = []
    for i in range(144):
        w = items[i % 24][1].split()
        for _ in range(int(rng.integers(0, 4))):
            k = int(rng.integers(0, len(w)))
            w[k : k + 1] = words(rng, int(rng.integers(0, 3)), head="y")
        docs.append((i, " ".join(words(rng, int(rng.integers(0, 9)), head="x") + w + words(rng, int(rng.integers(0, 9)), head="z"))))
    got, want = found(spark, docs, items), leaks(docs, items)
    assert 50 < len(want) < 144
    assert got <= want and len(got) >= 0.99 * len(want)


def test_every_value_near_a_block_is_in_the_index():
    widths = [b - a for a, b in zip(decontam.EDGES, decontam.EDGES[1:], strict=False)]
    assert sum(widths) == decontam.BITS and decontam.RADIUS <= decontam.BLOCKS * (decontam.PROBE + 1) - 1
