"""Ids with several texts, repeated rows of a hot text, and joins beyond the bounds of what is broadcast."""

import numpy as np
import pytest

from noticelake.llm import neardup

from .test_corpus_operators import brute_components, near_group

WORDS = [f"w{i}" for i in range(90)]


def text(start, n=40, changed=()):
    w = WORDS[start : start + n]
    for k in changed:
        w[k] = "x"
    return " ".join(w)


def test_each_text_of_an_id_is_linked_by_its_own_set(spark):
    rows = [(1, text(0)), (1, text(45)), (2, text(0, changed=(39,))), (3, text(45, changed=(0,))), (4, text(20, 30)), (1, text(0)), (5, text(45))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1)]
    other = spark.createDataFrame([(1, text(0)), (2, text(45)), (2, text(0, changed=(39,))), (3, text(45, changed=(0,)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(other).collect()) == [(1, 1), (2, 1), (2, 2), (3, 2)]


@pytest.mark.parametrize("share", [3, 64])
def test_leaders_with_many_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(neardup, "SHARE", share)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = near_group(120, 4, 5) + [(5000 + i, t) for i, (_, t) in enumerate(near_group(3, 4, 5))] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows, 3, 85)
    got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in neardup.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and dict(got) == want
    kept = sorted(r.doc_id for r in neardup.keep_one(docs).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if i == c)
    assert np.array(kept).size == len(set(kept))


def test_one_row_of_each_group_stays_whatever_its_id_says_too(spark, monkeypatch):
    """An id with two texts: the group that it stands for elsewhere keeps its row, and so does its own."""
    rows = [(1, text(0), "a"), (2, text(0), "a"), (2, text(45), "a"), (3, text(45), "a"), (2, text(45), "b"), (4, "", "b"), (4, None, "a"), (None, text(0), "a"), (5, text(20, 30), "z"), (5, text(20, 30).upper(), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string").repartition(3)
    want = [(1, text(0), "a"), (2, text(45), "a"), (4, "", "b"), (None, text(0), "a")]
    for bound in (1_000_000, 0):
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", bound)
        got = neardup.keep_one(docs)
        assert got.columns == docs.columns
        got = [tuple(r) for r in got.collect()]
        assert all(w in got for w in want)
        assert len(got) == 5 and sum(r[0] == 5 for r in got) == 1
