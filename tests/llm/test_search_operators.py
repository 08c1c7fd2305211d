"""Lexical search, vector near-duplicates and hard negatives against plain restatements."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import components, lexical, negatives, vectors

from .conftest import SF


def ranked(docs, items, top=50):
    """docs: (doc_id, text) rows; items: (item_id, text) rows."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    own = defaultdict(set)
    for i, t in items:
        own[i] |= set(terms(t))
    out = []
    for i, query in own.items():
        found = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // total if b else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in query if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got_search(docs, items):
    return sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.mark.parametrize("bounds", [(20_000, 2_000_000, 500_000), (7, 300, 100)])
def test_search_equals_brute_force(docs, items, monkeypatch, bounds):
    for name, value in zip(("SHARD_DOCS", "SHARD_POSTINGS", "BLOCK_TERMS"), bounds, strict=True):
        monkeypatch.setattr(lexical, name, value)
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got_search(docs, items) == want


def test_search_of_odd_rows(spark, odd_docs, no_docs, items):
    rows = [(1, "Words few MORE text"), (1, "words few more text"), (1, "than id"), (None, "word é two"), (2, None), (3, "...!"), (4, "nowhere-found")]
    odd = spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit("taken"))
    want = ranked([(r.doc_id, r.text) for r in odd_docs.collect()], rows)
    assert want and got_search(odd_docs, odd) == want
    assert got_search(no_docs, odd) == [] and got_search(odd_docs, odd.limit(0)) == []
    assert lexical.search(no_docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_pair_bounds_are_bounds_and_tighter(docs, items):
    """In one shard of all documents: no result lost, and fewer documents looked at than with independent maxima."""
    vocabulary = sorted({r.term for r in lexical.item_terms(items).collect()})
    place = {t: i for i, t in enumerate(vocabulary)}
    forward = lexical.forward_index(docs, vocabulary)
    rows = forward.collect()
    n_docs, total = sum(r.n > 0 for r in rows), sum(r.n for r in rows)
    df = Counter(t for r in rows for t in r.terms)
    own = defaultdict(list)
    for r in lexical.item_terms(items).collect():
        own[r.item_id].append(place[r.term])
    block = lexical.Items(own, np.array([lexical.weight(n_docs, df[i]) for i in range(len(vocabulary))]))
    (row,) = lexical.pair_index(forward.coalesce(1), block, n_docs, total).collect()
    shard = lexical.Shard({k: np.array(v) for k, v in row.asDict().items()}, len(vocabulary), len(block.of_pair))
    looked = [0, 0]
    for terms, pairs in zip(block.terms, block.pairs, strict=True):
        scores = np.zeros(shard.n, dtype=np.int64)
        for t in terms.tolist():
            if t in shard.docs:
                scores[shard.docs[t]] += shard.impacts[t]
        for k, most in enumerate(shard.bounds(terms, pairs)):
            part = np.zeros(shard.n, dtype=np.int64)
            for t in terms[:k].tolist():
                shard.add(np.arange(shard.n), part, t)
            assert part.max() <= most
        for by_pairs in (False, True):
            found, own_scores, seen = shard.search(terms, pairs, 0, by_pairs)
            looked[by_pairs] += seen
            assert (own_scores == scores[found]).all()
            best = np.sort(scores[scores > 0])[::-1][:50]
            assert (np.sort(own_scores)[::-1][: len(best)] == best).all()
    assert looked[True] < looked[False]


def linked(rows, cosine=0.9):
    """rows: (id, vector); per row (id, links, component, kept), all pairs compared."""
    able = [i is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    scaled = [np.array(v, dtype=float) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, able, strict=True)]
    units = [x if x is None else x / np.linalg.norm(x) for x in scaled]
    near = [[a != b and able[a] and able[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine for b in range(len(rows))] for a in range(len(rows))]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for b in range(len(rows)):
                if near[x][b] and b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = None if i is None else min(rows[x][0] for x in seen)
        out.append((i, int(sum(near[a])), low, i is None or low == i))
    return sorted(out, key=repr)


def vector_rows(seed):
    """Groups of near copies around random directions, most pairs close to the bar, and rows of every odd kind."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(6):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(2, 14))):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.uniform(0.02, 0.5)).tolist()))
    rows += [(len(rows) + i, rng.normal(size=16).tolist()) for i in range(40)]
    first, n = rows[0][1], len(rows)
    odd = [None, [], [0.0] * 16, [None] + first[1:], [math.nan] + first[1:], [math.inf] + first[1:], first, [1e300 * x for x in first], first[:8], [-x for x in first]]
    rows += [(n + i, v) for i, v in enumerate(odd)]
    return rows + [(None, first), (3, rows[3][1]), (3, rows[20][1]), (n + 50, first[:8])]


def got_vectors(df):
    return sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr)


@pytest.mark.parametrize(("seed", "cell", "chunk", "dims"), [(1, 4096, 4096, 8), (2, 9, 4, 8), (3, 5, 3, 4)])
def test_vectors_equal_brute_force(spark, monkeypatch, seed, cell, chunk, dims):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    init = vectors.Space.__init__
    monkeypatch.setattr(vectors.Space, "__init__", lambda self, sample, n, cosine=0.9: init(self, sample, n, cosine, dims))
    rows = vector_rows(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("taken"))
    want = linked(rows)
    assert sum(r[1] for r in want) > 100
    assert got_vectors(df) == want


def test_vectors_of_one_line_or_none(spark):
    """A sample without variance in most directions, one row, and no rows."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(5)] + [(9, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got_vectors(df) == linked(rows)
    assert got_vectors(df.limit(1)) == [(0, 0, 0, True)]
    assert got_vectors(df.limit(0)) == []


def test_components_of_repeated_links_and_nulls(spark):
    node = "struct<id:long,set:long>"
    links = [((1, 0), (2, 0)), ((2, 0), (1, 0)), ((2, 0), (3, 0)), ((3, 0), (3, 0)), ((None, 0), (9, 0)), ((5, 1), (5, 2))]
    df = spark.createDataFrame(links, f"a {node}, b {node}")
    got = {(tuple(r.node), tuple(r.label)) for r in components.components(df).collect()}
    assert got == {((1, 0), (1, 0)), ((2, 0), (1, 0)), ((3, 0), (1, 0)), ((5, 1), (5, 1)), ((5, 2), (5, 1))}
    assert components.components(df.limit(0)).collect() == []


def test_components_of_a_long_path(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_NODES", 20)
    n = 300
    df = spark.range(n, numPartitions=4).select(*(F.struct((F.col("id") + i).alias("id"), F.lit(0).cast("long").alias("set")).alias(c) for i, c in ((0, "a"), (1, "b"))))
    assert {r.label.id for r in components.components(df.orderBy(F.xxhash64("a"))).collect()} == {0}


def mined(rows):
    """rows: (id, vector, label)."""
    part = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part[i, tuple(v), label] = (i, [math.floor(256 * x) for x in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label)
    out = []
    for a, va, la in part.values():
        if a % 100:
            continue
        score = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in part.values()]
        for p, pid, _ in sorted(s for s in score if s[2] == la and s[1] != a)[:5]:
            good = sorted(s for s in score if s[2] != la and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(a, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(good, 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [(2_000, 4_096), (2, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", bounds[0])
    monkeypatch.setattr(negatives, "STEP_ROWS", bounds[1])
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 19)) * 0.3
    rows = [(i, (centres[i % 12] + rng.normal(size=19) * 0.1).tolist(), int(rng.integers(-2, 4))) for i in range(0, 700, 2)]
    rows += [(1000 + 2 * i, rows[i][1], rows[i][2]) for i in range(60)]  # ties
    rows += [(5, None, 1), (7, [None] * 19, 1), (9, [math.nan] * 19, 1), (11, rows[0][1], None), (None, rows[0][1], 1), (200, rows[3][1][:5], 1), (13, [], 2), rows[0], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("taken"))
    got = sorted(tuple(r) for r in negatives.hard_negatives(df).collect())
    want = mined(rows)
    assert len(want) > 50 and got == want


def test_negatives_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([(1, [0.5], 1)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(df).collect() == [] and negatives.hard_negatives(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e12], 1)], df.schema))
