"""Quality, rules, decontamination, near-duplicates and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from noticelake.llm import components, decontam, neardup, quality_rules, quality_zstd
from noticelake.llm.queries import op5_quality

from .conftest import SF

SF_MORE = "/root/testdata/sf0.01"


# ---- operator 5


def test_quality_on_held_out_rows(spark):
    scores = {r.doc_id: r for r in op5_quality(spark, SF_MORE).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores.values())
    right = [scores[i].predicted == marks[i] for i in held]
    good = [scores[i].predicted for i in held if marks[i] == 1]
    assert np.mean(right) > 0.95 and np.mean(good) > 0.97


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, None), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality_zstd.quality_report(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in quality_zstd.quality_report(odd_docs, labels.filter("doc_id = 1")).collect()} == {0.5}
    kept = quality_zstd.keep_good(odd_docs, labels.filter("doc_id = 1"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality_zstd.quality_report(no_docs, labels).count() == 0


# ---- operator 7

WORD = re.compile("[^\x20\x09-\x0d]+")


def rule_counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, odd_docs, no_docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (docs, odd_docs):
        got = quality_rules.quality_report(df, quality_rules.trusted_texts(df, labels)).collect()
        assert len(got) == df.count()
        want = sorted(((r.doc_id or -1), *rule_counts(r.text or "")) for r in df.collect())
        assert sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and r.kept == (not failed and r.score >= quality_rules.THRESHOLD)
    assert quality_rules.quality_report(no_docs, quality_rules.trusted_texts(no_docs, labels)).count() == 0


def test_rules_on_repetition(spark):
    texts = ["a b c a b c a b c", "a a a a a", "x y z\nx y z\n\n x y z", "a b a b", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_columns(df).collect()}
    assert got == {i: rule_counts(t)[4] for i, t in enumerate(texts)}


def plain_scores(texts, trusted, slots_of, m):
    """texts: id to its words; the score of each by counts of which its own n-grams are left out, one each."""
    a, counts = quality_rules.SMOOTHING, {i: Counter(slots_of[i]) for i in texts}
    raw, good = sum(counts.values(), Counter()), sum((counts[i] for i in texts if i in trusted), Counter())
    n, g = sum(raw.values()), sum(good.values())
    out = {}
    for i, own in counts.items():
        size, t = sum(own.values()), i in trusted
        each = sum(k * (math.log(good[s] - t + a * g / n) - math.log(raw[s] - 1 + a)) for s, k in own.items()) / size
        out[i] = each - math.log(g - t * size + a * m * g / n) + math.log(n - size + a * m)
    return out


def test_scores_follow_the_ratio_of_multinomials(spark, docs):
    few = spark.createDataFrame([(1, "good good words"), (2, "bad words bad"), (3, "good words again")], "doc_id long, text string")
    for raw, trusted in ((few, {1, 3}), (docs.filter("length(text) < 3000").select("doc_id", "text"), set(range(0, 200, 3)))):
        m = quality_rules.number_of_slots(raw)
        slots = {r.doc_id: r.s for r in raw.select("doc_id", quality_rules.ngram_slots(quality_rules.words(raw.text), m).alias("s")).collect() if r.s}
        want = plain_scores(slots, trusted, slots, m)
        got = {r.doc_id: r.score for r in quality_rules.quality_report(raw, raw.filter(raw.doc_id.isin(*trusted))).collect()}
        assert {i: got[i] for i in want} == pytest.approx(want, abs=1e-7)
    nobody = quality_rules.quality_report(few, few.limit(0)).collect()
    assert {r.score for r in nobody} == {0.0}


def test_trust_is_no_advantage_and_rows_that_are_added_change_little(spark):
    """Good texts of which half are trusted are kept alike; verdicts on some texts stay when ten times as many come in."""
    small, large = (spark.read.parquet(f"/root/testdata/{sf}/documents.parquet") for sf in ("sf0.01", "sf0.1"))
    labels = [spark.read.parquet(f"/root/testdata/{sf}/labels.parquet") for sf in ("sf0.01", "sf0.1")]
    quality = {r.doc_id: r.quality for r in labels[0].collect()}
    good = quality_rules.trusted_texts(small, labels[0])
    half = good.filter("pmod(xxhash64(doc_id), 2) = 0")
    inside = {r.doc_id for r in half.select("doc_id").collect()}
    rows = [r for r in quality_rules.quality_report(small, half).collect() if not r.base_failed]
    share = lambda ids: np.mean([r.kept for r in rows if r.doc_id in ids])
    outside = {i for i, q in quality.items() if q == 1} - inside
    assert share(inside) > 0.95 and share(outside) > 0.95 and abs(share(inside) - share(outside)) < 0.03
    assert share({i for i, q in quality.items() if q == 0}) < 0.1
    alone = {r.doc_id: r.kept for r in quality_rules.quality_report(small, good).collect()}
    moved = large.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    more = labels[1].select((F.col("doc_id") + 1_000_000).alias("doc_id"), "quality")
    both = small.select("doc_id", "text").unionByName(moved)
    trusted = quality_rules.trusted_texts(both, labels[0].select("doc_id", "quality").unionByName(more))
    together = {r.doc_id: r.kept for r in quality_rules.quality_report(both, trusted).collect()}
    assert sum(together[i] != k for i, k in alone.items()) <= 20


def test_rules_beyond_the_broadcast_and_with_more_slots(spark, docs, odd_docs, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    report = lambda df: sorted(map(str, quality_rules.quality_report(df, quality_rules.trusted_texts(df, labels)).collect()))
    want = [report(df) for df in (docs, odd_docs)]
    monkeypatch.setattr(quality_rules, "BROADCAST_SLOTS", 0)
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert [report(df) for df in (docs, odd_docs)] == want
    many = docs.select("text").crossJoin(spark.range(300))
    assert quality_rules.number_of_slots(docs) < quality_rules.number_of_slots(many)


# ---- operator 6

PLAIN = regex.compile(r"[\p{L}\p{N}]+")


def grams(text, size=5):
    w = PLAIN.findall((text or "").lower())
    return list(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [tuple(w)] if w else []


def leaks(docs, items):
    """Pairs with an item-sized window of a weighted similarity of 0.8 or more, by trying all windows."""
    found = set()
    for d, text in docs:
        for i, item in items:
            own = grams(item)
            g = grams(text, min(5, len(PLAIN.findall((item or "").lower()))) or 5) if own else []
            m, want = len(own), Counter(own)
            for s in range(-m + 1, len(g)):
                w = Counter(g[max(0, s) : s + m])
                shared = (w & want).total()
                if shared and 100 * shared >= 80 * (w.total() + m - shared):
                    found.add((d, i))
                    break
    return found


def test_decontamination(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and more words to the very end"
    words = item.split()
    texts = [
        f"before {item} after",
        item.upper().replace(" ", ", "),
        " ".join(words[:-2]),
        " ".join(words[:10] + ["new"] + words[10:]),
        " ".join(words[::2]),
        "clean text of no interest at all and of some length",
        "short passage",
        f"{item} {item}",
        None,
        "",
    ]
    items = [(1, item), (2, "short passage"), (3, None), (4, ""), (5, "clean text of no"), (1, item)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination_report(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(list(enumerate(texts)), dict(items).items()) and sum(r.doc_id == 0 for r in got) == 2
    assert all(r.similarity >= 0.8 for r in got)
    wide = docs.withColumnsRenamed({}).selectExpr("*", "doc_id AS content")
    kept = decontam.drop_contaminated(wide, bench)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == set(range(10)) - {r.doc_id for r in got}
    assert decontam.contamination_report(docs.limit(0), bench).count() == 0 and decontam.contamination_report(docs, bench.limit(0)).count() == 0


def test_decontamination_of_the_table(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination_report(docs, bench).collect()}
    inside = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert inside <= got and len(got) <= len(inside) + 1



# ---- operator 10


def brute_components(rows, size, percent):
    sets = [(i, neardup.shingle_set(t or "", size)) for i, t in rows if i is not None]
    top = {i: i for i, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_the_table(docs, size, percent):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size, percent).collect()}
    assert got == want


def near_group(n, seed, edits, first=1000):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits)):
            k = rng.integers(0, len(w))
            w[k : k + 1] = [f"v{rng.integers(0, 60)}"] * rng.integers(0, 3)
        out.append((first + i, " ".join(w)))
    return out


def test_near_duplicates_in_a_hot_group(spark):
    """A group whose members often are no links of each other: chains and stragglers must come out as by brute force."""
    rows = near_group(160, 1, 12) + near_group(40, 2, 9, 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    want = brute_components(rows, 3, 85)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, neardup.near_duplicates(odd_docs).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == odd_docs.count() and by[2][1:] == (0, 2, True) and by[4][1] == 0 and by[6][1:3] == (1, 6) and by[7][1:] == (1, 6, False)
    assert by[None][2] is None and by[None][3] is True
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, None]))
    assert neardup.near_duplicates(no_docs).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    for n, share in ((40, 0.5), (300, 0.8), (3000, 0.9)):
        pool = [f"t{i}" for i in range(2 * n)]
        off = round(n * (1 - share))
        values, doc = neardup.shingle_hashes([[w.encode() for w in pool[:n]], [w.encode() for w in pool[off : off + n]]], 1)
        a, b = neardup.super_minhash(values, doc, 2)
        true = (n - off) / (n + off)
        assert abs((a == b).mean() - true) < 0.17 and len(set(a.tolist())) > 100
    assert rng is not None


def test_components(spark):
    node = lambda i: (i, 0)
    rng = np.random.default_rng(3)
    edges = [(node(i), node(i + 1)) for i in range(60)] + [(node(100), node(int(x))) for x in rng.integers(101, 160, 50)]
    links = spark.createDataFrame(edges, "a struct<id:long,set:long>, b struct<id:long,set:long>").repartition(4)
    got = {r.node.id: r.label.id for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and {v for k, v in got.items() if k >= 100} == {100}
    assert components.components(links.limit(0)).count() == 0
