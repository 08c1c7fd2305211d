"""Scoring rules on given cases, evidence metrics and dedup windows against plain Python."""

import datetime as dt

from pyspark.sql import functions as F

from noticelake.functions import scoring as sc
from noticelake.operators import doc_metrics, simhash, whitelist
from noticelake.operators.filters import newest_of_each, split_check
from noticelake.plans import scoring
from noticelake.streaming import streams

SF = "/root/testdata/sf0.001"


def told(spark, cases, make, schema):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}")
    return [r.x for r in df.select("i", make(df).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    cases = [
        ("2026年08月20日 09时00分", "2026年08月20日 09:00"), ("2026-07-29 08:45", "2026年07月29日"), ("开标时间：2026-07-29", "2026-07-29 00:00"), ("2026-08-14T09:30:00", "2026年8月14日 9:30"),
        ("2026-08-14 09:31", "2026-08-14 09:30"), ("2026-08-15", "2026-08-14"), ("", "2026-08-14"), (None, None), ("x", "x"), ("2026-08-14 00:00", "2026-08-14 10:00"),
    ]
    assert told(spark, cases, lambda d: sc.date_equal(d.p, d.g), "p string, g string") == [True, True, True, True, False, False, False, False, False, True]


def test_amounts(spark):
    cases = [("123.45万元", "1234500元"), ("123.45万元", "1234460元"), ("123.45万元", "1234400元"), ("约5件", "5.0"), ("约5件", "大约5"), ("", ""), (None, "1元"), ("1.2亿元", "120000000元"), ("100元", "100.01元")]
    assert told(spark, cases, lambda d: sc.amount_equal(d.p, d.g), "p string, g string") == [True, True, False, False, True, False, False, True, False]


def test_decimals_names_and_spans(spark):
    texts = [("100万元",), ("1,234.5",), ("2亿",), ("元",), ("x",), (None,), ("",), ("3 万",), ("5元",)]
    assert [None if x is None else float(x) for x in told(spark, texts, lambda d: sc.decimal_amount(d.t), "t string")] == [1_000_000, 1234.5, 200_000_000, None, None, None, None, 30_000, 5]
    names = [("a/b:c.pdf",), ("../x",), ("y" * 120,), ("",)]
    assert told(spark, names, lambda d: sc.file_name(d.t), "t string") == ["a_b_c.pdf", "_x", "y" * 100, ""]
    spans = [("ab cd", "cd"), ("ab cd", " \tcd\n"), ("ab", "x"), ("ab", ""), (None, "a"), ("ab", " ")]
    assert [x and tuple(x) for x in told(spark, spans, lambda d: sc.find_span(d.b, d.q), "b string, q string")] == [(3, 5), (3, 5), None, None, None, None]


def test_metrics_of_all_occurrences(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in scoring.m08_all_occurrences(spark, SF).collect()}
    for i, text in docs.items():
        located = matched = 0
        for n in range(3):
            quote, g = text[10 + 20 * n : 24 + 20 * n], 10 + 20 * n + (i + n) % 12
            places, at = [], text.find(quote) if quote else -1
            while at >= 0 and len(places) < 20:
                places.append(at)
                at = text.find(quote, at + len(quote))
            if places and (i + n) % 4:
                inter = [max(0, min(s + len(quote), g + 14) - max(s, g)) / (max(s + len(quote), g + 14) - min(s, g)) for s in places]
                located += 1
                matched += max(inter) >= 0.5
        assert (got[i].evidences_pred, got[i].evidences_located, got[i].evidences_matched) == (3, located, matched), i
    assert len(got) == len(docs)
    none = spark.createDataFrame([], "doc_id long, gold_status string, quotes array<array<struct<start:int,end:int>>>, gold array<struct<start:int,end:int>>")
    assert doc_metrics.evidence_metrics(none).count() == 0


def kept(times, minutes, inclusive):
    out, last = [], None
    for i, t in sorted(times, key=lambda x: (x[1], x[0])):
        gap = None if last is None else (t - last).total_seconds() - 60 * minutes
        if gap is None or gap > 0 or inclusive and gap == 0:
            out.append(i)
            last = t
    return sorted(out)


def test_dedup_windows_against_the_last_kept(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "a", base + dt.timedelta(minutes=20 * i)) for i in range(90)]
    rows += [(100 + i, "b", base + dt.timedelta(minutes=15 * (i * i % 97))) for i in range(60)] + [(200, "c", base + dt.timedelta(days=9)), (201, "c", base), (202, "c", base)]
    df = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp")
    for minutes, inclusive in ((30, False), (30, True), (15, True), (700, False)):
        got = sorted(r.event_id for r in streams.drop_repeats_batch(df, ["kind"], "event_id", minutes, inclusive).collect())
        assert got == sorted(sum((kept([(i, t) for i, k, t in rows if k == kind], minutes, inclusive) for kind in "abc"), []))
    assert sorted(r.event_id for r in streams.drop_repeats_batch(df.filter("kind = 'a'"), ["kind"], "event_id").collect())[:4] == [0, 2, 4, 6]
    assert streams.drop_repeats_batch(df.limit(0), ["kind"], "event_id").count() == 0

    # The streaming form gives the same rows, its batches in order of time.
    for n in range(3):
        part = [r for r in sorted(rows, key=lambda r: r[2]) if r[1] == "a"][30 * n : 30 * n + 30]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drop_repeats(stream, ["kind"], 30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    out.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(0, 90, 2))


def test_near_prints_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))) for b in base for _ in range(4)] + [0, 0, base[0]]
    signed = [p - (1 << 64) if p >> 63 else p for p in (p & (1 << 64) - 1 for p in prints)]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(i, j): apart(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed) if a and b and apart(a, b) <= 3}
    assert {(r.a, r.b): r.distance for r in simhash.near_pairs(df, df).collect()} == want
    first = {r.id: r.match for r in simhash.first_match(df, df).collect()}
    assert first == {i: min(j for k, j in want if k == i) for i, _ in want}


def test_whitelist_and_splits(spark):
    domains = spark.createDataFrame([("a",), ("b",)], "domain string")
    log = [("a", "decommission", "", 1), ("a", "decommission", "old", 2), ("b", "decommission", "x", 1), ("b", "recommission", None, 3), ("c", "add", None, 1), ("a", "paint", "x", 9)]
    got = {r.domain: (r.status, r.reason, r.changes) for r in whitelist.maintained(domains, spark.createDataFrame(log, "domain string, action string, reason string, at int")).collect()}
    assert got == {"a": ("decommissioned", "old", 1), "b": ("active", None, 2), "c": ("active", None, 1)}
    ids = spark.range(10)
    assert tuple(split_check(ids, ids.filter("id < 4"), ids.filter("id >= 4")).first()) == (4, 6, 0, 0, True)
    assert tuple(split_check(ids, ids.filter("id < 5"), ids.filter("id > 5")).first()) == (5, 4, 0, 1, False)
    rows = spark.createDataFrame([(i, "p" if i % 2 else "q") for i in range(9)], "id long, g string")
    assert sorted(r.id for r in newest_of_each(rows, "g", "id", 2).collect()) == [5, 6, 7, 8] and newest_of_each(rows, "g", "id").count() == 9
    assert rows.select(F.max("id")).first()[0] == 8
