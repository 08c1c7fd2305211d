"""Rows that only larger tables hold, and work that must not grow faster than its input."""

import datetime as dt
import random
import tracemalloc
from collections import Counter
from hashlib import md5

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from noticelake.functions import text as tx
from noticelake.operators import evidence, lineage, quotes, simhash, sync
from noticelake.plans import registry, whole
from noticelake.sources import scratch


def as_stated(spark, tmp_path, name, tables):
    """A query's rows over ``tables`` (name: rows and schema), which have to be those of its SQL."""
    db = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    rows = got.collect()
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in rows) == Counter(want.fetchall())
    return rows


def test_values_on_every_day(spark, tmp_path):
    days = (dt.datetime(1999, 1, 1), dt.datetime(1998, 2, 2), dt.datetime(1998, 2, 1), dt.datetime(1997, 12, 31))
    rows = [(12 * i + k, day, "1-URGENT") for i, day in enumerate(days) for k in range(12)]
    got = as_stated(spark, tmp_path, "v10_value_correct", {"orders": (rows, "o_orderkey long, o_orderdate timestamp, o_orderpriority string")})
    assert len(got) == 48


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_a_batch_of_long_texts_is_normalised_piece_by_piece():
    texts = pa.array(["Some words of a Text, " * 500] * 400)  # 4.4 million characters
    run = tx.normalize_text().func
    sizes = []
    assert peak_mb(lambda: sizes.extend(len(piece) for piece in run(iter([texts])))) < 60
    assert sum(sizes) == 400 and len(sizes) > 5
    assert [len(p) for p in tx.held(iter([pa.array(["a" * 10, None, "b" * 100, "c", ""])]), 12)] == [2, 1, 2]


def test_places_of_an_index_take_four_bytes():
    text = "Some words of a text - " * 20_000
    evidence.index.cache_clear()
    assert evidence.locate(text, "words of")[1] == "exact" and peak_mb(lambda: evidence.locate(text, "NOT THERE AT ALL")) < 25
    there = evidence.index("a b,  C")
    assert (there.solid, there.bare) == ("ab,c", "abc") and there.solid_at.tolist() == [0, 2, 3, 5] and there.bare_at.tolist() == [0, 2, 5]


def test_fingerprints_keep_no_array_for_a_token():
    text = "".join(chr(0x4E00 + i * i % 20_000) for i in range(30_000))
    simhash.token_hash.cache_clear()
    assert peak_mb(lambda: simhash.simhash_of(text)) < 18
    counts = Counter(text[i : i + 2] for i in range(len(text) - 1))
    votes = [0] * 64
    for gram, n in counts.items():
        h = int.from_bytes(md5(gram.encode()).digest()[:8], "big")
        votes = [v + (n if h >> i & 1 else -n) for i, v in enumerate(votes)]
    assert simhash.simhash_of(text) % 2**64 == sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written, stored = [], scratch.stored
    monkeypatch.setattr(scratch, "stored", lambda df: written.append(1) or stored(df))
    ids = [i * 7919 % 1009 + 5 for i in range(1009)]  # in no order along the chain
    pairs = list(zip(ids, ids[1:], strict=False)) + [(2000, 2001), (3000, 3000), (None, 4000), (2001, None)]
    got = {r.id: r.cluster for r in lineage.repost_clusters(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, min(ids)), 2000: 2000, 2001: 2000, 3000: 3000}
    assert len(written) < 45


def test_snapshots_of_pages_that_share_an_address(spark, tmp_path):
    rows = [(0, "http://a/1", "x"), (1, "http://a/1", "y"), (2, "http://a/1", "z"), (3, "http://a/1", "x"), (4, "http://a/2", ""), (6, "http://a/2", "v")]
    got = as_stated(spark, tmp_path, "snk05_changed_pages", {"pages": (rows, "page_id long, url string, html string")})
    assert len(got) == 5
    latest = spark.createDataFrame([("u", "old", 1), ("u", "older", 0)], "url string, content_hash string, version long")
    new = sync.new_snapshots(spark.createDataFrame([("u", "a"), ("u", "b")], "url string, html string"), latest)
    assert sorted(r.version for r in new.collect()) == [2, 3]


def test_no_table_of_organisations_is_broadcast(spark):
    plan = registry.QUERIES["j08_resolve_near"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_pages_carry_no_texts(spark, tmp_path, monkeypatch):
    body = "The purchaser invites tenders for the supply of desks and chairs, delivery within sixty days of the award. " * 200
    html = lambda said: f"<html><title>Desks</title><body><p>{said}{body}</p></body></html>"
    rows = [(i, f"http://h{i}.org/", html("文章来源：x " if i == 3 else "")) for i in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    kept, stored = [], scratch.stored
    monkeypatch.setattr(whole, "stored", lambda df: kept.append(stored(df)) or kept[-1], raising=False)
    got = {(r.a, r.b): r.verdict for r in whole.l06_reposts_whole(spark, str(tmp_path)).collect()}
    assert len(got) == 66 and {p for p, v in got.items() if v == "same_source_repost"} == {p for p in got if 3 in p}
    assert len(kept) == 1 and kept[0].agg(F.max(F.length(F.to_json("x")))).first()[0] < 400


def test_participants_of_co_occurrence_are_made_once(spark):
    plan = registry.QUERIES["s06_cooccurrence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan


SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unbroadcast(spark, make):
    """The plan of a query where no table is small enough to be broadcast."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_line_items_meet_their_orders_without_a_sort(spark):
    for name in ("w04_topk", "a34_most_common"):
        plan = unbroadcast(spark, lambda: registry.QUERIES[name](spark, SMALL))  # noqa: B023
        assert "Sort [l_orderkey" not in plan and "ShuffledHashJoin [l_orderkey" in plan
        assert plan.count("hashpartitioning(l_orderkey") == 1 and plan.count("hashpartitioning(o_custkey") == 1


def test_profiles_shuffle_line_items_whatever_their_number(spark, tmp_path):
    plan = plan_of(registry.QUERIES["a16_full_profile"](spark, SMALL))  # small enough for Spark to broadcast the orders
    assert plan.count("ShuffledHashJoin [l_orderkey") == 2 and "BroadcastHashJoin [l_orderkey" not in plan
    plan = unbroadcast(spark, lambda: registry.QUERIES["a16_full_profile"](spark, SMALL))
    assert plan.count("hashpartitioning(l_orderkey") == 2 and "Sort [l_orderkey" not in plan
    day = dt.datetime(1999, 5, 6)
    items = [(k, line, k % 4, k + line / 4, day + dt.timedelta(k)) for k in range(40) for line in range(9)] + [(1, 9, 1, None, None), (1, 10, None, 1.0, day), (None, 1, 1, 1.0, day), (99, 1, 1, 1.0, day)]
    tables = {
        "lineitem": (items, "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_shipdate timestamp_ntz"),
        "orders": ([(k, k % 13 if k != 7 else None) for k in range(39)], "o_orderkey long, o_custkey long"),
        "customer": ([(c, ["", None, "a", "same", "same"][c] if c < 5 else f"c{c}", c % 3) for c in range(12)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(0, "x"), (1, None)], "n_nationkey int, n_name string"),
        "supplier": ([(0, "one"), (1, "two"), (2, "one")], "s_suppkey long, s_name string"),
    }
    got = {r.winner: r for r in as_stated(spark, tmp_path, "a16_full_profile", tables)}
    assert set(got) == {"one", "two"} and got["one"].purchaser.startswith("same,")


def test_fields_of_tenders_are_counted_without_a_sort(spark):
    fields = spark.createDataFrame(
        [(1, "winner_name", "present", True, "a"), (1, "winner_name", "present", True, "a"), (1, "project_identifier", "present", True, "b"), (2, "purchaser_name", "present", True, " "), (3, "winner_name", "present", True, "c"), (None, "winner_name", "present", True, "d")],
        "tender_id long, field_name string, field_status string, is_current boolean, raw_value string",
    )
    tenders = spark.createDataFrame([(1, "u"), (1, "u"), (2, ""), (4, None)], "tender_id long, source_url string")
    known = spark.createDataFrame([("x",)], "source_url string")
    made = sync.migration_counters(tenders, known, fields)
    assert made.first().asDict() == {"total": 4, "migrated": 3, "skipped": 1, "participants": 2, "identifiers": 1}
    assert sync.migration_counters(tenders, known, fields.limit(0)).first().participants == 0
    plan = unbroadcast(spark, lambda: registry.QUERIES["l12_migration_counters"](spark, SMALL))
    assert plan.index("LeftSemi") < plan.index("HashAggregate(keys=[tender_id") < plan.index("Generate")


def test_what_a_batch_adds_is_found_without_a_sort(spark):
    fields = spark.createDataFrame(
        [(1, "winner_name", "present", True, " a "), (1, "winner_name", "present", True, "a"), (1, "purchaser_name", "present", True, "b"), (2, "winner_name", "present", True, "c"), (3, "winner_name", "present", True, "d"), (1, "project_identifier", "present", True, "k"), (2, "project_identifier", "present", True, "k")],
        "tender_id long, field_name string, field_status string, is_current boolean, raw_value string",
    )
    chain = spark.createDataFrame([(1, 10, 5), (2, 20, None), (2, None, 6), (None, 30, 7)], "tender_id long, notice_id long, project_id long")
    known = spark.createDataFrame([(10, "b", "purchaser"), (20, "c", "purchaser"), (20, None, "winner"), (99, "z", "winner")], "notice_id long, organisation string, role string")
    got = sync.participants(fields, chain, known)
    assert {tuple(r) for r in got.collect()} == {(10, "a", "winner"), (20, "c", "winner"), (None, "c", "winner")}
    ids = sync.identifiers(fields, chain, spark.createDataFrame([(5, "k"), (None, "k")], "project_id long, raw_value string"))
    assert sorted(map(tuple, ids.collect()), key=str) == [(6, "k"), (None, "k")]
    for name in ("l11_participants", "l11_identifiers"):
        plan = unbroadcast(spark, lambda: registry.QUERIES[name](spark, SMALL))  # noqa: B023
        assert "LeftAnti" not in plan and plan.count("ShuffledHashJoin") == 2 and "Sort [tender_id" not in plan


def test_documents_and_pages_are_read_once_for_all_joins(spark):
    for name in ("d01_ingest_verdict", "d02_greedy_dedup", "j06_simhash_band_join", "j07_repost_candidates", "l04_combined_lineage"):
        plan = plan_of(registry.QUERIES[name](spark, SMALL))
        assert "documents.parquet" not in plan and "pages.parquet" not in plan and "ArrowEvalPython" not in plan


def test_places_are_made_once_and_found_as_by_hand(spark, monkeypatch):
    draw, letters = random.Random(5), "ab\U0001f600"
    texts = ["".join(draw.choices(letters, k=n)) for n in (0, 1, 2, 7, 8, 9, 40, 333)]
    words = sorted({"".join(draw.choices(letters, k=n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17) for _ in range(4)})
    monkeypatch.setattr(quotes, "PIECE", 13)
    windows = quotes.Windows(words)
    for t in texts:
        assert sorted(windows.places(t)) == sorted((k, i) for k, w in enumerate(words) for i in range(len(t)) if t.startswith(w, i))
    assert list(quotes.Windows([]).places("ab")) == []
    monkeypatch.setattr(quotes, "PIECE", 250_000)
    long = "words of a text, " * 60_000
    assert peak_mb(lambda: list(windows.places(long[:1_000_000]))) < 40
    assert plan_of(registry.QUERIES["x04_quotes_near"](spark, SMALL)).count("MapInPandas") == 1


def test_only_texts_that_hold_the_quote_go_to_python(spark, tmp_path):
    from noticelake.plans.domain import LICENSE

    rows = [(1, LICENSE + "x" + LICENSE), (2, "none"), (3, None), (4, ""), (5, "\U0001f600" + LICENSE)]
    got = as_stated(spark, tmp_path, "e08_lateral_occurrences", {"documents": (rows, "doc_id long, text string")})
    assert {(r.doc_id, r.number, r.start) for r in got} == {(1, 0, 0), (1, 1, len(LICENSE) + 1), (5, 0, 1)}
    below = plan_of(registry.QUERIES["e08_lateral_occurrences"](spark, SMALL)).split("UDTF")[-1]
    assert "Contains(text" in below or "contains(text" in below.lower()


def test_pairs_of_large_groups_come_from_lists(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(63) | 1 << 20 for _ in range(3)]
    rows = [(i, base[0]) for i in range(300)] + [(i % 7, base[0] ^ 3) for i in range(400, 480)] + [(600 + i, base[0] ^ 1 << i % 4) for i in range(8)] + [(700, base[1]), (701, base[1] ^ 7), (702, base[2]), (703, 0), (704, 0)]
    met = simhash.near_lists(spark.createDataFrame(rows, "id long, simhash long"), F.struct("id", "simhash")).collect()
    got = Counter()
    for m in met:
        assert all((x.simhash ^ y.simhash).bit_count() == m.distance for x in m.l for y in m.r)
        got.update(tuple(sorted((x, y))) for i, x in enumerate(m.l) for k, y in enumerate(m.r) if not m.same or i < k)
    items = sorted(r for r in rows if r[1])
    want = Counter((x, y) for i, x in enumerate(items) for y in items[i + 1 :] if (x[1] ^ y[1]).bit_count() <= 3)
    assert got == want and len(met) < 120 and max(len(m.l) for m in met) < 3 * simhash.LIST


def test_verdicts_on_pages_told_once(spark):
    draw = random.Random(8)
    hosts, texts, titles = (None, "", "a.org", "w.a.org", "b.org"), (None, "", " ", "x", "x 转自 y", "原文链接", "来源：z"), (None, "", " ", "a", "ab", " desks and chairs", "desks and chair", "tables and chairs", "aaaa", "\U0001f600\U0001f601x", "\U0001f600\U0001f601y")
    page = lambda: (draw.choice(hosts), draw.choice(texts), None, None, draw.choice(titles), draw.choice((0, 1, 31)), None, None, draw.choice((None, [], ["d.pdf"], ["e.pdf", "d.pdf"])))
    kind = "struct<host:string,content:string,identifier:string,notice_type:string,title:string,simhash:bigint,publisher:string,published:string,links:array<string>>"
    pages = spark.createDataFrame([(page(), page()) for _ in range(3000)], f"l {kind}, r {kind}")
    told = pages.select(lineage.repost_verdict(lineage.repost_features("l", "r")).alias("want"), lineage.told_verdict(lineage.repost_told("l"), lineage.repost_told("r")).alias("got"))
    assert told.filter("want <> got or got is null").isEmpty() and told.select("got").distinct().count() == 3


def test_pages_meet_in_lists_and_not_by_pairs(spark, tmp_path):
    body = "The purchaser invites tenders for the supply of desks and chairs, delivery within sixty days of the award. "
    html = lambda t, said="": f"<html><title>{t}</title><body><p>{body * 3}{said}</p></body></html>"
    rows = [(i, f"http://h{i % 3}.org/{i}", html(f"Desks {i % 2}" if i % 5 else "Other things")) for i in range(150)] + [(7, "http://h1.org/", html("Desks 1")), (None, "http://h1.org/", html("Desks 1")), (151, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = whole.l06_reposts_whole(spark, str(tmp_path))
    got = Counter(map(tuple, found.collect()))
    title = lambda r: r[2][13:].split("<")[0]
    verdict = lambda r, q: "same_source_repost" if r[1][7:9] == q[1][7:9] and (title(r) == title(q) or "Other things" not in (title(r), title(q))) else "independent"
    of = {}
    for r in rows[:151]:
        of.setdefault(r[0], []).append(r)
    # Each two rows that are near stand for all rows of their pages.
    want = Counter((a, b, verdict(r, q)) for a in of for b in of if a < b for _ in of[a] for _ in of[b] for r in of[a] for q in of[b])
    assert got == want
    above = plan_of(found).split("Generate explode(r")[0]
    assert "Join" not in above and "Exchange" not in above


def copies():
    """Documents in groups of copies larger than a list, near copies, and such as have no fingerprint or no id."""
    words = [f"notice {k} of the tender for {w}, delivery within sixty days of the award" for k, w in enumerate(("desks", "chairs", "lamps and carpets of the library"))]
    docs = [words[0]] * 150 + [words[0] + "s"] * 90 + [words[1]] * 3 + [words[2], words[2][:-1], "", None]
    return [(i * 37 % 1009, t) for i, t in enumerate(docs)] + [(None, words[0])]


def test_pairs_of_near_texts_are_made_last(spark, tmp_path):
    got = as_stated(spark, tmp_path, "j06_simhash_band_join", {"documents": ([r for r in copies() if r[0] is not None], "doc_id long, text string")})
    assert len(got) >= 150 * 149 // 2 + 90 * 89 // 2 and all(r.a < r.b for r in got)
    rows = [(5, 7), (5, 7), (6, 7), (None, 7), (5, 6), (8, 7 << 40), (9, 0)]
    assert Counter(map(tuple, simhash.near_rows(spark.createDataFrame(rows, "id long, simhash long")).collect())) == {(5, 6, 0): 2, (5, 6, 1): 1}
    above = plan_of(registry.QUERIES["j06_simhash_band_join"](spark, SMALL)).split("Generate explode(r")[0]
    assert "Join" not in above and "Exchange" not in above


def test_earlier_texts_of_each_text_are_paired_last(spark, tmp_path):
    got = as_stated(spark, tmp_path, "j07_repost_candidates", {"documents": (copies(), "doc_id long, text string")})
    assert len(got) >= 150 * 149 // 2 + 90 * 89 // 2 and all(r.b < r.a for r in got)
    above = plan_of(registry.QUERIES["j07_repost_candidates"](spark, SMALL)).split("Generate explode(r")[0]
    assert "Join" not in above and "Exchange" not in above
