"""The acceptance chain, checked responses, spans, quotes, deletions and streams against plain restatements."""

import json
import os
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.functions import tabular
from noticelake.operators import acceptance, amounts, crossverify, deletes, evidence, lineage, profiles, quotes, resampling, spans, versions
from noticelake.sources import evolving, readers, responses, selectors
from noticelake.streaming import pages, pushes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_quotes_in_order_go_through_all_levels(spark):
    """A carried place, loose levels, blank and null quotes, texts that are missing: as locate() one by one."""
    text = "项目编号：ABC-123 的 采购，预算 10 万元。Total  amount: 10 万元; again 10 万元."
    asked = ["的采购", "预算，10万元", "10 万元", "10 万元", "10万元", "ＡBC", "total amount", " ", "never there", "again", None, "Total  amount", "10 万元"]
    rows = spark.createDataFrame([(1, text, asked), (2, "", asked), (3, None, ["a"]), (4, "abcabc", ["abc", "abc"]), (5, text, [])], "id int, text string, quotes array<string>")
    got = {r.id: r.spans for r in acceptance.located_in_order(rows, "text", "quotes").collect()}
    for key, own, listed in ((1, text, asked), (2, "", asked), (3, "", ["a"]), (4, "abcabc", ["abc", "abc"]), (5, text, [])):
        at, want = 0, []
        for q in listed:
            hit = evidence.locate(own, q or "", at)
            want.append((hit[1], hit[2], hit[3], hit[5]) if hit[0] else None)
            at = hit[3] if hit[0] else at
        assert [s and tuple(s) for s in got[key]] == want
    assert {s.level for s in got[1] if s} >= {"exact", "stripped", "no_punct"}


def test_acceptance_reasons(spark):
    texts = spark.createDataFrame([(1, "Award to ACME Ltd, amount 100元, on 2024-01-02, no. ABCD-1")], "doc_id long, text string")
    row = lambda seq, name, status, raw, q: (1, seq, name, status, raw, q)
    rows = [
        row(1, "winner_name", "present", "ACME Ltd", ["ACME Ltd"]),
        row(2, "amount", "present", "100元", ["nowhere", "amount 100元"]),
        row(3, "amount", "present", "about", ["on 2024"]),
        row(4, "colour", "present", "red", ["Award"]),
        row(5, "winner_name", "absent", "x", ["Award"]),
        row(6, "winner_name", "present", None, ["Award"]),
        row(7, "winner_name", "present", "x", []),
        row(8, "winner_name", "present", "x", None),
        row(9, "winner_name", "present", "x", ["zzzz"]),
        row(10, "winner_name", "ambiguous", "x", ["ABCD"]),
        (2, 1, "winner_name", "present", "x", ["Award"]),
    ]
    proposals = spark.createDataFrame(rows, "doc_id long, seq int, field_name string, field_status string, raw_value string, quotes array<string>")
    got = acceptance.accept(texts, proposals).collect()
    assert {(r.doc_id, r.seq): r.reason for r in got} == {
        (1, 1): None, (1, 2): None, (1, 3): "invalid_value", (1, 4): "unknown_field", (1, 5): "no_value", (1, 6): "no_value",
        (1, 7): "no_quote", (1, 8): "no_quote", (1, 9): "not_located", (1, 10): "low_grade", (2, 1): "not_located",
    }
    first = next(r for r in got if r.seq == 1 and r.doc_id == 1)
    assert (first.raw_start, first.raw_end, first.evidence_text, first.context_before, first.display_grade) == (9, 17, "ACME Ltd", "Award to ", "high")
    assert acceptance.accept(texts, proposals.limit(0)).count() == 0


def test_responses(spark):
    field = {"field_name": "amount", "amount_type": "award", "raw_value": {"a": [1, "é"]}, "candidate_evidences": [{"evidence_text": "x"}]}
    whole = lambda **x: json.dumps({"fields": [field | x]}, ensure_ascii=False)
    cases = {
        None: "not_json", "": "not_json", "{": "not_json", "[1]": "missing_fields", "{}": "missing_fields", '{"fields": null}': "fields_not_list", '{"fields": []}': "fields_empty", '{"fields": [1]}': "fields[0]: not_object",
        whole(): None, f"```json\n{whole()}\n```": None, f"so: {whole()[:-2]},]}} done": None, whole(field_status=None): "fields[0]: bad_field_status", whole(field_name=3): "fields[0]: bad_field_name",
        whole(amount_type="gift"): "fields[0]: bad_amount_type", whole(amount_type=""): None, whole(candidate_evidences={}): "fields[0]: evidences_not_list",
        whole(candidate_evidences=[{"evidence_text": "x"}, {"role": "odd"}]): "fields[0]: candidate_evidences[1]: missing_evidence_text",
        whole(candidate_evidences=[{"evidence_text": "x", "role": "odd"}]): "fields[0]: candidate_evidences[0]: bad_role", whole(currency=5): None, whole(raw_value=1.5): None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, response string")
    got = {r.response: r for r in responses.checked(df).collect()}
    assert {k: r.reason for k, r in got.items()} == cases
    assert got[whole()].fields[0].raw_value == '{"a":[1,"é"]}' and got[whole()].fields[0].candidate_evidences[0].role == "primary"
    assert got[whole(raw_value=1.5)].fields[0].raw_value == "1.5"
    assert (got[whole(currency=5)].n_dropped, got[whole(currency=5)].fields) == (1, [])


def test_states_of_values(spark):
    rows = [
        ("p1", "f", "a", 1, "x", "t"), ("p1", "f", "a", 1, "x", "t"),
        ("p2", "f", "a", 1, "x", "t"), ("p2", "f", "a", 2, "y", "t"),
        ("p3", "f", "a", 1, "x", "t"), ("p3", "f", "a", 3, "y", "t"),
        ("p4", "f", "a", 1, "x", "t"), ("p4", "f", "a", 4, "x", "t"),
        ("p5", "f", "a", 1, "x", "t"), ("p5", "f", "b", 3, "x", "t"),
        ("p6", "f", "a", 1, "x", "t"), ("p6", "f", "b", 3, "x", "u"),
        (None, "f", "a", 1, "x", "t"), (None, "f", "b", 1, "x", "t"), ("", "f", "b", 1, "x", "t"), ("p7", "f", "a", 8, None, None), ("p7", "f", "b", 9, None, None),
    ]
    claims = spark.createDataFrame(rows, "project_id string, field_name string, value string, page_id long, platform string, notice_type string")
    clusters = spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long")
    got = {(r.project_id, r.value): (r.state, r.n_pages, r.n_sources) for r in crossverify.states(claims, clusters).collect()}
    assert got == {
        ("p1", "a"): ("single_source", 1, 1), ("p2", "a"): ("same_origin", 2, 1), ("p3", "a"): ("independent", 2, 2), ("p4", "a"): ("consistent_unknown", 2, 2),
        ("p5", "a"): ("conflict", 1, 1), ("p5", "b"): ("conflict", 1, 1), ("p6", "a"): ("version_difference", 1, 1), ("p6", "b"): ("version_difference", 1, 1),
        ("p7", "a"): ("conflict", 1, 1), ("p7", "b"): ("conflict", 1, 1),
    }


def test_conflicts_need_a_project(spark):
    rows = [(None, "a", "t", 1), (None, "b", "t", 2), ("", "a", "t", 3), ("", "b", "t", 4), ("p", "a", "t", 5), ("p", "b", "t", 6), ("p", "b", None, 7), ("p", None, "t", 8)]
    df = spark.createDataFrame(rows, "project string, value string, kind string, id int")
    pairs = {(r.first, r.second, r.verdict) for r in lineage.conflict_pairs(df, ["project"], "value", "id", "kind").collect()}
    assert pairs == {(5, 6, "conflict"), (5, 7, "version_diff"), (5, 8, "conflict"), (6, 8, "conflict"), (7, 8, "version_diff")}
    counts = {(r.value, r.kind): (r.n_conflicts, r.n_version_diffs) for r in lineage.conflict_counts(df, ["project"], "value", "kind").collect()}
    assert counts == {("a", "t"): (2, 1), ("b", "t"): (2, 0), ("b", None): (0, 2), (None, "t"): (2, 1)}


@pytest.mark.parametrize("width", [1, 7, 128])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(width)
    span = lambda: (lambda s: (rng.randrange(3), s, s + rng.choice((0, 1, 5, 40, -3))))(rng.randrange(200))
    left, right = [span() for _ in range(80)], [span() for _ in range(60)]
    a, b = (spark.createDataFrame(x + [(None, 1, 9), (1, None, 9)], "doc int, start int, end int") for x in (left, right))
    got = sorted(tuple(r) for r in spans.overlapping(a, b, ["doc"], width).collect())
    want = sorted({(d, s, e, x, y) for d, s, e in left for k, x, y in right if d == k and s < e and x < y and s < y and x < e})
    assert got == want
    best = spans.best_overlap(a, b, ["doc"], offset=F.lit(3), width=width).collect()
    assert len(best) == len(left) + 2
    for r in best:
        shares = [max(0, min(r.end, y + 3) - max(r.start, x + 3)) / (max(r.end, y + 3) - min(r.start, x + 3)) for k, x, y in right if k == r.doc and y > x and r.start is not None and r.end > r.start]
        assert r.iou == pytest.approx(max(shares, default=0)) and r.matched == (r.iou >= 0.5)


def test_a_hundred_thousand_spans_of_one_document(spark):
    n = 100_000
    a = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    b = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 10 + 4).alias("start"), (F.col("id") * 10 + 12).alias("end"))
    got = spans.best_overlap(a, b, ["doc"]).agg(F.count("*"), F.min("iou"), F.max("iou")).first()
    assert got[0] == n and got[1] == got[2] == pytest.approx(4 / 12)


def test_quotes_in_one_pass(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(60)))) for i in range(20)] + [(99, None), (98, ""), (None, "abab")]
    asked = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(100, "ab"), (101, "ab"), (102, ""), (103, None), (None, "a")]
    want = sorted((i, q, at) for i, t in texts for q, w in asked for at in range(len(t or "")) if i is not None and q is not None and w and t.startswith(w, at))
    docs, listed = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "quote_id long, quote string")
    for most in (4_000_000, 20):
        monkeypatch.setattr(quotes, "BLOCK_CHARS", most)
        places = quotes.all_places(docs, listed)
        assert sorted(tuple(r) for r in places.collect()) == want
    marks = [(i, at) for i in range(0, 20, 2) for at in (0, 33, None)]
    near = quotes.near_annotations(places, spark.createDataFrame(marks, "doc_id long, start int"), ["doc_id"], 4).collect()
    assert len(near) == len(want) and all(r.near == any(i == r.doc_id and at is not None and abs(at - r.start) <= 4 for i, at in marks) for r in near)
    assert quotes.all_places(docs, listed.limit(0)).count() == 0


def test_deletion_spares_what_others_link(spark):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    tables = {
        "notice_sources": make([(1, 10, "u", None), (2, 20, "x", "u"), (3, 30, None, None)], "notice_source_id long, notice_id long, source_url string, origin_url string"),
        "notice_versions": make([(1, 1), (2, 2), (3, 3), (4, None)], "id long, notice_source_id long"),
        "tenders": make([(1, "u"), (2, "v"), (3, None)], "id long, source_url string"),
        "extracted_fields": make([(1, 1), (2, 2)], "id long, tender_id long"),
        "field_evidence_links": make([(1, 100), (1, 101), (2, 101)], "field_id long, evidence_id long"),
        "evidence": make([(100, 1), (101, 1), (102, 2), (103, None)], "id long, tender_id long"),
        "users": make([(7,)], "id long"),
    }
    kept, audit = deletes.delete_closure(tables, spark.createDataFrame([("u",), (None,)], "a string"))
    assert {n: sorted(r[0] for r in df.collect()) for n, df in kept.items()} == {
        "notice_sources": [3], "notice_versions": [3, 4], "tenders": [2, 3], "extracted_fields": [2], "field_evidence_links": [2], "evidence": [101, 102, 103], "users": [7],
    }
    assert {(r.table, r.cause): (r.deleted, r.spared) for r in audit.collect()} == {
        ("notice_sources", "source_url"): (1, 0), ("notice_sources", "origin_url"): (1, 0), ("notice_versions", "notice_sources.notice_source_id"): (2, 0), ("tenders", "source_url"): (1, 0),
        ("extracted_fields", "tenders.id"): (1, 0), ("field_evidence_links", "extracted_fields.id"): (2, 0), ("evidence", "tenders.id"): (1, 1),
    }


def test_checkpoint_of_two_files_keeps_the_later_line(spark, tmp_path):
    (tmp_path / "part1.jsonl").write_text('{"id": 1, "x": 1}\n')
    (tmp_path / "part2.jsonl").write_text('{"id": 1, "x": 2}\n' + '{"id": 5, "x": 7}\n' * 2000)
    (tmp_path / "part3.jsonl").write_text('{"id": 5, "x": 8}\n')
    got = {r.id: r.x for r in readers.read_checkpoint(spark, str(tmp_path), "id int, x int", "id").collect()}
    assert got == {1: 2, 5: 8}


@pytest.mark.parametrize("cuts", [3, 8])
def test_versions_on_a_stream_do_not_depend_on_its_batches(spark, tmp_path, cuts):
    events = spark.read.parquet(f"{SF}/events.parquet").filter("user_id < 12").select("user_id", "event_type", "event_id", F.floor(F.col("value") / 50).cast("string").alias("content"), F.col("ts").cast("timestamp").alias("ts"))
    want = versions.version_chain(events, ["user_id", "event_type"], ["ts", "event_id"], "content").drop("ts")
    # Fetches up to a day out of order, cut into files; a last one, far ahead, lets all others pass.
    rows = sorted((tuple(r) for r in events.collect()), key=lambda r: r[4].timestamp() + random.Random(r[2]).uniform(0, 80_000))
    size = -(-len(rows) // cuts)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[(-1, "end", -1, "x", rows[-1][4].replace(year=2030))], [(-1, "end", -2, "x", rows[-1][4].replace(year=2031))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (name,) = [n for n in os.listdir(tmp_path / f"w{i}") if n.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"w{i}" / name, tmp_path / "in" / f"f{i:02}.parquet")
        os.utime(tmp_path / "in" / f"f{i:02}.parquet", (1_700_000_000 + i * 10,) * 2)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = pages.page_versions(stream, ["user_id", "event_type"], "event_id", "content", late="2 days")
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("user_id >= 0").select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_batch_that_fails_between_its_writes_is_pushed_once(spark, tmp_path, monkeypatch):
    schema = "subscription_id int, tender_id long, publish_time timestamp"
    batches = [[(1, 1), (1, 2), (1, 2), (2, 1)], [(1, 2), (1, 3), (None, None)], [(1, 1), (1, 4)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "subscription_id int, tender_id long").withColumn("publish_time", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for n in os.listdir(tmp_path / "in"):
            if n.endswith(".parquet") and not n.startswith("f"):
                os.rename(tmp_path / "in" / n, tmp_path / "in" / f"f{i}.parquet")
                os.utime(tmp_path / "in" / f"f{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    out, log, mark = (str(tmp_path / n) for n in ("out", "log", "mark"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "f*.parquet").parquet(str(tmp_path / "in"))
    right, failed = pushes.commit, []

    def fails_once(spark, path, log, number, ids):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost between two writes")
        right(spark, path, log, number, ids)

    monkeypatch.setattr(pushes, "commit", fails_once)
    with pytest.raises(Exception, match="lost between"):
        pushes.push_stream(stream(), out, log, mark).awaitTermination()
    assert sorted((r.subscription_id, r.tender_id) for r in pushes.pushed(spark, out, log).collect()) == [(1, 1), (1, 2), (2, 1)]
    pushes.push_stream(stream(), out, log, mark).awaitTermination()
    assert sorted((r.subscription_id, r.tender_id, r.batch) for r in pushes.pushed(spark, out, log).collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 1, 0)]


class Tree(HTMLParser):
    """A page's elements as dictionaries with their parents and texts, for well-formed markup."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.all, self.open = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.all.append({"tag": tag, "attrs": dict(attrs), "up": list(self.open), "text": []})
        if tag not in ("br", "img", "meta"):
            self.open.append(self.all[-1])

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if not self.open or self.open[-1]["tag"] not in ("script", "style"):
            for e in self.open:
                e["text"].append(data)


def test_items_by_selectors_equal_a_tree(spark):
    """The navigation of all pages, by html.parser."""
    pages_ = spark.read.parquet(f"{SF}/pages.parquet")
    want = []
    for p in pages_.collect():
        tree = Tree(p.html)
        lis = [e for e in tree.all if e["tag"] == "li" and e["up"] and e["up"][-1]["tag"] == "ul" and any(u["tag"] == "nav" for u in e["up"])]
        for n, li in enumerate(lis):
            a = next((e for e in tree.all if e["tag"] == "a" and any(u is li for u in e["up"])), None)
            root = "/".join(p.url.split("/")[:3])
            want.append((p.page_id, n, " ".join("".join(a["text"]).split()), root + a["attrs"]["href"]))
    assert want and sorted(tuple(r) for r in selectors.scrape(pages_, selectors.NAVIGATION).collect()) == sorted(want)


def test_selectors_on_odd_markup(spark):
    page = (
        "<div id=main class='a b'><ul class=list><li>One <a href='/x?a=1&amp;b=2'>go  <b>now</b></a> <span class=time>2024</span><li data-k=\"v1\"><!-- <a href=no> --><p class='date area'>T</p><a>none</a>"
        "</ul><ul><li>out</li></ul><script>'<li>'</script></div><ul class=bid-list><li><a HREF=http://y/z>far</a><img src=q><i>é&lt;</i></li></ul><p>tail"
    )
    df = spark.createDataFrame([(1, "https://h.org:8/p/q", page), (2, "u", None), (3, "u", ""), (4, "u", "no markup <")], "page_id int, url string, html string")
    got = sorted(tuple(r) for r in selectors.scrape(df, selectors.NOTICE_LIST).select("page_id", "item", "title", "publish_time", "location", "detail_url", "content").collect())
    assert got == [(1, 0, "go now", "2024", None, "https://h.org:8/x?a=1&b=2", None), (1, 1, "none", "T", "T", None, "T"), (1, 2, "far", None, None, "http://y/z", None)]
    own = {"first": "#main .list > li", "second": "li[data-k^=v] a", "any": "ul.none, i", "star": "div > *", "has": "[data-k]", "end": "p"}
    single = selectors.Template("own", own)
    rows = {r.page_id: r for r in selectors.scrape(df, single).collect()}
    assert tuple(rows[1])[2:] == ("One go now 2024", "none", "é<", "One go now 2024Tnone", "Tnone", "T")
    assert rows[4].first is None and set(rows) == {1, 4}
    for bad in ("", "a >> (", "li:hover"):
        with pytest.raises(ValueError, match="not understood"):
            selectors.compiled(bad)
    assert {"navigation", "notice_list", "article"} <= set(selectors.template_names()) and selectors.template("Navigation") is selectors.NAVIGATION


def test_resampling_draws_exactly_and_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", float(rng.integers(0, 10)), float(rng.integers(1, 12))) for i in range(60) for _ in range(int(rng.integers(1, 5)))] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "project string, x double, y double")
    for block in (4096, 7):
        parts = resampling.weighted_sums(df, "project", "x", "y", 50, 3, block)
        assert {r.w for r in parts.groupBy("replicate").agg(F.sum("weight").alias("w")).collect()} == {60}
    again = resampling.interval(df.repartition(7), "project", "x", "y", 400, 3, block=7).first()
    assert again == resampling.interval(df.coalesce(1), "project", "x", "y", 400, 3, block=7).first() and again.n_draws == 60
    sums = {}
    for p, x, y in rows[:-1]:
        a, b = sums.get(p, (0, 0))
        sums[p] = (a + x, b + y)
    flat = np.array(list(sums.values()))
    drawn = flat[rng.integers(0, 60, size=(4000, 60))].sum(axis=1)
    ratios = np.sort(drawn[:, 0] / drawn[:, 1])
    for linear in (False, True):
        got = resampling.interval(df, "project", "x", "y", 1000, 5, linear)
        low, high = got.first().low, got.first().high
        width = ratios[3899] - ratios[100]
        assert got.first().point == pytest.approx(flat[:, 0].sum() / flat[:, 1].sum())
        assert abs(low - ratios[100]) < 0.15 * width and abs(high - ratios[3899]) < 0.15 * width
    with pytest.raises(ValueError, match="two projects"):
        resampling.interval(df.filter("project = 'p1'"), "project", "x", "y")


def test_table_functions_on_odd_rows(spark):
    tabular.register(spark)
    df = spark.createDataFrame([(1, "aaaa 5元 5元 1%", "x"), (2, None, "y"), (3, "", None)], "id int, text string, fact_of string")
    got = spark.sql("SELECT id, o.number, o.start FROM {d}, LATERAL occurrences(text, 'aa', 1) AS o", d=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0)]
    got = spark.sql("SELECT * FROM facts(TABLE(SELECT * FROM {d}) PARTITION BY (id), 'text')", d=df)
    assert got.columns == ["id", "fact_of", "category", "fact"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", "百分比", "1%"), (1, "x", "金额", "5元")]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM facts(TABLE(SELECT * FROM {d}), 'nothing')", d=df).collect()


def test_batches_that_do_not_widen_are_an_error(spark, tmp_path):
    columns = [evolving.Added("id", "bigint"), evolving.Added("n", "int", 7, 2)]
    spark.createDataFrame([(1,)], "id int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 5), (3, None)], "id long, n short").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(4, 5)], "id long, n long").write.parquet(str(tmp_path / "c"))
    got = evolving.read_evolving(spark, [str(tmp_path / n) for n in "ab"], columns)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 1), (2, 5, 2), (3, None, 2)] and got.dtypes == [("id", "bigint"), ("n", "int"), ("schema_version", "int")]
    with pytest.raises(TypeError, match="n: bigint does not widen to int"):
        evolving.read_evolving(spark, [str(tmp_path / n) for n in "abc"], columns)
    assert evolving.read_evolving(spark, [], columns).count() == 0


def test_amounts_in_full(spark):
    rows = [
        ("1,234.50元", "award"), ("0.0769040（万元）", None), ("（人民币）5万", None), ("0", "unknown"), (None, "award"), (" ", None), ("5元", "gift"), ("5 bananas", None), ("€7亿", "其他"), ("12元（含税）", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, raw string, kind string")
    got = {r.id: r.a for r in amounts.validated(df, "raw", "kind", name="a").collect()}
    assert [(got[i].valid, got[i].error) for i in range(10)] == [
        (True, None), (True, None), (True, None), (True, None), (False, "empty"), (False, "empty"), (False, "bad_type"), (False, "bad_format"), (True, None), (True, None),
    ]
    assert (got[0].value, got[0].normalized, got[0].amount_type, got[0].derivation_rule) == (1234.5, "1234.50元", "award", None)
    assert got[1].value == pytest.approx(769.04) and got[1].derivation_rule == "括号单位展开: '（万元）' → '万元' | 0.076904万 × 10^4 = 769.04元"
    assert (got[3].warnings, got[3].derivation_rule, got[8].currency, got[9].derivation_rule) == (["zero_amount"], "amount_type=unknown→None", "EUR", "剥离后缀: '（含税）'")


def test_profiles_of_odd_rows(spark):
    rows = [("w", "p1", None, "r", 1.5, "2024-01-02"), ("w", "p2", "", "r", None, "2024-01-01"), ("w", "p2", "a", None, 2.0, None), (None, "p", "a", "r", 1.0, "2024-01-01"), ("", "p", "a", "r", 1.0, "2024-01-01"), ("v", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "winner string, purchaser string, agency string, region string, win_amount double, win_date string")
    got = {r.winner: r for r in profiles.supplier_profiles(df).collect()}
    assert tuple(got["w"])[1:] == (3, 3.5, "2024-01-01", "2024-01-02", ["p2", "p1"], ["a"], ["r"])
    assert set(got) == {"w", "v"} and tuple(got["v"])[1:5] == (1, 0.0, None, None)
    sums = profiles.role_sums({"winner": (df, "winner", "win_amount"), "purchaser": (df, "purchaser", "win_amount")})
    assert {r.organisation: (r.n_winner, r.amount_winner, r.n_purchaser, r.total) for r in sums.collect()} == {"w": (3, 3.5, 0, 3.5), "v": (1, 0.0, 0, 0.0), "p1": (0, 0.0, 1, 1.5), "p2": (0, 0.0, 2, 2.0), "p": (0, 0.0, 2, 2.0)}


def test_schedules_far_from_the_last_run():
    from datetime import datetime

    from noticelake.functions.schedules import due

    at = datetime(2024, 3, 1)
    assert due("0 9 29 2 *", at, datetime(2028, 3, 1)) and due("0 9 29 2 *", at, datetime(2028, 2, 29, 9)) and not due("0 9 29 2 *", at, datetime(2028, 2, 29, 8, 59))
    assert not due("0 9 30 2 *", at, datetime(2060, 1, 1)) and due("*/5 * * * *", at, datetime(2024, 3, 1, 0, 5)) and not due("0 0 * * *", at, datetime(2024, 3, 1, 23))
