"""Golden vectors of the text and value functions, and restatements in plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticelake.functions import text as tx
from noticelake.functions import values as v
from noticelake.functions.notice_text import fields
from noticelake.operators import evidence as ev
from noticelake.operators import lineage, metrics


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "100元": 100.0, "100万元": 1e6, "1.5亿元": 1.5e8, "100.50万元": 1005000.0, "￥100万元": 1e6, "人民币100万元": 1e6, "100.00 万元": 1e6, "0.0769040（万元）": 769.04,
        "中标（成交）金额：人民币1,234.5元": 1234.5, "abc": None, "": None, None: None, "0元": 0.0,
    }
    got = column(spark, list(cases), v.validate_amount)
    assert [g.value for g in got] == [pytest.approx(x) if x is not None else None for x in cases.values()]
    assert [g.valid for g in got] == [x is not None for x in cases.values()]
    dollars, euros = column(spark, ["$100万元", "美元100"], v.validate_amount)
    assert dollars.currency == "USD" and euros.currency == "CNY"
    lots = spark.createDataFrame([("200万元", ["100万元", "100万元"]), ("200万元", ["100万元", "150万元"]), ("200万元", ["x", "100万元"])], "t string, l array<string>")
    verdicts = [r.y for r in lots.select(v.lots_verdict(F.col("t"), F.col("l")).alias("y")).collect()]
    assert [(x.valid, x.differs) for x in verdicts][:2] == [(True, False), (True, True)] and not verdicts[2].valid


def test_dates(spark):
    cases = {
        "2026年7月15日": "2026-07-15", "2026-07-15": "2026-07-15", "2026.7.15": "2026-07-15", "2026年7月15日 09:00": "2026-07-15 09:00", "2026-07-15 14:30": "2026-07-15 14:30",
        "2026年8月6日09时05分": "2026-08-06 09:05", "2026/7/15": None, "2026-02-29": "2026-02-29", "2026-02-30": None, "2026年8月10日（原8月1日）": "2026-08-10", "2026-13-01": None, None: None, "": None,
    }
    assert [g.normalized for g in column(spark, list(cases), v.validate_date)] == list(cases.values())


def test_identifiers(spark):
    cases = {
        "ZFCG2026001": "ZFCG2026001", "ZFCG-2026-001": "ZFCG-2026-001", "zfcg2026001": "ZFCG2026001", "ＺＦＣＧ２０２６００１": "ZFCG2026001", "ZFCG 2026 001": "ZFCG2026001",
        "11000026210200173767-XM001": "11000026210200173767-XM001", "ABC": None, "": None, None: None, "ZFCG@2026": None, "ZPDL(2026)77": "ZPDL77",
        "XNJZ-G-2026-010、TLYQ2026-06080": "XNJZ-G-2026-010", "招服2026A00052（招标编号：0773-2641GNSHFWGK1900）": "0773-2641GNSHFWGK1900",
    }
    assert [g.normalized for g in column(spark, list(cases), v.validate_identifier)] == list(cases.values())


def test_tolerances_names_and_numbers(spark):
    shown = [("0.01万元", 50.0), ("1元", 0.5), ("0.001亿元", 50000.0), ("1万元", 5000.0), ("1美元", None)]
    assert column(spark, [s for s, _ in shown], lambda c: v.precision_tolerance(c, F.lit(""))) == [t for _, t in shown]
    units = [("万美元", 50.0), ("亿元", 500000.0), ("美元", None), ("元", 0.005)]
    assert column(spark, [u for u, _ in units], lambda c: v.precision_tolerance(F.lit(None).cast("string"), c)) == [t for _, t in units]
    assert column(spark, ["某某股份有限公司", "某某•公司", "某某・公司", "", None, "甲（上海）公司"], v.org_name) == ["某某股份有限公司", "某某·公司", "某某·公司", "", "", "甲公司"]
    assert column(spark, ["市教育局", "第一医院", "某某公司", "行业协会", "张三", None], v.org_type) == ["government", "institution", "enterprise", "social_org", "unknown", "unknown"]
    assert [v.time_range_days(x) for x in ("7天", "最近3个月", "1年", "30d", "15", "", None)] == [7, 90, 365, 30, 15, None, None]
    parsed = column(spark, ["2026-7-5 9:05:01", "2026/7/5", "2026年7月5日", "2026.7.5", "x"], lambda c: F.date_format(v.parse_timestamp(c), "yyyy-MM-dd"))
    assert parsed == ["2026-07-05"] * 4 + [None]


def test_notice_fields(spark):
    text = "采购单位大连海事大学行政区域辽宁省公告时间2026年08月05日 15:57 其他 总中标金额￥63.860000 万元 项目编号：GHHX2026000062"
    got = column(spark, [text], lambda c: fields(c, F.lit("某项目中标公告")))[0]
    assert (got.tender_org.value, got.location.value, got.publish_time.value) == ("大连海事大学", "辽宁省", "2026年08月05日 15:57")
    assert got.win_amount == pytest.approx(638600) and got.bid_number.value == "GHHX2026000062" and got.notice_type == "award"
    assert "GHHX2026000062" in got.bid_number.evidence


def test_normalize_vectors():
    n = tx.normalize
    assert n("") == tx.Normalized("", [], []) and n("hello world").text == "hello world" and n("ABCDEF123").text == "abcdef123"
    assert n("a　b").text == "a b" and "12345" in n("金额：１２３４５元").text and "abc123" in n("编号：ＡＢＣ１２３").text
    assert n("  a \t b  \n  c ").text == "a b\nc"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB 　\t\nＡ１ﬁ①é中。\r", max_size=40))
def test_normalize_maps(raw):
    n = tx.normalize(raw)
    assert len(n.forward) == len(n.text) and len(n.reverse) == len(raw) and n.forward == sorted(n.forward)
    assert tx.normalize(n.text).text == n.text
    for i, at in enumerate(n.forward):
        if n.text[i] != " ":
            assert 0 <= n.reverse[at] <= i
    if n.text:
        assert n.to_raw(0, len(n.text)) == (n.forward[0], n.forward[-1] + 1)


def test_normalize_lite_agrees_on_plain_text(spark):
    texts = ["  A b\t c \n d  ", "ＡＢ　１２", "x"]
    assert column(spark, texts, tx.normalize_lite) == [tx.normalize(t).text for t in texts]


def test_locate_levels():
    level = lambda raw, q, **k: ev.locate(raw, q, **k)[1]
    assert level("中标    金额   100万元", "中标金额100万元") == "stripped" and level("中标金额100万元", "中标  金额  100万元") == "stripped"
    assert level("中标\n金额\n100万元", "中标金额100万元") == "stripped" and level("金额：100万元", "金额:100万元") in ("no_punct", "stripped")
    assert not ev.locate("hello world", "a b c", levels=("substring",))[0] and not ev.locate("x", "")[0]
    assert level("abc123 body", "ABC 123", levels=("exact", "stripped", "no_punct")) == "not_found"
    found = ev.locate("one two one", "one", 1)
    assert found[2:4] == (8, 11) and found[5:7] == (1.0, "direct")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1。,\nＡ", max_size=30), st.integers(0, 10), st.integers(1, 8))
def test_a_slice_is_found_where_it_first_stands(raw, at, size):
    quote = raw[at : at + size]
    found, level, start, end, text, *_ = ev.locate(raw, quote)
    if quote.strip():
        assert found and level == "exact" and (start, text) == (raw.find(quote), quote) and end == start + len(quote)


def test_native_spans_and_batches(spark):
    rows = [("a.b a.b a.b", "a.b"), ("aaa", "aa"), ("x", "y"), ("", ""), ("a😀中b中", "中")]
    df = spark.createDataFrame(rows, "t string, q string")
    for r in df.select("t", "q", ev.exact_spans(F.col("t"), F.col("q")).alias("s"), ev.occurrences(F.col("t"), F.col("q")).alias("o")).collect():
        assert r.s.start == (r.t.find(r.q) if r.q else -1)
        assert r.o == ([m.start() for m in re.finditer(re.escape(r.q), r.t)] if r.q else [])
    batch = spark.createDataFrame([("one two one", ["one", "one", "none"])], "t string, q array<string>")
    assert [x.start for x in batch.select(ev.locate_batch_column()("t", "q").alias("l")).first().l] == [0, 8, -1]


def test_set_scores(spark):
    rows = [("ab", "ab", 1, 1, 1), ("abc", "bcd", 2 / 3, 2 / 3, 2 / 3), ("abc", "a", 1, 1 / 3, 0.5), ("a", "abc", 1 / 3, 1, 0.5), ("", "", 1, 1, 1), ("a", "", 0, 0, 0), ("", "a", 0, 1, 0)]
    df = spark.createDataFrame([(list(g), list(p), i) for i, (g, p, *_) in enumerate(rows)], "g array<string>, p array<string>, i int")
    got = [r.s for r in df.orderBy("i").select(metrics.set_scores(F.col("g"), F.col("p")).alias("s")).collect()]
    assert [(x.precision, x.recall, x.f1) for x in got] == [pytest.approx(r[2:]) for r in rows]


def test_roles_and_grades(spark):
    rows = [("bidcenter.com.cn", "公告正文内容足够长一点点吧"), ("other.com", "公告正文内容 文章来源 某网站"), ("other.com", "公告正文内容没有任何标记吧"), ("", "x"), ("shanghai.gov.cn", "项目编号"), ("ggzy.gov.cn", "转载自别处")]
    df = spark.createDataFrame(rows, "h string, c string")
    roles = [r.r for r in df.select(lineage.source_role(F.col("h"), F.col("c")).alias("r")).collect()]
    assert roles == ["commercial_repost", "commercial_repost", "unknown", "unknown", "official_original", "official_repost"]
    cases = [("direct", "official_original", "present", "high"), ("inferred", "official_original", "present", "review"), ("direct", "commercial_repost", "present", "review"), ("unsupported", "official_original", "present", "low"), ("direct", "unknown", "present", "low"), ("direct", "official_original", "absent", "low"), ("direct", "official_original", "missing", "high"), (None, None, None, "low")]
    df = spark.createDataFrame(cases, "a string, b string, c string, want string")
    assert all(r.got == r.want for r in df.select("want", lineage.display_grade(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect())


def test_lenient_json(spark):
    texts = ['{"k": 1}', '```json\n{"k": 2,}\n```', 'note {"k": 3} end', "none", None]
    assert [x and x.k for x in column(spark, texts, lambda c: v.lenient_json(c, "k int"))] == [1, 2, 3, None, None]


def test_cron():
    from datetime import datetime as dt

    from noticelake.functions.schedules import due

    assert due("once:x", None, dt(2024, 1, 1)) and not due("0 9 * * *", None, dt(2024, 1, 1))
    assert due("0 9 * * *", dt(2024, 1, 1, 8, 0), dt(2024, 1, 1, 9, 0)) and not due("0 9 * * *", dt(2024, 1, 1, 9, 0), dt(2024, 1, 1, 23, 0))
    assert due("*/15 * * * 1-5", dt(2024, 1, 1, 8, 1), dt(2024, 1, 1, 8, 15)) and not due("0 0 1 2 *", dt(2024, 1, 1), dt(2024, 1, 31))
