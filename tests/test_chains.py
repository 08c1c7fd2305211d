"""Lineage, resolution, requests, snapshots and pushes on given cases and against plain Python."""

from pyspark.sql import functions as F

from noticelake.functions import intents
from noticelake.operators import lineage, organisations, simhash, sync
from noticelake.plans import chains

SF = "/root/testdata/sf0.001"


def told(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_topic_words(spark):
    cases = {
        "北京教育系统的中标公告 最近30天": ["教育"], "医疗设备采购": ["医疗"], "格力公司": ["格力"], "浙江省台州市体育器材招标公告": ["台州", "体育器材"],
        "所有项目": [], "": [], None: [], "办公桌椅采购项目、台灯": ["办公桌椅", "台灯"], "空调和电梯": ["空调", "电梯"], "政府": [], "A政府采购": ["A政府"],
        "非常长的没有任何已知词的句子在这里": [], "北京": [], "北京市": ["北京市"], "台州图书，台州图书": ["台州", "图书"], "桌": [],
    }
    assert told(spark, cases, intents.split_topic) == list(cases.values())


def test_topics_that_are_sentences(spark):
    cases = {"服务器": "服务器", "北京教育系统的中标公告 最近30天": "教育", "体育器材招标": "体育器材", "所有公告": "所有公告", None: None, "": ""}
    assert told(spark, cases, intents.fix_topic) == list(cases.values())


def test_requests(spark):
    texts = ["每天9:00推送浙江台州的服务器招标", "北京协和医院最近30天中标", None, "更正公告 5天", "最近3个月广东充电站和充电桩成交", "每周一 IT"]
    got = [tuple(x) for x in told(spark, texts, intents.parse)]
    assert got == [
        ("服务器", "台州", "30d", "0 9 * * *", "scheduled", ["台州", "服务器"], "tender"),
        ("北京协和医院", None, "30d", None, "immediate", ["北京协和医院"], "award"),
        (None, None, "30d", None, "immediate", [], None),
        (None, None, "5d", None, "immediate", [], "correction"),
        ("充电桩", "广东", "3m", None, "immediate", ["充电桩", "充电站"], "award"),
        ("IT设备", None, "30d", "0 9 * * 1", "scheduled", ["IT"], None),
    ]


def test_lineage_against_all_pairs(spark):
    prints = [0, 7, 7, 7, 5, 0, 1 << 40, (1 << 40) | 15, -1, -1, 4]
    rows = [(i, f"http://h/{i}", "www.gov.cn" if i % 2 else None, "text of a page, long enough", p, "f" if i != 3 else "", "v") for i, p in enumerate(prints)]
    pages = spark.createDataFrame(rows, "id long, url string, host string, content string, simhash long, field string, value string")
    got = {r.id: r for r in lineage.combined(pages, "field", "value").collect()}
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for i, p in enumerate(prints):
        near = sorted((apart(p, q), j) for j, q in enumerate(prints) if p and q and j != i and apart(p, q) <= 3)
        assert (got[i].n_candidates, got[i].nearest) == (len(near), near[0][1] if near else None), i
    assert got[1].role == "official_original" and got[0].role == "unknown" and got[3].fact_key is None and got[1].fact_key
    assert len(got) == len(prints) and lineage.combined(pages.limit(0)).count() == 0
    pages = {r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.id for r in chains.l04_combined_lineage(spark, SF).collect()} == pages


def test_resolution_against_a_loop(spark):
    base = "Bureau of Public Works and Roads of the Eastern District, Department of Bridges and Tunnels, Section "
    known = [(1, base + "One", "C1"), (2, base + "Two", ""), (3, base + "Two", "C1"), (4, "", "C4"), (5, None, None), (6, "Another office of quite different name", "C6")]
    asked = [(10, "C1", base + "Two"), (11, "", base + "Two"), (12, None, base + "Two."), (13, "C4", " "), (14, None, None), (15, "C9", "Nobody at all"), (16, "C4", "x"), (17, None, base + "One"), (18, None, base + "Ones")]
    got = {r.id: (r.method, r.organization_id, r.confidence) for r in organisations.resolve(
        spark.createDataFrame(asked, "id long, code string, name string"), spark.createDataFrame(known, "organization_id long, name string, code string")
    ).collect()}
    for i, code, name in asked:
        if not (name or "").strip():
            want = ("empty_name", None, 0.0)
        elif code and any(c == code for _, _, c in known):
            want = ("exact_credit_code", min(o for o, _, c in known if c == code), 1.0)
        elif any(n == name for _, n, _ in known):
            want = ("exact_name", min(o for o, n, _ in known if n == name), 0.95)
        else:
            h = simhash.simhash_of(name)
            near = sorted((bin((h ^ simhash.simhash_of(n)) & (2**64 - 1)).count("1"), o) for o, n, _ in known if n)
            near = [x for x in near if x[0] <= 3]
            want = ("fuzzy_name", near[0][1], max(0.7, round(0.9 - 0.1 * near[0][0], 2))) if near else ("no_match", None, 0.0)
        assert got[i] == want, i
    assert "fuzzy_name" in {m for m, _, _ in got.values()} and len(got) == len(asked)


def test_snapshots(spark, tmp_path):
    from noticelake.sources.readers import append_table

    latest = spark.createDataFrame([("u", "x", 3)], "url string, content_hash string, version long")
    crawl = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "a"), ("v", None), ("w", "")], "url string, html string")
    rows = sync.new_snapshots(crawl, latest)
    assert sorted((r.url, r.version) for r in rows.collect()) == [("u", 4), ("u", 5), ("v", 1), ("w", 1)]
    for _ in range(2):
        append_table(rows, str(tmp_path / "snapshots"), "one")
    again = spark.read.parquet(str(tmp_path / "snapshots"))
    assert again.count() == 4
    newest = again.groupBy("url").agg(F.max_by("content_hash", "version").alias("content_hash"), F.max("version").alias("version"))
    assert [r.url for r in sync.new_snapshots(crawl.filter("url <> 'u'"), newest).collect()] == []
    assert sync.new_snapshots(crawl.limit(0), latest).count() == 0


def test_pushes_come_again_until_delivered(spark):
    subscriptions = spark.createDataFrame([(1, True, True, False), (2, True, True, True), (3, None, True, True)], "subscription_id long, is_active boolean, due boolean, delivered boolean")
    unpushed = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 1), (9, 1)], "subscription_id long, id long")
    none = spark.createDataFrame([], "subscription_id long, content_hash string")
    run = sync.trigger(subscriptions, unpushed, none)
    assert {r.subscription_id: (r.status, r.n) for r in run.collect()} == {1: ("push_failed", 2), 2: ("ok", 1), 3: ("skipped", 1)}
    log = sync.push_log(run, unpushed)
    assert [(r.subscription_id, r.id) for r in log.collect()] == [(2, 5)]
    later = sync.trigger(subscriptions, unpushed, log.select("subscription_id", "content_hash"))
    assert {r.subscription_id: r.status for r in later.collect()} == {1: "push_failed", 2: "skipped_duplicate", 3: "skipped"}


def test_dataset_hash_is_of_rows_not_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "")]
    make = lambda r, n: sync.dataset_hash(spark.createDataFrame(r, "k long, t string").repartition(n), ["k", "t"]).first()
    assert make(rows, 1) == make(rows[::-1], 3)
    others = [rows[:3], [*rows[:3], (3, None)], [(1, "b"), *rows[1:]]]
    assert len({make(r, 2).dataset_hash for r in [rows, *others]}) == 4
    assert make([], 1).n == 0
