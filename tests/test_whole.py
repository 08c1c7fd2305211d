"""Queries over whole tables against brute force in plain Python; those with SQL are held against it as well."""

import re
from itertools import combinations

from pyspark.sql import functions as F

from noticelake.operators import evidence as ev
from noticelake.operators import facts, simhash
from noticelake.plans import whole

SF = "/root/testdata/sf0.001"


def test_occurrences_beyond_the_head(spark):
    texts = ["x" * 500 + "aaaa", "aXa", None, "", "a.a.a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = lambda q: {r.doc_id: r.n for r in df.select("doc_id", ev.overlapping_occurrences(F.col("text"), q).alias("n")).collect()}
    assert of("aa") == {0: 3, 1: 0, 2: 0, 3: 0, 4: 0} and of("a.a")[4] == 2 and of("a.a")[1] == 0 and set(of("").values()) == {0}
    got = {r.doc_id: r.n for r in whole.x04_occurrences_whole(spark, SF).collect()}
    assert got == {r.doc_id: len(re.findall("(?=th)", r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_categories_of_facts(spark):
    patterns = {k: re.compile(p, re.A) for k, p in facts.PATTERNS.items()}
    want = {(d.doc_id, k, v.strip(" ")) for d in spark.read.parquet(f"{SF}/documents.parquet").collect() for k, p in patterns.items() for v in p.findall(d.text)}
    got = [tuple(r) for r in whole.p23_facts_whole(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def page(title, body, link):
    return f"<html><head><title>{title}</title><script>x('{title}')</script></head><body><p>{body}</p><a href='{link}'>a</a></body></html>"


def test_reposts_by_fingerprint(spark, tmp_path):
    body = "The purchaser invites tenders for the supply of desks and chairs, delivery within sixty days of the award. "
    rows = [
        (1, "http://a.example.com/1", page("Desks and chairs", body * 3, "/d.pdf")),
        (9, "http://www.a.example.com/2", page("Desks and chairs", body * 3, "/d.pdf")),
        (14, "http://b.example.org/2", page("Other", body * 3, "/e.html")),
        (15, "http://c.example.org/2", page("Apples", "Nothing of this has been said before by any of the pages.", "/f")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.a, r.b): r.verdict for r in whole.l06_reposts_whole(spark, str(tmp_path)).collect()}
    assert got == {(1, 9): "same_source_repost", (1, 14): "independent", (9, 14): "independent"}


def test_clusters_of_all_organisations(spark):
    top, orders = {}, {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity > 45").collect():
        orders.setdefault(r.l_orderkey, set()).add(r.l_suppkey)

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for members in orders.values():
        root(min(members))
        for a, b in combinations(sorted(members), 2):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = [(r.id, r.cluster) for r in whole.l14_clusters_whole(spark, SF).collect()]
    assert sorted(got) == sorted((i, root(i)) for i in list(top))
