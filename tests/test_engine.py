"""Iterative operators against brute force, readers and writers, streams."""

import json

from pyspark.sql import functions as F

from noticelake.operators import lineage, signals, simhash, versions
from noticelake.sources import readers
from noticelake.streaming import streams

SF = "/root/testdata/sf0.001"


def prints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, {r.id: r.simhash for r in docs.select(F.col("doc_id").alias("id"), simhash.simhash_column()("text").alias("simhash")).collect()}


def test_simhash_forms_agree(spark):
    docs, want = prints(spark)
    got = {r.doc_id: r.simhash for r in simhash.simhash_native(docs.limit(40), "doc_id", "text").collect()}
    assert got == {i: want[i] for i in got} and simhash.simhash_of("") == 0


def test_near_pairs_and_greedy_dedup(spark):
    _, want = prints(spark)
    rows = spark.createDataFrame(list(want.items()), "id long, simhash long")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    pairs = {(r.a, r.b): r.distance for r in simhash.near_pairs(rows, rows).collect()}
    assert pairs == {(a, b): far(x, y) for a, x in want.items() for b, y in want.items() if x and y and far(x, y) <= 3}
    kept = []
    for i in sorted(want):
        if not any(want[j] and far(want[i], want[j]) <= 3 for j in kept if want[i]):
            kept.append(i)
    assert {r.id for r in simhash.keep_first(rows).filter("kept").collect()} == set(kept)


def test_ingest_verdict(spark):
    new = spark.createDataFrame([(1, "u1", 15), (2, "u2", 7), (3, "u3", 255 << 40), (4, "u3", 255 << 50)], "id long, url string, simhash long")
    known = spark.createDataFrame([(9, "u1", 1 << 30), (8, "x", 3)], "id long, url string, simhash long")
    got = {r.id: r.verdict for r in simhash.ingest_verdict(new, known).collect()}
    assert got == {1: "duplicate_url", 2: "duplicate_simhash", 3: "inserted", 4: "duplicate_url"}
    assert simhash.ingest_verdict(new, known, within_batch=False).filter("id = 4").first().verdict == "inserted"


def test_clusters_and_co_occurrence(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (3, 9), (10, 11)], "a long, b long")
    assert {r.id: r.cluster for r in lineage.repost_clusters(pairs).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 6: 6, 7: 6, 10: 10, 11: 10}
    rows = [(g, f"o{(g * 7 + i) % 90:02d}") for g in range(3) for i in range(70)]
    df = spark.createDataFrame(rows, "g int, o string")
    want = {}
    for g in range(3):
        names = sorted({o for x, o in rows if x == g})
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.n for r in signals.co_occurrence(df, "o", ["g"], most=20).collect()} == want


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("u1",), ("u1",), (None,)], "source_url string")
    known = spark.createDataFrame([("u0",)], "source_url string")
    first = versions.upsert_by_url(new, known)
    assert first.count() == 2 and versions.upsert_by_url(new, first.select("source_url")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "n.txt").write_text("# T\n# URL: http://x/1\n# Type: award\n# Fetched: now\n\n## Body\ntext ## more\n", encoding="utf-8")
    got = readers.read_notices(spark, str(tmp_path / "n.txt")).first()
    assert (got.title, got.source_url, got.notice_type, got.fetched) == ("T", "http://x/1", "award", "now") and got.body.startswith("## Body\ntext ## more")
    shapes = [
        {"document_id": "a", "fields": [{"field_name": "f", "gold_status": "present", "values": [{"raw_value": "1"}, {"raw_value": "2"}]}]},
        {"document_id": "b", "fields": {"f": {"status": "absent", "values": ["3"]}}},
        {"document_id": "c", "fields": [{"field_name": "f", "gold_status": "present", "value": "4"}]},
    ]
    for s in shapes:
        (tmp_path / f"{s['document_id']}.json").write_text(json.dumps(s))
    rows = {r.document_id: (r.gold_status, r["values"]) for r in readers.read_gold(spark, str(tmp_path / "*.json")).collect()}
    assert rows == {"a": ("present", ["1", "2"]), "b": ("absent", ["3"]), "c": ("present", ["4"])}
    (tmp_path / "c.jsonl").write_text('{"id": 1, "x": 1}\nbroken\n{"id": 1, "x": 2}\n{"id": 2, "x": 3}\n')
    assert {r.id: r.x for r in readers.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "id int, x int", "id").collect()} == {1: 2, 2: 3}


def test_repeated_writes_double_nothing(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    for batch in ("b1", "b2", "b1"):
        readers.append_table(df, path, batch)
    assert spark.read.parquet(path).count() == 10


def test_streams(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    out, log, mark = (str(tmp_path / n) for n in ("out", "log", "mark"))
    for _ in range(2):  # the second start finds nothing new
        streams.append_batches(source, out, mark, log).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(log).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    counted = streams.daily_rate(source.withColumn("ts", F.col("ts").cast("timestamp")), "event_type")
    run = counted.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM rate").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
