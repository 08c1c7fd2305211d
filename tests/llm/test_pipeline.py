"""The pipeline against plain restatements of what its stages decide."""

import corpus_pipeline
from noticelake.llm import neardup, pii, quality_zstd
from noticelake.llm.bpe import ByteBpe, vocabulary_path

from .conftest import SF
from .test_corpus_operators import brute_components


def test_stages_and_rows(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "decontam", "pii", "bpe"]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality_zstd.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect() if quality_zstd.score(r.text, model) >= quality_zstd.THRESHOLD}
    groups = brute_components([(i, r.text) for i, r in rows.items()], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    rows = {i: r for i, r in rows.items() if groups[i][1] == i}
    clean = {i: r for i, r in rows.items() if not any(b in r.text for b in bench)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(clean) and len(clean) - len(got) <= 1  # near copies of passages go, too
    coder = ByteBpe(open(vocabulary_path(), encoding="utf-8").read())
    for i, r in got.items():
        text = pii.redact(clean[i].text, pii.find_spans(clean[i].text))
        assert r.text == text and r.n_chars == len(text) and bytes(r.token_ids) == coder.encode_packed(text) and r.restored and r.n_tokens == len(r.token_ids) // 4


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != "bpe":
                assert out.columns == df.columns, name
            assert out.count() <= df.count()


def test_one_of_each_group_stays(docs):
    kept = {r.doc_id for r in neardup.keep_one(docs, 5, 80).collect()}
    groups = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert kept == {i for i, (_, c) in groups.items() if i == c}
