"""The pipeline on a small corpus, stage by stage and as a whole."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from planted_corpus import corpus  # noqa: E402


def test_stages(spark, tmp_path):
    docs, want = corpus(spark, tmp_path)
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == list(corpus_pipeline.COLUMNS)
        path = str(tmp_path / f"out-{name}")
        df.write.parquet(path)
        df = spark.read.parquet(path)
        assert sorted(r["doc_id"] for r in df.collect()) == want[name], name
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert "[SECRET]" in texts[300] and "0f0f0f0f" not in texts[300]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(want["secrets"])
    ends = {}
    for r in got:
        ends[r["doc_id"]] = ends.get(r["doc_id"], 0) + r["length"]
    assert all(ends[r["doc_id"]] == r["doc_tokens"] for r in got)
