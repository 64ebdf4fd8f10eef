"""Queries and stages on empty tables, and on tables whose every value is null."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pipeloom.llm.queries import QUERIES  # noqa: E402

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(spark, tmp_path_factory, request):
    d = tmp_path_factory.mktemp(request.param)
    for name, schema in TABLES.items():
        rows = [] if request.param == "empty" else [(None,) * len(schema.split(","))] * 3
        spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))
    return str(d), len(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    d, n = folder
    assert QUERIES[name](spark, d).count() == (0 if name.startswith("op3_") else n)


def test_pipeline(spark, folder):
    d, n = folder
    rows = corpus_pipeline.run(spark, d).collect()
    assert [r["doc_tokens"] for r in rows] == [1] * min(n, len(rows)) and (len(rows) > 0) == (n > 0)
