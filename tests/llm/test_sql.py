"""What SQL can express of the operators' results, against DuckDB on the same tables."""

import os

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

from pipeloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    cur = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    want = sorted(tuple(repr(dict(zip([d[0] for d in cur.description], r, strict=True))[n]) for n in names) for r in cur.fetchall())
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == names
    assert sorted(tuple(repr(r[n]) for n in names) for r in df.collect()) == want


def test_assignments_fold_case_as_their_sql(spark, tmp_path):
    """The long s and the Kelvin sign fold to s and k; a dotless i and a dotted I don't fold to i; values aren't folded."""
    value = "abcdefghijkl"
    texts = [f"{k}={value}" for k in ("\u017fecret", "pa\u017f\u017fword", "paS\u017fwd", "PA\u017fsWORD", "to\u212aen", "api_\u212aey", "API\u212aEY", "TOKEN", "ap\u0131_key", "AP\u0130KEY", "\u017ftoken")] + ["token=abcdef\u017fabcdef", "secret=abcd\u212aefghijkl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["secrets_base_counts"]).fetchall())
    assert [r[1] for r in want] == [1] * 8 + [0] * 2 + [1] + [0] * 2
    assert sorted(map(tuple, QUERIES["secrets_base_counts"](spark, str(tmp_path)).collect())) == want
    spans = {r["doc_id"]: r["spans"] for r in QUERIES["op1_secret_scan"](spark, str(tmp_path)).collect()}
    assert all(spans[i] == f"assign:{len(t) - len(value)}:{len(t)}" for i, t in enumerate(texts) if want[i][1])
