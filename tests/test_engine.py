"""Documents, text form, catalog, results, sources and live pipes."""

import json

import pytest

from pipeloom import Callable_, Context, Dataset, Datasets, Engine, QueryError, ScopeColumn, register
from pipeloom.functions.expr import interval_us, references, translate
from pipeloom.operators import OPERATORS
from pipeloom.plans import parse, text
from pipeloom.plans.catalog import CATALOG, json_schema, missing_requirements, reference
from pipeloom.streaming.live import is_live_safe, prime, sessions, split_live, stream, subscribe

ORDERS = [(k, "FOP"[k % 3], k * 37 % 101 * 1.5, 1 + k % 7) for k in range(40)]


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(ORDERS, "o_orderkey long, o_orderstatus string, o_totalprice double, o_custkey long").repartition(3)
    return Engine(Context(spark, Datasets().frame("orders", df, key=("o_orderkey",))), observe=True)


def same(engine, text_form, *stages):
    """A text gives the document of these stages, and the same rows."""
    doc = text.parse(f"source orders | {text_form}")
    assert doc == {"mode": "pipe", "from": "orders", "pipe": list(stages)}
    assert parse.validate(doc) == []
    return doc


@pytest.mark.parametrize("written, stages", [
    ("where o_totalprice >= 75.5 | limit 4 | skip 0", [{"op": "filter", "where": {"field": "o_totalprice", "op": ">=", "value": 75.5}}, {"op": "limit", "n": 4}, {"op": "skip", "n": 0}]),
    ("where `o_custkey in (2, 5) or o_orderstatus = 'F|P'`", [{"op": "filter", "where": {"expr": "o_custkey in (2, 5) or o_orderstatus = 'F|P'"}}]),
    ("where o_orderstatus is_not_null | tap kept", [{"op": "filter", "where": {"field": "o_orderstatus", "op": "is_not_null"}}, {"op": "tap", "label": "kept"}]),
    ("select o_orderkey as k, o_custkey | distinct by k", [{"op": "project", "select": [{"field": "o_orderkey", "as": "k"}, {"field": "o_custkey"}]}, {"op": "distinct", "by": ["k"]}]),
    ("compute dear = `o_totalprice > 99` | rename o_custkey -> cust | drop o_totalprice", [{"op": "compute", "as": "dear", "expr": "o_totalprice > 99"}, {"op": "rename", "map": {"o_custkey": "cust"}}, {"op": "drop", "columns": ["o_totalprice"]}]),
    ("groupBy o_orderstatus, o_custkey | aggregate max(o_totalprice) as top, count(*) as n, percentile(o_totalprice, 75) as q | sort top desc, n", [
        {"op": "groupBy", "keys": ["o_orderstatus", "o_custkey"]}, {"op": "aggregate", "aggs": [{"fn": "MAX", "field": "o_totalprice", "as": "top"}, {"fn": "COUNT", "field": "*", "as": "n"}, {"fn": "PERCENTILE", "field": "o_totalprice", "args": [75], "as": "q"}]},
        {"op": "sort", "by": [{"field": "top", "dir": "desc"}, {"field": "n"}]}]),
    ("pivot o_orderstatus, sum(o_totalprice) for o_custkey", [{"op": "pivot", "columnKey": "o_orderstatus", "aggregate": "sum", "valueField": "o_totalprice", "rowKeys": ["o_custkey"]}]),
    ("unpivot o_orderkey, o_custkey to (id_of, id)", [{"op": "unpivot", "valueCols": ["o_orderkey", "o_custkey"], "nameAs": "id_of", "valueAs": "id"}]),
    ("nest by o_custkey into theirs include o_orderkey | flatten theirs as one | unnestObject one prefix its_ drop", [
        {"op": "nest", "by": ["o_custkey"], "into": "theirs", "include": ["o_orderkey"]}, {"op": "flatten", "field": "theirs", "as": "one"}, {"op": "unnestObject", "field": "one", "prefix": "its_", "drop": True}]),
    ('callFunction money::round mode batch pure args {"to": 2} as rounded | callApp ledger.post {"book": "a|b"}', [
        {"op": "callFunction", "name": "money::round", "mode": "batch", "pure": True, "args": {"to": 2}, "as": "rounded"}, {"op": "callApp", "appId": "ledger", "method": "post", "payload": {"book": "a|b"}}]),
])
def test_text_gives_the_document(engine, written, stages):
    doc = same(engine, written, *stages)
    if not any(s["op"].startswith("call") for s in stages):
        assert engine.execute(f"source orders | {written}").rows == engine.execute(doc).rows


@pytest.mark.parametrize("broken", ["orders | limit 3", "source orders | sort", "source orders | limit few", "source orders | shuffle o_custkey", "source orders | where `o_custkey", "source orders | limit 3 4"])
def test_text_that_is_none(broken):
    with pytest.raises(QueryError):
        text.parse(broken)


def test_catalog_and_registry(spark):
    assert set(CATALOG) == set(OPERATORS) and len(CATALOG) == 40
    schema = json_schema()
    assert set(schema["definitions"]) == set(CATALOG) and schema["definitions"]["skip"]["properties"]["n"] == {"type": "integer"}
    assert all(f"## `{name}`" in reference() for name in CATALOG)
    assert missing_requirements("callApp", Context(spark)) == ["apps"]
    with pytest.raises(ValueError):
        register("sheet")(lambda *a: None)


def test_validation_names_the_place_of_each_fault():
    stages = [{"op": "sort"}, {"op": "shuffle"}, {"op": "aggregate", "keys": ["o_custkey"], "aggs": [{"fn": "TALLY", "field": "o_custkey"}]}, {"op": "skip", "n": 2, "from": "before"}, {"op": "branch", "when": "true", "then": [{"op": "pivot"}]}]
    got = [e.split(":")[0] for e in parse.validate({"from": "orders", "pipe": stages})]
    assert got[:4] == ["pipe[0].by", "pipe[1].op", "pipe[2].aggs[0].fn", "pipe[3].from"] and all(e.startswith("pipe[4].then[0].") for e in got[4:]) and len(got) > 4
    assert parse.validate("not json at all {") and any("from" in e for e in parse.validate({"pipe": [{"op": "tap"}]}))
    assert any("having" in e for e in parse.validate({"from": "orders", "having": {"field": "o_custkey", "op": "<", "value": 3}}))


def test_declared_parameters(engine):
    declared = [{"name": "cust", "type": "int32", "required": True}, {"name": "open", "type": "bool", "default": "false"}]
    assert parse.declared({"cust": "5"}, declared) == {"cust": "5", "$cust": 5, "$open": False}
    with pytest.raises(QueryError):
        parse.declared({"open": "true"}, declared)
    doc = {"from": "orders", "where": {"field": "o_custkey", "op": "==", "value": "$cust"}}
    assert [r["o_orderkey"] for r in engine.execute(doc, parse.declared({"cust": "5"}, declared)).rows] == [k for k, _, _, c in ORDERS if c == 5]


def test_expressions():
    assert references('o_totalprice * max(`net of tax`) - s.part + filter(xs, e -> e > low) || "o_custkey"') == ["o_totalprice", "net of tax", "s", "xs", "low"]
    assert translate("!done && n == 4 || name != '!&&'") == "NOT done AND n == 4 OR name != '!&&'"
    assert [interval_us(t) for t in ("250ms", "1m30s", "2h", "1w")] == [250_000, 90_000_000, 7_200_000_000, 604_800_000_000]
    for wrong in ("soon", "5", "-1h", "0s", "3 h"):
        with pytest.raises(ValueError):
            interval_us(wrong)


def test_durations_are_intervals(spark):
    got = spark.sql("SELECT timestamp_ntz'2031-03-01 00:00:00' AS t").selectExpr(translate('t + duration("1h30m") AS u')).first()["u"]
    assert (got.hour, got.minute) == (1, 30)


def test_results_tell_their_columns_counts_and_pages(engine):
    stages = [{"op": "filter", "where": {"field": "o_totalprice", "op": "<", "value": 60}}, {"op": "compute", "as": "tenth", "expr": "o_totalprice / 10"}, {"op": "tap", "label": "cheap"}, {"op": "limit", "n": 6}]
    r, n = engine.execute({"from": "orders", "pipe": stages}), sum(p < 60 for _, _, p, _ in ORDERS)
    assert len(r.rows) == 6 and [c["source"] for c in r.columns] == ["raw"] * 4 + ["computed"] and [c["type"] for c in r.columns][:2] == ["number", "string"]
    assert [p["op"] for p in r.stats()["pipe"]] == [s["op"] for s in stages] and r.stats()["pipe"][-1]["rowsOut"] == 6 and r.taps["cheap"].get["rows"] == n
    assert [json.loads(x["value"])["o_orderkey"] for x in r.to_json().collect()] and r.errors() == {"total": 0, "by_formula": {}, "samples": []}
    by_price = sorted(ORDERS, key=lambda o: (-o[2], o[0]))
    order = [{"field": "o_totalprice", "dir": "desc"}]
    for offset, more in ((0, True), (30, False), (36, False)):
        page = engine.execute({"from": "orders", "orderBy": order, "limit": 10, "offset": offset}, page=True)
        assert [x["o_orderkey"] for x in page.rows] == [o[0] for o in by_price[offset : offset + 10]] and page.has_more == more and page.page == offset // 10 + 1


def test_explained_plans(engine):
    plan = engine.explain('source orders | where o_orderstatus == "F" | select o_orderkey')
    assert plan["steps"] == ["filter", "project"] and "Filter" in plan["plan"] and plan["liveSafe"] and [c["name"] for c in plan["columns"]] == ["o_orderkey"]


def test_clauses_and_stages_agree(engine):
    clauses = {"from": "orders", "computed": [{"name": "half", "expr": "o_totalprice / 2"}], "where": {"field": "half", "op": ">", "value": 12}, "groupBy": ["o_orderstatus"], "aggregate": [{"fn": "MAX", "field": "half", "as": "top"}], "orderBy": [{"field": "top", "dir": "desc"}]}
    stages = "source orders | compute half = `o_totalprice / 2` | where half > 12 | groupBy o_orderstatus | aggregate max(half) as top | sort top desc"
    want = sorted(({"o_orderstatus": st, "top": max(p / 2 for _, x, p, _ in ORDERS if x == st)} for st in "FOP"), key=lambda r: -r["top"])
    assert engine.execute(clauses).rows == engine.execute(stages).rows == want


def test_scope(spark, engine):
    orders = engine.context.datasets.resolve("orders", spark).load(spark)
    ctx = Context(spark, Datasets().frame("orders", orders, key=("o_orderkey",)).frame("bare", orders.select("o_orderkey"), key=("o_orderkey",)), scope=None)
    with pytest.raises(QueryError):
        Engine(ctx).execute({"from": "orders"})
    strict, loose = [ScopeColumn("o_orderstatus", "P", required=True)], [ScopeColumn("o_orderstatus", "P")]
    mine = [k for k, st, _, _ in ORDERS if st == "P"]
    assert [r["o_orderkey"] for r in Engine(ctx).execute({"from": "orders"}, scope=strict).rows] == mine
    with pytest.raises(QueryError):
        Engine(ctx).execute({"from": "bare"}, scope=strict)
    joined = {"from": "bare", "join": [{"dataset": "orders", "type": "left", "on": {"left": "bare.o_orderkey", "right": "orders.o_orderkey"}}], "select": ["o_orderstatus"]}
    assert [r["o_orderstatus"] for r in Engine(ctx).execute(joined, scope=loose).rows].count("P") == len(mine)


@pytest.mark.parametrize("kind", ["json", "orc", "csv", "parquet"])
def test_sources_of_files(spark, tmp_path, kind):
    rows = spark.range(20).selectExpr("id", "id * 3 AS v")
    rows.write.format(kind).option("header", "true").save(str(tmp_path / kind))
    d = Datasets().files("kept", str(tmp_path / kind), kind, {"header": "true", "inferSchema": "true"} if kind == "csv" else None)
    got = Engine(Context(spark, d)).execute("source kept | where v > 30 | sort id").rows
    assert got == [{"id": i, "v": 3 * i} for i in range(11, 20)]


def test_sources_of_other_kinds(spark):
    spark.range(3).createOrReplaceTempView("a_view_of_three")
    e = Engine(Context(spark, Datasets().add(Dataset("pair", lambda s: s.range(2), ("id",)))))
    assert [len(e.execute(f"source {n}").rows) for n in ("pair", "a_view_of_three")] == [2, 3]
    assert len(e.execute({"mode": "pipe", "pipe": [{"op": "limit", "n": 4}]}, on=spark.range(9)).rows) == 4
    with pytest.raises(KeyError):
        e.execute("source unheard_of")


def test_sources_of_databases(spark):
    """A table in an embedded database, read in several parts."""
    url, how = "jdbc:derby:memory:pipeloom;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(40).selectExpr("id", "id % 7 AS k").write.jdbc(url, "kept", mode="overwrite", properties=how)
    e = Engine(Context(spark, Datasets().jdbc("kept", url, "kept", how, partition=("id", 0, 40, 3), key=("id",))))
    assert e.execute("source kept | where k == 3 | select id").rows == [{"id": i} for i in range(3, 40, 7)]


APP, PURE = {"op": "callApp", "appId": "ledger"}, {"op": "callFunction", "name": "tidy", "pure": True}


def test_what_may_run_again():
    safe = [{"op": "filter", "where": {"expr": "true"}}, PURE, {"op": "merge", "sources": [{"pipe": [PURE]}]}]
    assert is_live_safe(safe) and not is_live_safe([{"op": "merge", "sources": [{"pipe": [APP]}]}]) and not is_live_safe([{**PURE, "pure": False}])
    assert [len(p) for p in split_live([*safe, APP, *safe])] == [4, 3] and [len(p) for p in split_live(safe)] == [0, 3]


def test_a_primed_pipe_runs_its_rest_alone(spark, engine, tmp_path):
    """What has side effects runs once, whatever runs again; earlier named stages can still be read."""
    log = str(tmp_path / "log")

    def post(row, payload):
        with open(log, "a") as f:
            f.write("x")
        return {"o_orderkey": row["o_orderkey"], "posted": row["o_custkey"] * payload["by"]}

    ctx = Context(spark, engine.context.datasets)
    ctx.apps["ledger"] = Callable_(post, "o_orderkey bigint, posted bigint")
    stages = [
        {"op": "filter", "where": {"field": "o_orderstatus", "op": "==", "value": "F"}, "id": "finished"}, {"op": "project", "select": ["o_orderkey", "o_custkey"], "id": "keys"}, {**APP, "batch": False, "payload": {"by": 10}},
        {"op": "filter", "where": {"field": "posted", "op": ">", "value": 30}, "id": "large"}, {"op": "aggregate", "aggs": [{"fn": "COUNT", "field": "*", "as": "n"}, {"fn": "SUM", "field": "posted", "as": "sum"}], "id": "sums"},
        {"op": "aggregate", "aggs": [{"fn": "COUNT", "field": "*", "as": "all"}], "from": "finished"},
    ]
    one = prime(Engine(ctx), {"from": "orders", "pipe": stages[:5]})
    ran, done = len(open(log).read()), [c for k, st, _, c in ORDERS if st == "F"]
    assert one.at == 3 and ran == len(done)
    want = [{"n": sum(c > 3 for c in done), "sum": 10 * sum(c for c in done if c > 3)}]
    assert one.replay().rows == want == one.replay().rows and len(open(log).read()) == ran
    assert prime(Engine(ctx), {"from": "orders", "pipe": stages}).replay().rows == [{"all": len(done)}]
    whole = prime(Engine(ctx), {"from": "orders", "pipe": stages[:2]})
    assert whole.at == 0 and len(whole.replay().rows) == len(done)


def test_live(spark, engine, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("SELECT id, 'a' AS k, timestamp_seconds(id * 60) AS ts FROM range(10)").write.parquet(path)
    rows = spark.readStream.schema("id long, k string, ts timestamp").parquet(path)
    doc = {"pipe": [{"op": "filter", "where": {"field": "id", "op": "<", "value": 9}}, {"op": "aggregate", "keys": ["k"], "aggs": [{"fn": "COUNT", "field": "*", "as": "n"}]}]}
    for name, df, want in (("tumbling", stream(engine, doc, rows, "ts", "1m", "5m"), [4, 5]), ("session", sessions(rows, "ts", "1m", "2m", ["k"]), [10])):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(r["n" if name == "tumbling" else "rows"] for r in spark.table(name).collect())
        assert got == want or name == "session" and got in ([], want)
    seen = []
    subscribe(engine, doc, rows, lambda df, i: seen.extend(r.asDict() for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert seen == [{"k": "a", "n": 9}]
    with pytest.raises(QueryError):
        stream(engine, {"pipe": [{"op": "sort", "by": ["id"]}]}, rows, "ts", "1m", "5m")


def test_intermediate_tables_are_freed(spark):
    import os

    from pipeloom.sources.scratch import freed, shared_dir, written

    listed = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    outside = written(spark.range(3), "outside")
    before = listed()
    with freed():
        assert written(spark.range(5), "inside").count() == 5 and len(listed()) == len(before) + 1
    assert listed() == before and outside.count() == 3
