"""Registered queries of the engine's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom import Callable_, Context, Dataset, Datasets, Engine, ScopeColumn
from pipeloom.sources.scratch import scratch
from pipeloom.streaming.live import prime

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": LINE,
    "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}


def context(spark: SparkSession, sf_dir: str) -> Context:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ctx = Context(spark, Datasets().directory(sf_dir, KEYS))
    ctx.datasets.add(Dataset("versioned", lambda s: s.read.parquet(f"{sf_dir}/events.parquet").withColumn("_is_current", F.col("event_id") % 3 != 0), ("event_id",), versioned=True))
    ctx.datasets.add(Dataset("audited", lambda s: s.read.parquet(f"{sf_dir}/events.parquet").withColumn("created_by", F.col("user_id")), ("event_id",)))
    ctx.directories["user"] = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    ctx.functions["shout"] = Callable_(lambda r: (r["kind"] or "").upper() + "!", "string")
    ctx.functions["parts"] = Callable_(lambda r: {"whole": int(r["value"]), "even": int(r["event_id"]) % 2 == 0}, "whole bigint, even boolean")
    ctx.functions["doubled"] = Callable_(lambda df, args: df.withColumn("twice", F.col("event_id") * args["by"]), whole=True)
    ctx.apps["scorer"] = Callable_(lambda df, payload: df.withColumn("score", F.col("event_id") % payload["mod"]), whole=True)
    return ctx


def pipe(source: str, *stages: dict[str, Any], **more: Any) -> dict[str, Any]:
    return {"mode": "pipe", "from": source, "pipe": list(stages), **more}


def s(op: str, **cfg: Any) -> dict[str, Any]:
    return {"op": op, **cfg}


def agg(fn: str, field: str | None = None, name: str = "", **more: Any) -> dict[str, Any]:
    return {"fn": fn, **({"field": field} if field else {}), "as": name, **more}


def keep(*names: str) -> dict[str, Any]:
    return s("project", select=[{"field": n} for n in names])


def where(field: str, op: str, value: Any = None) -> dict[str, Any]:
    return s("filter", where={"field": field, "op": op, "value": value})


def ev(*stages: dict[str, Any]) -> dict[str, Any]:
    return pipe("events", *stages)


ID = keep("event_id")
NULLED = s("compute", **{"as": "v"}, expr="CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")
NULLED_SQL = "SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events"
BY_LINE = [{"field": k} for k in LINE]
R4 = lambda x: f"round({x}, 4)"
#: Sums that don't depend on the order of addition.
DEC = "decimal(18,4)"
GAP = "interval 6 hour"

DOCS: dict[str, tuple[dict[str, Any] | str, str]] = {
    # conditions
    "filter_eq": (ev(where("event_type", "==", "click"), ID), "SELECT event_id FROM events WHERE event_type = 'click'"),
    "filter_ne": (ev(where("event_type", "!=", "click"), ID), "SELECT event_id FROM events WHERE event_type <> 'click'"),
    "filter_range": (pipe("lineitem", s("filter", where={"and": [{"field": "l_quantity", "op": ">=", "value": 10}, {"field": "l_quantity", "op": "<", "value": 20}, {"field": "l_shipdate", "op": ">", "value": "1995-06-01"}]}), keep("l_orderkey", "l_partkey", "l_shipdate")), "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_shipdate > TIMESTAMP '1995-06-01'"),
    "filter_in": (ev(where("event_type", "in", ["click", "view"]), ID), "SELECT event_id FROM events WHERE event_type IN ('click', 'view')"),
    "filter_not_in": (ev(where("user_id", "not_in", [1, 2, 3]), ID), "SELECT event_id FROM events WHERE user_id NOT IN (1, 2, 3)"),
    "filter_in_empty": (ev(where("event_type", "in", []), ID), "SELECT event_id FROM events WHERE false"),
    "filter_not_in_empty": (ev(where("event_type", "not_in", []), ID), "SELECT event_id FROM events"),
    "filter_like": (pipe("part", where("p_name", "like", "%a%e%"), keep("p_partkey")), "SELECT p_partkey FROM part WHERE p_name LIKE '%a%e%'"),
    "filter_not_like": (pipe("part", where("p_type", "not_like", "%A%"), keep("p_partkey")), "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%'"),
    "filter_affix": (pipe("customer", s("filter", where={"or": [{"field": "c_name", "op": "ends_with", "value": "7"}, {"field": "c_mktsegment", "op": "starts_with", "value": "B"}, {"field": "c_name", "op": "contains", "value": "55"}]}), keep("c_custkey")), "SELECT c_custkey FROM customer WHERE suffix(c_name, '7') OR prefix(c_mktsegment, 'B') OR contains(c_name, '55')"),
    "filter_between": (ev(where("value", "between", [10, 20]), ID), "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20"),
    "filter_null": (ev(NULLED, where("v", "is_null"), ID), "SELECT event_id FROM events WHERE event_id % 7 = 0"),
    "filter_not_null": (ev(NULLED, where("v", "is_not_null"), ID), "SELECT event_id FROM events WHERE event_id % 7 <> 0"),
    "filter_tree": (ev(s("filter", where={"or": [{"not": {"field": "event_type", "op": "in", "value": ["click", "view"]}}, {"and": [{"field": "user_id", "op": "<=", "value": 50}, {"field": "value", "op": ">", "value": 5}]}]}), ID), "SELECT event_id FROM events WHERE NOT event_type IN ('click', 'view') OR (user_id <= 50 AND value > 5)"),
    "filter_not_null_value": (ev(NULLED, s("filter", where={"not": {"field": "v", "op": ">", "value": 10}}), ID), f"SELECT event_id FROM ({NULLED_SQL}) WHERE NOT v > 10"),
    "filter_expr": (ev(s("filter", where={"expr": 'value > 10 && (event_type == "click" || user_id % 2 = 0)'}), ID), "SELECT event_id FROM events WHERE value > 10 AND (event_type = 'click' OR user_id % 2 = 0)"),
    # columns
    "project_alias": (pipe("orders", s("project", select=["o_orderkey", {"field": "o_custkey", "as": "cust"}, {"expr": "upper(o_orderstatus)", "as": "status"}])), "SELECT o_orderkey, o_custkey AS cust, upper(o_orderstatus) AS status FROM orders"),
    "project_drop": (pipe("orders", s("project", drop=["o_totalprice", "o_orderdate"])), "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"),
    "rename_swap": (pipe("nation", s("rename", map={"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "absent": "x"})), "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation"),
    "drop_columns": (pipe("supplier", s("drop", columns=["s_acctbal", "absent"])), "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "compute_expr": (pipe("lineitem", s("compute", **{"as": "half"}, expr="l_quantity / 2"), s("compute", **{"as": "l_quantity"}, expr="l_quantity + 1"), keep("l_orderkey", "l_partkey", "half", "l_quantity")), "SELECT l_orderkey, l_partkey, l_quantity / 2 AS half, l_quantity + 1 AS l_quantity FROM lineitem"),
    "compute_formula": (pipe("part", s("compute", **{"as": "grade"}, kind="formula", formula='=IF(AND(p_size>20,p_retailprice>=1000),CONCATENATE("big-",p_brand),"small")'), s("compute", **{"as": "biggest"}, kind="formula", formula="=MAX(p_size)-p_size"), keep("p_partkey", "grade", "biggest")), "SELECT p_partkey, CASE WHEN p_size > 20 AND p_retailprice >= 1000 THEN concat('big-', p_brand) ELSE 'small' END AS grade, (max(p_size) OVER () - p_size)::INTEGER AS biggest FROM part"),
    "transform_sequence": (pipe("lineitem", s("transform", compute=[{"as": "net", "expr": "l_extendedprice * (1 - l_discount)"}, {"as": "gross", "expr": "net * (1 + l_tax)"}, {"as": "k", "from": "l_orderkey"}], drop=["l_extendedprice", "l_discount", "l_tax"]), keep("k", "l_partkey", "net", "gross")), "SELECT l_orderkey AS k, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem"),
    "transform_replace": (pipe("events", s("transform", replace=True, compute=[{"as": "id", "from": "event_id"}, {"as": "kind", "expr": "upper(event_type)"}])), "SELECT event_id AS id, upper(event_type) AS kind FROM events"),
    # quality
    "cast_null": (pipe("orders", s("compute", **{"as": "p"}, expr="substr(o_orderpriority, 1, 1)"), s("compute", **{"as": "q"}, expr="substr(o_orderpriority, 2, 1)"), s("cast", casts=[{"field": "p", "to": "int"}, {"field": "q", "to": "float"}, {"field": "o_totalprice", "to": "int"}]), keep("o_orderkey", "p", "q", "o_totalprice")), "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, TRY_CAST(NULLIF(trim(substr(o_orderpriority, 2, 1)), '') AS DOUBLE) AS q, trunc(o_totalprice)::BIGINT AS o_totalprice FROM orders"),
    "cast_skip": (ev(s("compute", **{"as": "p"}, expr="CASE WHEN event_id % 3 = 0 THEN 'x' WHEN event_id % 5 = 0 THEN NULL ELSE '7' END"), s("cast", casts=[{"field": "p", "to": "int", "onError": "skip"}]), keep("event_id", "p")), "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 7::BIGINT END AS p FROM events WHERE event_id % 3 <> 0"),
    "cast_bool_time": (ev(s("compute", **{"as": "b"}, expr="CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'F' WHEN 2 THEN 'yes' ELSE '1' END"), s("compute", **{"as": "t"}, expr="1700000000 + event_id"), s("cast", casts=[{"field": "b", "to": "bool"}, {"field": "t", "to": "timestamp"}, {"field": "user_id", "to": "string"}]), s("compute", **{"as": "t"}, expr="cast(t as timestamp_ntz)"), keep("event_id", "b", "t", "user_id")), "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS b, make_timestamp((1700000000 + event_id) * 1000000) AS t, user_id::VARCHAR AS user_id FROM events"),
    "dropnulls_any": (ev(NULLED, s("compute", **{"as": "w"}, expr="CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 END"), s("dropNulls", columns=["v", "w"]), ID), "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0"),
    "dropnulls_all": (ev(NULLED, s("compute", **{"as": "w"}, expr="CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 END"), s("dropNulls", columns=["v", "w"], any=False), ID), "SELECT event_id FROM events WHERE NOT (event_id % 7 = 0 AND event_id % 5 = 0)"),
    "fillnulls_value": (ev(NULLED, s("fillNulls", columns=["v"], value=-1), keep("event_id", "v")), f"SELECT event_id, coalesce(v, -1) AS v FROM ({NULLED_SQL})"),
    "fillnulls_zero": (ev(NULLED, s("fillNulls", columns=["v"], method="zero"), keep("event_id", "v")), f"SELECT event_id, coalesce(v, 0) AS v FROM ({NULLED_SQL})"),
    "fillnulls_mean": (ev(NULLED, s("fillNulls", columns=["v"], method="mean"), s("compute", **{"as": "v"}, expr=R4("v")), keep("event_id", "v")), f"SELECT event_id, round(coalesce(v, avg(v) OVER ()), 4) AS v FROM ({NULLED_SQL})"),
    "fillnulls_last": (ev(NULLED, s("fillNulls", columns=["v"], method="lastValue", partitionBy=["user_id"], orderBy=["ts"]), keep("event_id", "v")), f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ({NULLED_SQL})"),
    "fillnulls_next": (ev(NULLED, s("fillNulls", columns=["v"], method="nextValue", partitionBy=["user_id"], orderBy=["ts"]), keep("event_id", "v")), f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ({NULLED_SQL})"),
    "dedupe_first": (ev(s("dedupe", by=["user_id", "event_type"], orderBy=[{"field": "value", "dir": "desc"}]), keep("event_id", "user_id")), "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1"),
    "dedupe_last": (ev(s("dedupe", by=["user_id"], keep="last", orderBy=["ts"]), keep("event_id", "user_id")), "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "sample_systematic": (ev(s("sample", method="systematic", n=100), ID), "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () // 100 AS step FROM events) WHERE i % step = 0 AND i / step < 100"),
    "assert_row": (pipe("orders", s("assert", expr="o_totalprice >= 0", message="a price is negative"), keep("o_orderkey")), "SELECT o_orderkey FROM orders"),
    "assert_overall": (pipe("orders", s("assert", scope="overall", expr="count >= 1"), keep("o_orderkey")), "SELECT o_orderkey FROM orders"),
    # reshape
    "flatten_tokens": (pipe("benchmark", s("compute", **{"as": "words"}, expr="split(text, ' ')"), s("flatten", field="words", **{"as": "word"}), s("aggregate", keys=["word"], aggs=[agg("COUNT", "*", "n")])), "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY word"),
    "flatten_index": (pipe("embeddings", s("flatten", field="embedding", indexAs="i"), keep("vec_id", "i", "embedding")), "SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS embedding FROM embeddings"),
    "flatten_keep_empty": (ev(s("compute", **{"as": "a"}, expr="CASE WHEN event_id % 3 = 0 THEN array() WHEN event_id % 3 = 1 THEN NULL ELSE array(user_id, event_id) END"), s("flatten", field="a", **{"as": "x"}, indexAs="i", preserveEmpty=True), keep("event_id", "x", "i")), "SELECT event_id, NULL::BIGINT AS x, NULL::BIGINT AS i FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, CASE i WHEN 0 THEN user_id ELSE event_id END, i FROM events, (VALUES (0::BIGINT), (1)) t(i) WHERE event_id % 3 = 2"),
    "unnest_object": (ev(s("unnestObject", field="props", prefix="p_", drop=True), keep("event_id", "p_k")), "SELECT event_id, (props->>'k')::BIGINT AS p_k FROM events"),
    "nest_records": (ev(s("nest", by=["user_id"], into="events", include=["event_id", "value"]), s("compute", **{"as": "n"}, expr="size(events)"), s("compute", **{"as": "first_id"}, expr="events[0].event_id"), s("compute", **{"as": "ids"}, expr="array_join(transform(events, e -> string(e.event_id)), ',')"), keep("user_id", "n", "first_id", "ids")), "SELECT user_id, count(*)::INTEGER AS n, min(event_id) AS first_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id"),
    "pivot_sum": (ev(s("compute", **{"as": "cents"}, expr="cast(round(value * 100) as bigint)"), s("filter", where={"field": "event_type", "op": "in", "value": ["click", "view"]}), s("pivot", rowKeys=["user_id"], columnKey="event_type", valueField="cents", aggregate="sum", fillValue=0, prefix="n_")), "SELECT user_id, coalesce(sum(c) FILTER (event_type = 'click'), 0)::BIGINT AS n_click, coalesce(sum(c) FILTER (event_type = 'view'), 0)::BIGINT AS n_view FROM (SELECT user_id, event_type, round(value * 100)::BIGINT AS c FROM events WHERE event_type IN ('click', 'view')) GROUP BY user_id"),
    "pivot_first": (pipe("nation", s("compute", **{"as": "odd"}, expr="if(n_nationkey % 2 = 1, 'odd', 'even')"), s("pivot", rowKeys=["n_regionkey"], columnKey="odd", valueField="n_name", fillValue="none")), "SELECT n_regionkey, coalesce(first(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0), 'none') AS even, coalesce(first(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1), 'none') AS odd FROM nation GROUP BY n_regionkey"),
    "unpivot": (pipe("lineitem", s("unpivot", idCols=["l_orderkey", "l_partkey"], valueCols=["l_quantity", "l_tax"], nameAs="what", valueAs="x")), "SELECT l_orderkey, l_partkey, 'l_quantity' AS what, l_quantity AS x FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_tax', l_tax FROM lineitem"),
    # rows
    "distinct_all": (ev(keep("user_id", "event_type"), s("distinct")), "SELECT DISTINCT user_id, event_type FROM events"),
    "distinct_by": (ev(s("distinct", by=["user_id"]), keep("event_id", "user_id", "value")), "SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"),
    "sort_limit": (pipe("orders", s("sort", by=[{"field": "o_totalprice", "dir": "desc"}]), s("limit", n=50), keep("o_orderkey", "o_totalprice")), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "sort_expr_stable": (ev(s("sort", by=["user_id"]), s("sort", by=[{"expr": "length(event_type)", "dir": "desc"}]), s("limit", n=77), ID), "SELECT event_id FROM events ORDER BY length(event_type) DESC, user_id, event_id LIMIT 77"),
    "skip_limit": (pipe("orders", s("sort", by=["o_orderdate"]), s("skip", n=100), s("limit", n=40), keep("o_orderkey")), "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 100"),
    "limit_then_aggregate": (pipe("orders", s("limit", n=500), s("aggregate", aggs=[agg("COUNT", "*", "n"), agg("MAX", "o_orderkey", "top")])), "SELECT count(*) AS n, max(o_orderkey) AS top FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500)"),
    "top_per_group": (pipe("lineitem", s("topPerGroup", n=3, partitionBy=["l_suppkey"], by=[{"field": "l_extendedprice", "dir": "desc"}]), keep("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")), f"SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {', '.join(LINE)}) <= 3"),
    # aggregates
    "agg_core": (pipe("lineitem", s("compute", **{"as": "q"}, expr="cast(l_quantity as bigint)"), s("groupBy", keys=["l_returnflag", "l_linestatus"]), s("aggregate", aggs=[agg("COUNT", "*", "n"), agg("SUM", "q", "total"), agg("AVG", "q", "mean"), agg("MIN", "l_shipdate", "since"), agg("MAX", "l_extendedprice", "top")])), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total, avg(l_quantity::BIGINT) AS mean, min(l_shipdate) AS since, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL"),
    "agg_nulls": (ev(NULLED, s("aggregate", keys=["event_type"], aggs=[agg("COUNT", "v", "n"), agg("MIN", "v", "low")])), f"SELECT event_type, count(v) AS n, min(v) AS low FROM ({NULLED_SQL}) GROUP BY event_type"),
    "agg_stats": (pipe("lineitem", s("aggregate", keys=["l_returnflag"], aggs=[agg("STDEV", "l_quantity", "sd"), agg("VARIANCE", "l_quantity", "var"), agg("MEDIAN", "l_quantity", "mid"), agg("PERCENTILE", "l_extendedprice", "p90", args=[90])]), s("transform", compute=[{"as": c, "expr": R4(c)} for c in ("sd", "var", "p90")])), "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS var, median(l_quantity) AS mid, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL"),
    "agg_first_last": (ev(s("sort", by=[{"field": "ts"}]), s("aggregate", keys=["user_id"], aggs=[agg("FIRST", "event_type", "a"), agg("LAST", "value", "z")])), "SELECT user_id, first(event_type ORDER BY ts, event_id) AS a, last(value ORDER BY ts, event_id) AS z FROM events GROUP BY user_id"),
    "agg_lists": (pipe("nation", s("aggregate", keys=["n_regionkey"], aggs=[agg("STRING_AGG", "n_name", "names", args=["|"]), agg("ARRAY_AGG", "n_nationkey", "ids")]), s("compute", **{"as": "ids"}, expr="to_json(ids)")), "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS ids FROM nation GROUP BY ALL"),
    "agg_conditional": (ev(s("aggregate", keys=["event_type"], aggs=[{"fn": "COUNTIF", "expr": "value > 10", "as": "n"}, {"fn": "SUMIF", "field": "user_id", "expr": "value > 10", "as": "u"}, {"fn": "EXPR", "expr": "max(event_id) - min(event_id)", "as": "span"}, agg("COUNT_DISTINCT", "user_id", "users")])), "SELECT event_type, count(*) FILTER (value > 10) AS n, (sum(user_id) FILTER (value > 10))::BIGINT AS u, max(event_id) - min(event_id) AS span, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"),
    "agg_global": (pipe("orders", s("aggregate", aggs=[agg("COUNT", "", "n"), agg("MIN", "o_orderdate", "first_day")])), "SELECT count(*) AS n, min(o_orderdate) AS first_day FROM orders"),
    "histogram_auto": (pipe("part", s("histogram", field="p_size", bins=7)), "SELECT lo + b * w AS \"binStart\", lo + (b + 1) * w AS \"binEnd\", (SELECT count(*) FROM part WHERE least(floor((p_size - lo) / w), 6) = b) AS count FROM (SELECT min(p_size)::DOUBLE AS lo, (max(p_size)::DOUBLE - min(p_size)) / 7 AS w FROM part), range(7) t(b)"),
    "histogram_bounds": (ev(s("histogram", field="value", bins=4, min=0, max=20, asCount="n", asStart="a", asEnd="z")), "SELECT b * 5.0::DOUBLE AS a, (b + 1) * 5.0::DOUBLE AS z, (SELECT count(*) FROM events WHERE value BETWEEN 0 AND 20 AND least(floor(value / 5.0), 3) = b) AS n FROM range(4) t(b)"),
    # windows
    "window_row_number": (ev(s("window", fn="row_number", partitionBy=["user_id"], orderBy=["ts"], **{"as": "n"}), keep("event_id", "n")), "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"),
    "window_rank": (pipe("part", s("window", fn="rank", partitionBy=["p_brand"], orderBy=[{"field": "p_size", "dir": "desc"}], **{"as": "r"}), s("window", fn="dense_rank", partitionBy=["p_brand"], orderBy=[{"field": "p_size", "dir": "desc"}], **{"as": "d"}), keep("p_partkey", "r", "d")), "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part"),
    "window_lag": (ev(s("window", fn="lag", field="value", default=-1, partitionBy=["user_id"], orderBy=["ts"], **{"as": "p"}), keep("event_id", "p")), "SELECT event_id, lag(value, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events"),
    "window_lead": (ev(s("window", fn="lead", field="event_type", offset=2, partitionBy=["user_id"], orderBy=["ts"], **{"as": "p"}), keep("event_id", "p")), "SELECT event_id, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events"),
    "window_edges": (pipe("orders", s("window", fn="first_value", field="o_orderkey", partitionBy=["o_custkey"], orderBy=["o_orderdate"], **{"as": "a"}), s("window", fn="last_value", field="o_orderkey", partitionBy=["o_custkey"], orderBy=["o_orderdate"], **{"as": "z"}), keep("o_orderkey", "a", "z")), "SELECT o_orderkey, first_value(o_orderkey) OVER w AS a, last_value(o_orderkey) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    # time
    "timebucket_5m": (ev(s("timeBucket", field="ts", interval="5m", **{"as": "t"}), keep("event_id", "t")), "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS t FROM events"),
    "timebucket_1d": (ev(s("timeBucket", field="ts", interval="1d", **{"as": "t"}), s("aggregate", keys=["t"], aggs=[agg("COUNT", "*", "n")])), "SELECT date_trunc('day', ts) AS t, count(*) AS n FROM events GROUP BY 1"),
    "timebucket_origin": (ev(s("timeBucket", field="ts", interval="7d", origin="2024-01-01T00:00:00Z", **{"as": "t"}), keep("event_id", "t")), "SELECT event_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS t FROM events"),
    "timebucket_tz": (ev(s("timeBucket", field="ts", interval="1d", tz="America/New_York", **{"as": "t"}), keep("event_id", "t")), "SELECT event_id, (date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t FROM events"),
    "gapfill_zero": (ev(s("timeBucket", field="ts", interval="6h", **{"as": "t"}), s("aggregate", keys=["event_type", "t"], aggs=[agg("COUNT", "*", "n")]), s("gapfill", field="t", interval="6h", method="zero", groupBy=["event_type"])), f"WITH b AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT event_type, unnest(generate_series(min(t), max(t), {GAP})) AS t FROM b GROUP BY event_type) SELECT event_type, t, coalesce(n, 0) AS n FROM e LEFT JOIN b USING (event_type, t)"),
    "gapfill_last": (ev(s("timeBucket", field="ts", interval="1d", **{"as": "t"}), s("aggregate", keys=["user_id", "t"], aggs=[agg("COUNT", "*", "n"), agg("MAX", "event_id", "m")]), s("gapfill", field="t", interval="1d", method="lastValue", groupBy=["user_id"], carry=["n"])), "WITH b AS (SELECT user_id, date_trunc('day', ts) AS t, count(*) AS n, max(event_id) AS m FROM events GROUP BY ALL), e AS (SELECT user_id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM b GROUP BY user_id) SELECT user_id, t, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n, m FROM e LEFT JOIN b USING (user_id, t)"),
    # joins
    "lookup_left": (pipe("orders", s("lookup", dataset="customer", on={"left": "o_custkey", "right": "c_custkey"}, where={"field": "c_mktsegment", "op": "==", "value": "BUILDING"}, select=["c_name", "c_acctbal"]), keep("o_orderkey", "c_name", "c_acctbal")), "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey"),
    "lookup_inner": (pipe("documents", s("lookup", dataset="labels", on={"left": "doc_id", "right": "doc_id"}, mode="inner", **{"as": "label"}), keep("doc_id", "label_quality", "label_toxic")), "SELECT d.doc_id, quality AS label_quality, toxic AS label_toxic FROM documents d JOIN labels USING (doc_id)"),
    "lookup_last_match": (pipe("customer", s("lookup", dataset="orders", on={"left": "c_custkey", "right": "o_custkey"}, select=["o_orderkey"]), keep("c_custkey", "o_orderkey")), "SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "crossjoin_region": (pipe("nation", s("crossJoin", dataset="region", **{"as": "r"}, select=["r_name"]), keep("n_name", "r_r_name")), "SELECT n_name, r_name AS r_r_name FROM nation, region"),
    "intersect_by": (ev(s("intersect", by=["user_id"], sources=[{"pipe": [where("event_type", "==", "click")]}, {"pipe": [where("event_type", "==", "purchase")]}]), ID), "SELECT event_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')"),
    "intersect_rows": (ev(keep("user_id", "event_type"), s("intersect", sources=[{"pipe": [where("user_id", "<", 60)]}, {"pipe": [where("user_id", ">", 20)]}])), "SELECT user_id, event_type FROM events WHERE user_id > 20 AND user_id < 60"),
    "except_by": (ev(s("except", by=["user_id"], left={"pipe": []}, right={"pipe": [where("value", ">", 30)]}), ID), "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 30)"),
    "merge_union": (ev(s("merge", sources=[{"pipe": [where("event_type", "==", "click"), keep("event_id", "value")]}, {"pipe": [where("value", ">", 10), keep("event_id", "user_id")]}])), "SELECT event_id, value, NULL::BIGINT AS user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, user_id FROM events WHERE value > 10"),
    "merge_order": (ev(keep("event_id"), s("merge", sources=[{"pipe": [s("sort", by=[{"field": "event_id", "dir": "desc"}]), s("limit", n=30)]}, {"pipe": [s("limit", n=30)]}]), s("limit", n=40)), "SELECT event_id FROM (SELECT event_id, 0 AS k, row_number() OVER (ORDER BY event_id DESC) AS i FROM events UNION ALL SELECT event_id, 1, row_number() OVER (ORDER BY event_id) FROM events) WHERE i <= 30 ORDER BY k, i LIMIT 40"),
    "branch_tag": (ev(s("branch", when='event_type == "click"', then=[s("compute", **{"as": "tag"}, expr="'c'")], **{"else": [s("compute", **{"as": "tag"}, expr="'o'"), s("filter", where={"field": "value", "op": ">", "value": 1})]}), keep("event_id", "tag")), "SELECT event_id, CASE WHEN event_type = 'click' THEN 'c' ELSE 'o' END AS tag FROM events WHERE event_type = 'click' OR value > 1"),
    "branch_no_else": (ev(s("branch", when="value > 10", then=[s("groupBy", keys=["user_id"]), s("aggregate", aggs=[agg("COUNT", "*", "n")])]), s("aggregate", aggs=[agg("COUNT", "*", "rows"), agg("SUM", "n", "n")])), "SELECT (SELECT count(DISTINCT user_id) FROM events WHERE value > 10) + (SELECT count(*) FROM events WHERE NOT value > 10) AS rows, (SELECT count(*) FROM events WHERE value > 10) AS n"),
    "stage_from": (ev(s("filter", where={"field": "value", "op": ">", "value": 5}, id="big"), s("aggregate", keys=["event_type"], aggs=[agg("COUNT", "*", "n")]), s("aggregate", keys=["user_id"], aggs=[agg("COUNT", "*", "n")], **{"from": "big"})), "SELECT user_id, count(*) AS n FROM events WHERE value > 5 GROUP BY user_id"),
    "tap_passes": (ev(s("tap", label="all"), where("value", ">", 10), s("tap", label="big"), ID), "SELECT event_id FROM events WHERE value > 10"),
    # sheets
    "sheet_share": (pipe("part", s("sheet", formulas=[{"as": "share", "expr": "p_size / total"}, {"as": "total", "reduce": "sum(p_size)"}, {"as": "n", "reduce": "p_size count"}, {"as": "top", "reduce": "max(p_retailprice)"}]), s("compute", **{"as": "share"}, expr="round(share, 9)"), keep("p_partkey", "share", "n", "top")), "SELECT p_partkey, round(p_size / sum(p_size) OVER (), 9) AS share, count(p_size) OVER () AS n, max(p_retailprice) OVER () AS top FROM part"),
    "sheet_order": (pipe("lineitem", s("sheet", formulas=[{"as": "margin", "expr": "net / gross"}, {"as": "net", "expr": "gross * (1 - l_discount)"}, {"as": "gross", "expr": "l_quantity * 10"}]), s("compute", **{"as": "margin"}, expr="round(margin, 6)"), keep("l_orderkey", "l_partkey", "margin")), "SELECT l_orderkey, l_partkey, round(l_quantity * 10 * (1 - l_discount) / (l_quantity * 10), 6) AS margin FROM lineitem"),
    "sheet_null_errors": (ev(s("sheet", onError="null", formulas=[{"as": "r", "expr": "1000 div (user_id % 3)"}, {"as": "n", "reduce": "count(r)"}]), keep("event_id", "r", "n")), "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1000 // (user_id % 3) END AS r, count(CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1 END) OVER () AS n FROM events"),
    "sheet_after_window": (ev(s("window", fn="lag", field="value", default=0, partitionBy=["user_id"], orderBy=["ts"], **{"as": "prev"}), s("sheet", formulas=[{"as": "delta", "expr": "round(value - prev, 6)"}, {"as": "up", "expr": "delta > 0"}]), keep("event_id", "delta", "up")), "SELECT event_id, round(value - p, 6) AS delta, round(value - p, 6) > 0 AS up FROM (SELECT *, lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"),
    # host
    "call_function": (ev(s("callFunction", name="text::shout", pure=True, args={"kind": "$event_type"}, **{"as": "loud"}), keep("event_id", "loud")), "SELECT event_id, upper(event_type) || '!' AS loud FROM events"),
    "call_function_spread": (ev(s("callFunction", name="parts"), keep("event_id", "whole", "even")), "SELECT event_id, trunc(value)::BIGINT AS whole, event_id % 2 = 0 AS even FROM events"),
    "call_function_batch": (ev(s("callFunction", name="doubled", mode="batch", args={"by": 2}), keep("event_id", "twice")), "SELECT event_id, event_id * 2 AS twice FROM events"),
    "call_app": (ev(s("callApp", appId="scorer", payload={"mod": 5}), keep("event_id", "score")), "SELECT event_id, event_id % 5 AS score FROM events"),
    "algo_minmax": (pipe("part", s("algo", name="minmax_scale", params={"columns": ["p_retailprice"]}), s("compute", **{"as": "p_retailprice"}, expr="round(p_retailprice, 9)"), keep("p_partkey", "p_retailprice")), "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS p_retailprice FROM part"),
    "algo_robust_zscore": (pipe("part", s("algo", name="robust_zscore", params={"field": "p_size", "as": "z"}), s("compute", **{"as": "z"}, expr="round(z, 6)"), keep("p_partkey", "z")), "WITH m AS (SELECT median(p_size) AS m FROM part), d AS (SELECT median(abs(p_size - m)) AS d FROM part, m) SELECT p_partkey, round((p_size - m) / (1.4826::DOUBLE * d), 6) AS z FROM part, m, d"),
    # clauses
    **{f"classic_join_{how}": ({"from": "orders", "join": [{"dataset": "customer", "type": how, "on": {"left": "orders.o_custkey", "right": "customer.c_custkey"}}], "select": ["o_orderkey", "c_custkey", "c_name"]}, f"SELECT o_orderkey, c_custkey, c_name FROM orders {how.upper()} JOIN customer ON o_custkey = c_custkey") for how in ("inner", "left", "right", "full")},
    "classic_join_cross": ({"from": "nation", "join": [{"dataset": "region", "type": "cross"}], "select": ["n_name", "r_name"]}, "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "classic_join_two": ({"from": "customer", "join": [{"dataset": "nation", "on": {"left": "customer.c_nationkey", "right": "nation.n_nationkey"}}, {"dataset": "region", "alias": "r", "on": {"left": "nation.n_regionkey", "right": "r.r_regionkey"}}], "groupBy": ["r_name"], "aggregate": [agg("COUNT", "*", "n")]} | {"join": [{"dataset": "nation", "on": {"left": "customer.c_nationkey", "right": "nation.n_nationkey"}}, {"dataset": "region", "alias": "r", "on": {"left": "n_regionkey", "right": "r.r_regionkey"}}]}, "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "classic_having": ({"from": "orders", "groupBy": ["o_custkey"], "aggregate": [agg("COUNT", "*", "n"), agg("MAX", "o_totalprice", "top")], "having": {"field": "n", "op": ">=", "value": 12}, "orderBy": [{"field": "n", "dir": "desc"}]}, "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) >= 12"),
    "classic_computed": ({"from": "lineitem", "computed": [{"name": "net", "expr": "l_quantity * 2"}, {"name": "more", "expr": "net + 1"}], "where": {"field": "more", "op": ">", "value": 90}, "select": ["l_orderkey", "l_partkey", {"field": "more", "as": "m"}]}, "SELECT l_orderkey, l_partkey, l_quantity * 2 + 1 AS m FROM lineitem WHERE l_quantity * 2 + 1 > 90"),
    "classic_paging": ({"from": "orders", "select": ["o_orderkey", "o_totalprice"], "orderBy": [{"field": "o_totalprice", "dir": "DESC"}], "offset": 20, "limit": 30}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20"),
    "classic_parameters": ({"from": "events", "where": {"and": [{"field": "event_type", "op": "==", "value": "$kind"}, {"field": "value", "op": ">", "value": "$least"}]}, "parameters": {"$kind": "view", "$least": 7}, "select": ["event_id"]}, "SELECT event_id FROM events WHERE event_type = 'view' AND value > 7"),
    "classic_versioned": ({"from": "versioned", "select": ["event_id"]}, "SELECT event_id FROM events WHERE event_id % 3 <> 0"),
    "classic_all_versions": ({"from": "versioned", "where": {"field": "_is_current", "op": "==", "value": False}, "select": ["event_id"]}, "SELECT event_id FROM events WHERE event_id % 3 = 0"),
    # text
    "text_pipeline": ('source events | where value > 5 | compute big = `value > 20` | groupBy event_type, big | aggregate count(*) as n, max(user_id) as u | sort n desc', "SELECT event_type, value > 20 AS big, count(*) AS n, max(user_id) AS u FROM events WHERE value > 5 GROUP BY ALL"),
    "text_reshape": ("source lineitem | select l_orderkey as k, l_partkey, l_quantity, l_tax | unpivot l_quantity, l_tax to (what, x) | where what == l_tax | rename x -> tax | drop what", "SELECT l_orderkey AS k, l_partkey, l_tax AS tax FROM lineitem"),
    "text_page": ("source orders | sort o_totalprice desc | skip 10 | limit 20 | select o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10"),
    "text_distinct": ("source events | tap all | distinct by user_id | tap firsts | select event_id, user_id", "SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id"),
    "text_flatten": ("source benchmark | compute words = `split(text, ' ')` | flatten words as word | groupBy word | aggregate count(*) as n", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY word"),
    "text_calls": ('source events | callFunction text::shout pure args {"kind": "$event_type"} as loud | callApp scorer {"mod": 7} | select event_id, loud, score', "SELECT event_id, upper(event_type) || '!' AS loud, event_id % 7 AS score FROM events"),
    "text_pivot": ("source nation | compute odd = `if(n_nationkey % 2 = 1, 'odd', 'even')` | pivot odd, max(n_nationkey) for n_regionkey", "SELECT n_regionkey, max(n_nationkey) FILTER (n_nationkey % 2 = 1) AS odd, max(n_nationkey) FILTER (n_nationkey % 2 = 0) AS even FROM nation GROUP BY n_regionkey"),
    "text_nest": ("source events | nest by user_id into theirs include event_id | compute n = `size(theirs)` | compute last = `theirs[n - 1].event_id` | select user_id, n, last", "SELECT user_id, count(*)::INTEGER AS n, max(event_id) AS last FROM events GROUP BY user_id"),
    "text_unnest": ("source events | unnestObject props prefix p_ drop | select event_id, p_k", "SELECT event_id, (props->>'k')::BIGINT AS p_k FROM events"),
    # all rows as one group
    "compute_formula_sum": (pipe("part", s("compute", **{"as": "share"}, kind="formula", formula="=p_size/SUM(p_size)"), s("compute", **{"as": "far"}, kind="formula", formula="=MAX(p_size-MIN(p_size))"), s("compute", **{"as": "share"}, expr="round(share, 9)"), keep("p_partkey", "share", "far")), "SELECT p_partkey, round(p_size / sum(p_size) OVER (), 9) AS share, (max(p_size) OVER () - min(p_size) OVER ())::INTEGER AS far FROM part"),
    "sample_ratio": (ev(s("sample", ratio=0.35, seed=3), s("aggregate", aggs=[agg("COUNT", "*", "n"), agg("COUNT_DISTINCT", "event_id", "keys")])), "SELECT floor(count(*) * 0.35::DOUBLE)::BIGINT AS n, floor(count(*) * 0.35::DOUBLE)::BIGINT AS keys FROM events"),
    "skip_alone": (pipe("orders", s("sort", by=["o_orderdate"]), s("skip", n=200), keep("o_orderkey")), "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 200"),
    "window_all_rows": (
        ev(*(s("window", fn=fn, orderBy=[{"field": "user_id", "dir": "desc"}], **{"as": a}, **more) for fn, a, more in (("row_number", "n", {}), ("rank", "r", {}), ("dense_rank", "d", {}), ("lag", "p", {"field": "value", "default": -1}), ("lead", "q", {"field": "event_id", "offset": 3}), ("first_value", "f", {"field": "event_id"}), ("last_value", "z", {"field": "event_id"}))), keep("event_id", "n", "r", "d", "p", "q", "f", "z")),
        "SELECT event_id, row_number() OVER w AS n, rank() OVER (ORDER BY user_id DESC) AS r, dense_rank() OVER (ORDER BY user_id DESC) AS d, lag(value, 1, -1) OVER w AS p, lead(event_id, 3) OVER w AS q, first_value(event_id) OVER (ORDER BY user_id DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(event_id) OVER (ORDER BY user_id DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM events WINDOW w AS (ORDER BY user_id DESC, event_id)"),
    "fillnulls_all_rows": (ev(NULLED, s("compute", **{"as": "w"}, expr="v"), s("fillNulls", columns=["v"], method="lastValue", orderBy=["ts"]), s("fillNulls", columns=["w"], method="nextValue", orderBy=["ts"]), keep("event_id", "v", "w")), f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM ({NULLED_SQL})"),
    "kmeans_nulls": (pipe("part", s("compute", **{"as": "x"}, expr="CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END"), s("algo", name="kmeans", params={"columns": ["x", "p_retailprice"], "k": 3}), s("aggregate", aggs=[agg("COUNT", "*", "n"), agg("COUNT", "cluster", "placed"), agg("COUNT_DISTINCT", "cluster", "clusters")])), "SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 <> 0) AS placed, 3::BIGINT AS clusters FROM part"),
    "cast_fail_good": (ev(s("compute", **{"as": "p"}, expr="cast(event_id as string)"), s("cast", casts=[{"field": "p", "to": "int", "onError": "fail"}]), keep("event_id", "p")), "SELECT event_id, event_id AS p FROM events"),
    "agg_count_distinct": (ev(s("aggregate", keys=["event_type"], aggs=[agg("COUNT_DISTINCT", "user_id", "users")])), "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "agg_approx_distinct": (ev(s("aggregate", keys=["event_type"], aggs=[agg("APPROX_COUNT_DISTINCT", "user_id", "about"), agg("COUNT_DISTINCT", "user_id", "users")]), s("compute", **{"as": "near"}, expr="abs(about - users) <= 0.2 * users"), keep("event_type", "users", "near")), "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type"),
    "union_distinct": (ev(keep("user_id"), s("merge", sources=[{"pipe": [where("user_id", "<", 60)]}, {"pipe": [where("user_id", ">", 20)]}]), s("distinct")), "SELECT user_id FROM events WHERE user_id < 60 UNION SELECT user_id FROM events WHERE user_id > 20"),
    "duration_expr": (ev(s("compute", **{"as": "later"}, expr='ts + duration("1h30m")'), keep("event_id", "later")), "SELECT event_id, ts + INTERVAL 90 MINUTE AS later FROM events"),
    "gapfill_no_keys": (ev(s("timeBucket", field="ts", interval="10m", **{"as": "t"}), s("aggregate", keys=["t"], aggs=[agg("COUNT", "*", "n"), agg("MAX", "event_id", "m")]), s("gapfill", field="t", interval="10m", method="zero")), "WITH b AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS t, count(*) AS n, max(event_id) AS m FROM events GROUP BY ALL), e AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 10 MINUTE)) AS t FROM b) SELECT t, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM e LEFT JOIN b USING (t)"),
    "gapfill_no_keys_last": (ev(s("timeBucket", field="ts", interval="10m", **{"as": "t"}), s("aggregate", keys=["t"], aggs=[agg("COUNT", "*", "n"), agg("MAX", "event_id", "m")]), s("gapfill", field="t", interval="10m", method="lastValue")), "WITH b AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS t, count(*) AS n, max(event_id) AS m FROM events GROUP BY ALL), e AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 10 MINUTE)) AS t FROM b) SELECT t, last_value(n IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS n, last_value(m IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS m FROM e LEFT JOIN b USING (t)"),
    "flagship": (pipe("lineitem", where("l_shipdate", "<=", "1998-09-02"), s("transform", compute=[{"as": "disc_price", "expr": f"cast(l_extendedprice * (1 - l_discount) as {DEC})"}, {"as": "price", "expr": f"cast(l_extendedprice as {DEC})"}, {"as": "qty", "expr": "cast(l_quantity as bigint)"}]), s("groupBy", keys=["l_returnflag", "l_linestatus"]), s("aggregate", aggs=[agg("SUM", "qty", "sum_qty"), agg("SUM", "price", "sum_base_price"), agg("SUM", "disc_price", "sum_disc_price"), agg("COUNT", "*", "count_order")]), s("transform", compute=[{"as": c, "expr": f"round(double({c}), 2)"} for c in ("sum_base_price", "sum_disc_price")]), s("sort", by=["l_returnflag", "l_linestatus"])), "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, round(sum(l_extendedprice::DECIMAL(18,4))::DOUBLE, 2) AS sum_base_price, round(sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE, 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
}

for _direction, _op in (("backward", ">="), ("forward", "<="), ("nearest", "")):
    _doc = ev(where("event_type", "==", "click"), s("asofJoin", dataset="events", leftTime="ts", rightTime="ts", leftKey="user_id", rightKey="user_id", direction=_direction, where={"field": "event_type", "op": "==", "value": "view"}, select=["event_id"], **{"as": "v"}), keep("event_id", "v_event_id"))
    _side = lambda op: f"SELECT c.event_id, c.ts, v.event_id AS r, v.ts AS rt FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.ts {op} v.ts"
    _sql = f"SELECT event_id, r AS v_event_id FROM ({_side(_op)})" if _op else f"SELECT b.event_id, CASE WHEN b.r IS NULL THEN a.r WHEN a.r IS NULL OR b.ts - b.rt <= a.rt - a.ts THEN b.r ELSE a.r END AS v_event_id FROM ({_side('>=')}) b JOIN ({_side('<=')}) a USING (event_id)"
    DOCS[f"asof_{_direction}"] = (_doc, _sql)
DOCS["asof_tolerance"] = (
    ev(where("event_type", "==", "click"), s("asofJoin", dataset="events", leftTime="ts", rightTime="ts", leftKey="user_id", rightKey="user_id", tolerance="12h", where={"field": "event_type", "op": "==", "value": "view"}, select=["event_id"], **{"as": "v"}), keep("event_id", "v_event_id")),
    DOCS["asof_backward"][1].replace("r AS v_event_id", "CASE WHEN ts - rt <= INTERVAL 12 HOUR THEN r END AS v_event_id"),
)


def run(doc: dict[str, Any] | str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(context(spark, sf_dir)).execute(doc).df


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = {"from": "orders", "select": ["o_orderkey"]}
    return Engine(context(spark, sf_dir)).execute(doc, scope=[ScopeColumn("o_orderstatus", "F", required=True)]).df


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = {"from": "audited", "select": ["event_id", "created_by"], "expand": True}
    return Engine(context(spark, sf_dir)).execute(doc).df.select("event_id", F.col("_meta.created_by.name").alias("author"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(context(spark, sf_dir)).execute(ev(s("sample", n=100, seed=42), ID)).df


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(context(spark, sf_dir)).execute(pipe("part", s("algo", name="kmeans", params={"columns": ["p_size", "p_retailprice"], "k": 3}), keep("p_partkey", "cluster"))).df


HOT = ("fillnulls_last", "fillnulls_next", "asof_backward", "asof_forward", "asof_nearest")


def hot(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query with every key of over 10 rows spread over many tasks."""
    return lambda spark, sf_dir: Engine(replace(context(spark, sf_dir), hot_rows=10)).execute(DOCS[name][0]).df


def given_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0")
    return Engine(context(spark, sf_dir)).execute({"mode": "pipe", "pipe": [where("o_totalprice", ">", 100), keep("o_orderkey")]}, on=rows).df


def joined_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that only the joined dataset has restricts its rows alone."""
    doc = {"from": "customer", "join": [{"dataset": "orders", "type": "left", "on": {"left": "customer.c_custkey", "right": "orders.o_custkey"}}], "select": ["c_custkey", "o_orderkey"]}
    return Engine(context(spark, sf_dir)).execute(doc, scope=[ScopeColumn("o_orderstatus", "F")]).df


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Engine(context(spark, sf_dir)).explain("source orders | where o_totalprice > 100 | sort o_orderkey | limit 3")
    return spark.createDataFrame([(i, op, "PushedFilters" in plan["plan"]) for i, op in enumerate(plan["steps"])], "place long, op string, pushed boolean")


def through_files(kind: str, **read: str) -> Callable[[SparkSession, str], DataFrame]:
    """The orders, written to files of that kind in the shared folder and read as a dataset."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
        path = scratch(orders, f"orders-{kind}", kind, header="true") if kind == "csv" else scratch(orders, f"orders-{kind}", kind)
        d = Datasets().files("orders", path, kind, dict(read), schema=orders.schema, key=("o_orderkey",))
        return Engine(Context(spark, d)).execute("source orders | where o_totalprice > 1000").df

    return run


def from_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("pipeloom_orders_view")
    return Engine(Context(spark, Datasets().table("orders", "pipeloom_orders_view", key=("o_orderkey",)))).execute("source orders | where o_totalprice > 1000 | select o_orderkey").df


def as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(context(spark, sf_dir)).execute("source orders | select o_orderkey, o_orderstatus | limit 50").to_json()


def own_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = context(spark, sf_dir)
    ctx.add_reduce("um", "max")
    ctx.add_reduce("spread", "1 + count")
    doc = pipe("part", s("sheet", formulas=[{"as": "t", "reduce": "sum(p_size)"}, {"as": "m", "reduce": "um(p_size)"}, {"as": "c", "reduce": "spread(p_size)"}]), keep("p_partkey", "t", "m", "c"))
    return Engine(ctx).execute(doc).df


def sheet_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = ev(s("sheet", onError="null", formulas=[{"as": "r", "expr": "1000 div (user_id % 3)"}, {"as": "w", "expr": "r + 1"}]))
    got = Engine(context(spark, sf_dir)).execute(doc).errors()
    return spark.createDataFrame([(k, n, got["total"], len(got["samples"])) for k, n in got["by_formula"].items()], "formula string, n long, total long, samples long")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The app scores once; the rest runs again over the rows kept."""
    doc = ev(where("value", ">", 5), s("callApp", appId="scorer", payload={"mod": 4}), s("filter", where={"field": "score", "op": "<", "value": 3}), s("aggregate", keys=["score"], aggs=[agg("COUNT", "*", "n"), agg("MAX", "event_id", "m")]))
    return prime(Engine(context(spark, sf_dir)), doc).replay().df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(doc) for name, (doc, _) in DOCS.items()} | {
    "classic_scope": scoped, "expand_meta": expanded, "sample_random": sampled, "algo_kmeans": clustered, "given_rows": given_rows, "classic_scope_join": joined_scope, "explain_steps": explained, "sheet_own_reduce": own_reduce,
    "sheet_errors": sheet_errors, "replay_from_stage": replayed, "source_csv": through_files("csv", header="true"), "source_json": through_files("json"), "source_orc": through_files("orc"), "source_table": from_view, "result_json": as_json, **{f"{n}_hot": hot(n) for n in HOT},
}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in DOCS.items()} | {
    "classic_scope": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "given_rows": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice > 100",
    "classic_scope_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey",
    "explain_steps": "SELECT * FROM (VALUES (0::BIGINT, 'filter', true), (1, 'sort', true), (2, 'limit', true)) t(place, op, pushed)",
    "sheet_own_reduce": "SELECT p_partkey, (sum(p_size) OVER ())::BIGINT AS t, max(p_size) OVER () AS m, 1 + count(p_size) OVER () AS c FROM part",
    "sheet_errors": "SELECT f AS formula, CASE f WHEN 'r' THEN n ELSE 0 END AS n, n AS total, least(n, 100) AS samples FROM (SELECT count(*) AS n FROM events WHERE user_id % 3 = 0), (VALUES ('r'), ('w')) t(f)",
    "replay_from_stage": "SELECT event_id % 4 AS score, count(*) AS n, max(event_id) AS m FROM events WHERE value > 5 AND event_id % 4 < 3 GROUP BY 1",
    **dict.fromkeys(("source_csv", "source_json", "source_orc"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000"),
    "source_table": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000",
    "result_json": "SELECT to_json({o_orderkey: o_orderkey, o_orderstatus: o_orderstatus})::VARCHAR AS value FROM orders ORDER BY o_orderkey LIMIT 50",
    **{f"{n}_hot": DOCS[n][1] for n in HOT},
    "expand_meta": "SELECT event_id, c_name AS author FROM events LEFT JOIN customer ON user_id = c_custkey",
}
