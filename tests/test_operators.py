"""Each operator over generated rows, against a few lines of Python that say what it means."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest

from pipeloom import Callable_, Context, Datasets, Engine, QueryError

START = dt.datetime(2031, 3, 1)
T = lambda h, m, s=0: START + dt.timedelta(hours=h, minutes=m, seconds=s)
COLUMNS = "i long, g string, n long, x double, word string, at timestamp_ntz, tags array<string>"


def made(count=120, seed=1):
    """Rows with a key i, groups, tied numbers, measures with nulls, words, times and lists."""
    r = random.Random(seed)
    out = []
    for i in range(count):
        tags = None if r.random() < 0.1 else [r.choice("uvw") for _ in range(r.randint(0, 3))]
        out.append({
            "i": i, "g": r.choice(["north", "south", "east", None]), "n": r.randint(-4, 12), "x": None if r.random() < 0.25 else r.randint(0, 400) / 8, "word": r.choice(["12", "-7", "3.5", "kiwi", "", "true", None]),
            "at": START + dt.timedelta(seconds=r.randint(0, 86_400)), "tags": tags,
        })
    return out


ROWS = made()


@pytest.fixture(scope="module")
def ctx(spark):
    table = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(3, "n")
    d = Datasets().frame("t", table(ROWS), key=("i",)).frame("other", table(made(60, 2)), key=("i",))
    return Context(spark, d)


def run(ctx, *stages, source="t"):
    return Engine(ctx).execute({"from": source, "pipe": list(stages)}).rows


def s(op, **cfg):
    return {"op": op, **{k.rstrip("_"): v for k, v in cfg.items()}}


def only(rows, *names):
    return [{n: r[n] for n in names} for r in rows]


def nulls_first(v):
    return (v is not None, v if v is not None else 0)


def groups(rows, *names):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[n] for n in names)].append(r)
    return out


# columns
def test_columns_are_chosen_renamed_and_dropped(ctx):
    assert run(ctx, s("project", select=["n", {"field": "i", "as": "key"}, {"expr": "n * n", "as": "square"}])) == [{"n": r["n"], "key": r["i"], "square": r["n"] ** 2} for r in ROWS]
    assert run(ctx, s("project", drop=["tags", "at", "x", "word"])) == only(ROWS, "i", "g", "n") == run(ctx, s("drop", columns=["tags", "at", "x", "word", "absent"]))
    with pytest.raises(QueryError):
        run(ctx, s("project", select=["i"], drop=["n"]))
    got = run(ctx, s("project", select=["i", "n"]), s("rename", map={"i": "n", "n": "i"}))
    assert got == [{"n": r["i"], "i": r["n"]} for r in ROWS]


def test_order_outlives_the_columns_it_goes_by(ctx):
    want = [r["i"] for r in sorted(ROWS, key=lambda r: -r["n"])][:7]
    assert [r["i"] for r in run(ctx, s("sort", by=[{"field": "n", "dir": "desc"}]), s("drop", columns=["n"]), s("limit", n=7))] == want
    assert [r["i"] for r in run(ctx, s("sort", by=[{"field": "n", "dir": "desc"}]), s("compute", as_="n", expr="0"), s("limit", n=7))] == want


def test_computed_columns_see_those_before(ctx):
    got = run(ctx, s("transform", compute=[{"as": "a", "expr": "n + 1"}, {"as": "b", "expr": "a * a"}, {"as": "c", "from": "g"}], drop=["x", "word", "at", "tags"]))
    assert got == [{"i": r["i"], "g": r["g"], "n": r["n"], "a": r["n"] + 1, "b": (r["n"] + 1) ** 2, "c": r["g"]} for r in ROWS]
    assert run(ctx, s("transform", replace=True, compute=[{"as": "k", "from": "i"}, {"as": "d", "expr": "k % 5"}])) == [{"k": r["i"], "d": r["i"] % 5} for r in ROWS]


def test_formulas_over_rows_and_columns(ctx):
    """Aggregates of one argument are over all rows, also within others; those of several are within the row."""
    f = lambda as_, text: s("compute", as_=as_, kind="formula", formula=text)
    got = run(ctx, f("share", "=n/SUM(n)"), f("far", "=MAX(ABS(n-AVERAGE(n)))"), f("row", "=SUM(i,n)*10%"), f("kind", '=IF(n<>0, g&"/"&n, "none")'), f("root", "=SQRT(i^2)"))
    total, mean = sum(r["n"] for r in ROWS), statistics.mean(r["n"] for r in ROWS)
    for g, r in zip(got, ROWS, strict=True):
        assert (g["share"], g["far"], g["row"], g["root"]) == pytest.approx((r["n"] / total, max(abs(x["n"] - mean) for x in ROWS), (r["i"] + r["n"]) / 10, r["i"]))
        assert g["kind"] == ("none" if r["n"] == 0 else None if r["g"] is None else f"{r['g']}/{r['n']}")


def test_no_row_gathers_all_others(ctx, spark):
    """Aggregates over all rows come as one broadcast row: no window, and no exchange of the rows to one partition."""
    df = Engine(ctx).execute({"from": "t", "pipe": [s("compute", as_="share", kind="formula", formula="=n/SUM(n)"), s("sheet", formulas=[{"as": "top", "reduce": "max(n)"}])]}).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan


# rows
def test_sorting_is_stable(ctx):
    got = run(ctx, s("sort", by=["g"]), s("sort", by=[{"expr": "n % 3"}]))
    assert [r["i"] for r in got] == [r["i"] for r in sorted(sorted(ROWS, key=lambda r: (r["g"] is not None, r["g"] or "")), key=lambda r: r["n"] - 3 * int(r["n"] / 3))]


@pytest.mark.parametrize("skip, limit", [(0, 5), (7, 3), (118, 10), (500, 1), (9, 0)])
def test_pages(ctx, skip, limit):
    order = sorted(ROWS, key=lambda r: (-r["n"], r["i"]))
    by = s("sort", by=[{"field": "n", "dir": "desc"}])
    assert run(ctx, by, s("skip", n=skip), s("limit", n=limit)) == order[skip : skip + limit]
    assert run(ctx, by, s("skip", n=skip)) == order[skip:]
    assert run(ctx, by, s("limit", n=limit), s("skip", n=skip)) == order[:limit][skip:]


def test_a_page_sorts_once(ctx):
    doc = {"from": "t", "pipe": [s("sort", by=["n"]), s("skip", n=5), s("limit", n=5)]}
    plan = Engine(ctx).execute(doc).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1


def test_distinct_and_dedupe(ctx):
    firsts = {}
    for r in ROWS:
        firsts.setdefault((r["g"], r["n"] % 2), r)
    assert run(ctx, s("compute", as_="odd", expr="abs(n % 2)"), s("distinct", by=["g", "odd"]), s("drop", columns=["odd"])) == sorted(firsts.values(), key=lambda r: r["i"])
    assert sorted(map(str, run(ctx, s("project", select=["g", "n"]), s("distinct")))) == sorted({str(x) for x in only(ROWS, "g", "n")})
    for keep, pick in (("first", min), ("last", max)):
        want = {k: pick(v, key=lambda r: (r["n"], r["i"]))["i"] for k, v in groups(ROWS, "g").items()}
        assert {(r["g"],): r["i"] for r in run(ctx, s("dedupe", by=["g"], keep=keep, orderBy=["n"]))} == want


def test_top_of_each_group(ctx):
    want = {r["i"] for v in groups(ROWS, "g").values() for r in sorted(v, key=lambda r: (-r["n"], r["i"]))[:4]}
    assert {r["i"] for r in run(ctx, s("topPerGroup", n=4, partitionBy=["g"], by=[{"field": "n", "dir": "desc"}]))} == want


def test_samples(ctx):
    a, b, c = (run(ctx, s("sample", n=25, seed=k)) for k in (5, 5, 6))
    assert a == b != c and len({r["i"] for r in a}) == 25
    for ratio in (0.1, 0.5, 1):
        got = run(ctx, s("sample", ratio=ratio, seed=5))
        assert len(got) == int(120 * ratio) and got == run(ctx, s("sample", n=int(120 * ratio), seed=5))
    assert [r["i"] for r in run(ctx, s("sample", n=10, method="systematic"))] == list(range(0, 120, 12))
    with pytest.raises(QueryError):
        run(ctx, s("sample", n=1, ratio=0.5))


def test_sample_of_a_share_uses_many_tasks(ctx):
    plan = Engine(ctx).execute({"from": "t", "pipe": [s("sample", ratio=0.5)]}).df._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan


# windows and groups
def test_windows_in_partitions(ctx):
    by = [{"field": "n", "dir": "desc"}]
    w = lambda fn, as_, **more: s("window", fn=fn, partitionBy=["g"], orderBy=by, as_=as_, **more)
    got = run(ctx, w("row_number", "a"), w("rank", "b"), w("dense_rank", "c"), w("lag", "d", field="i", offset=2, default=-1), w("lead", "e", field="x"), w("first_value", "f", field="i"), w("last_value", "h", field="i"))
    want = {}
    for v in groups(ROWS, "g").values():
        v = sorted(v, key=lambda r: (-r["n"], r["i"]))
        for k, r in enumerate(v):
            above = [x["n"] for x in v if x["n"] > r["n"]]
            want[r["i"]] = (k + 1, len(above) + 1, len(set(above)) + 1, v[k - 2]["i"] if k > 1 else -1, v[k + 1]["x"] if k + 1 < len(v) else None, v[0]["i"], v[-1]["i"])
    assert {r["i"]: tuple(r[c] for c in "abcdefh") for r in got} == want


def test_aggregates(ctx):
    fn = lambda name, as_, field=None, **more: {"fn": name, "as": as_, **({"field": field} if field else {}), **more}
    got = run(ctx, s("sort", by=[{"field": "n", "dir": "desc"}]), s("groupBy", keys=["g"]), s("aggregate", aggs=[
        fn("COUNT", "rows", "*"), fn("count", "xs", "x"), fn("SUM", "sum", "x"), fn("AVG", "avg", "x"), fn("MIN", "min", "x"), fn("MAX", "max", "x"), fn("MEDIAN", "median", "x"), fn("STDEV", "sd", "n"),
        fn("FIRST", "first", "i"), fn("LAST", "last", "i"), fn("ARRAY_AGG", "list", "i"), fn("STRING_AGG", "text", "i", args=["+"]), fn("COUNT_DISTINCT", "kinds", "n"), fn("COUNTIF", "many", expr="n > 5"), fn("SUMIF", "most", "n", expr="n > 5"),
    ]))
    assert len(got) == 4
    for r in got:
        v = sorted((x for x in ROWS if x["g"] == r["g"]), key=lambda x: (-x["n"], x["i"]))
        xs, ids = [x["x"] for x in v if x["x"] is not None], [x["i"] for x in v]
        assert (r["rows"], r["xs"], r["min"], r["max"], r["first"], r["last"], r["list"], r["text"], r["kinds"]) == (len(v), len(xs), min(xs), max(xs), ids[0], ids[-1], ids, "+".join(map(str, ids)), len({x["n"] for x in v}))
        assert (r["sum"], r["avg"], r["median"], r["sd"]) == pytest.approx((sum(xs), statistics.mean(xs), statistics.median(xs), statistics.stdev(x["n"] for x in v)))
        assert (r["many"], r["most"]) == (sum(x["n"] > 5 for x in v), sum(x["n"] for x in v if x["n"] > 5) or r["most"])


def test_histogram(ctx):
    got = run(ctx, s("histogram", field="n", bins=5, min=-4, max=11))
    inside = [r["n"] for r in ROWS if -4 <= r["n"] <= 11]
    assert [r["count"] for r in got] == [sum(min((v + 4) // 3, 4) == b for v in inside) for b in range(5)]
    with pytest.raises(QueryError):
        run(ctx, s("filter", where={"field": "n", "op": "==", "value": 3}), s("histogram", field="n", bins=4))


# quality
def test_nulls_are_dropped_and_filled(ctx):
    assert run(ctx, s("dropNulls", columns=["g", "x"])) == [r for r in ROWS if r["g"] is not None and r["x"] is not None]
    assert run(ctx, s("dropNulls", columns=["g", "x"], any=False)) == [r for r in ROWS if r["g"] is not None or r["x"] is not None]
    mean = statistics.mean(r["x"] for r in ROWS if r["x"] is not None)
    for cfg, value in (({"value": -1}, -1), ({"method": "zero"}, 0), ({"method": "mean"}, mean)):
        assert [r["x"] for r in run(ctx, s("fillNulls", columns=["x"], **cfg))] == pytest.approx([value if r["x"] is None else r["x"] for r in ROWS])
    for method, step in (("lastValue", 1), ("nextValue", -1)):
        for part in ([], ["g"]):
            want = {}
            for v in groups(ROWS, *part).values():
                kept = None
                for r in sorted(v, key=lambda r: (r["n"], r["i"]))[::step]:
                    kept = r["x"] if r["x"] is not None else kept
                    want[r["i"]] = kept
            got = run(ctx, s("fillNulls", columns=["x"], method=method, orderBy=["n"], **({"partitionBy": part} if part else {})))
            assert {r["i"]: r["x"] for r in got} == want, (method, part)


def test_casts(ctx):
    whole = {"12": 12, "-7": -7}
    to = lambda policy: s("cast", casts=[{"field": "word", "to": "int", "onError": policy}])
    assert [r["word"] for r in run(ctx, to("null"))] == [whole.get(r["word"]) for r in ROWS]
    assert [r["i"] for r in run(ctx, to("skip"))] == [r["i"] for r in ROWS if r["word"] is None or r["word"] in whole]
    with pytest.raises(Exception, match="cast: word is no int"):
        run(ctx, to("fail"))
    good = s("filter", where={"field": "word", "op": "in", "value": ["12", "-7"]})
    assert [r["word"] for r in run(ctx, good, to("fail"))] == [whole[r["word"]] for r in ROWS if r["word"] in whole]
    floats = {"12": 12.0, "-7": -7.0, "3.5": 3.5}
    assert [r["word"] for r in run(ctx, s("cast", casts=[{"field": "word", "to": "float"}]))] == [floats.get(r["word"]) for r in ROWS]


def test_assertions(ctx):
    assert run(ctx, s("assert", expr="n >= -4")) == ROWS
    with pytest.raises(Exception, match="n is low"):
        run(ctx, s("assert", expr="n >= 0", message="n is low"))
    assert len(run(ctx, s("assert", scope="overall", expr="count = 120"))) == 120
    with pytest.raises(AssertionError):
        run(ctx, s("assert", scope="overall", expr="count < 120"))


# shapes
def test_lists_are_flattened(ctx):
    want = [{"i": r["i"], "tag": t, "at": k} for r in ROWS for k, t in enumerate(r["tags"] or [])]
    keep = s("project", select=["i", "tag", "at"])
    assert run(ctx, s("flatten", field="tags", as_="tag", indexAs="at"), keep) == want
    got = run(ctx, s("flatten", field="tags", as_="tag", indexAs="at", preserveEmpty=True), keep)
    assert got == [x for r in ROWS for x in ([{"i": r["i"], "tag": t, "at": k} for k, t in enumerate(r["tags"] or [])] or [{"i": r["i"], "tag": None, "at": None}])]
    assert run(ctx, s("flatten", field="n")) == []


def test_nesting_undoes_flattening(ctx):
    got = run(ctx, s("flatten", field="tags"), s("nest", by=["i"], into="all", include=["tags"]))
    assert got == [{"i": r["i"], "all": [{"tags": t} for t in r["tags"]]} for r in ROWS if r["tags"]]


def test_pivot_and_unpivot(ctx):
    names = sorted(str(v).replace("None", "null") for v in {r["g"] for r in ROWS})
    got = run(ctx, s("pivot", rowKeys=["n"], columnKey="g", valueField="i", aggregate="sum", fillValue=0))
    assert got == [{"n": n, **{c: sum(r["i"] for r in ROWS if r["n"] == n and (r["g"] or "null") == c) for c in names}} for n in sorted({r["n"] for r in ROWS})]
    back = run(ctx, s("unpivot", idCols=["i"], valueCols=["n", "x"], nameAs="what", valueAs="v"))
    assert back == [{"i": r["i"], "what": c, "v": None if r[c] is None else float(r[c])} for r in ROWS for c in ("n", "x")]


def test_objects_spread(ctx, spark):
    inner = s("compute", as_="o", expr="named_struct('low', n - 1, 'word', word)")
    got = run(ctx, inner, s("unnestObject", field="o", prefix="o_", drop=True), s("project", select=["o_low", "o_word"]))
    assert got == [{"o_low": r["n"] - 1, "o_word": r["word"]} for r in ROWS]
    maps = s("compute", as_="m", expr="map(concat('k', abs(n % 3)), i)")
    got = run(ctx, maps, s("unnestObject", field="m", drop=True), s("project", select=["k0", "k1", "k2"]))
    assert got == [{f"k{k}": r["i"] if abs(r["n"]) % 3 == k else None for k in range(3)} for r in ROWS]


def test_too_many_columns_are_refused(spark):
    wide = spark.range(10_001).selectExpr("id", "map(cast(id as string), id) AS m", "cast(id as string) AS c")
    for stage in (s("unnestObject", field="m"), s("pivot", rowKeys=[], columnKey="c", valueField="id")):
        with pytest.raises(QueryError, match="over 10000 columns"):
            Engine(Context(spark)).execute({"mode": "pipe", "pipe": [stage]}, on=wide)


# time
@pytest.mark.parametrize("interval, seconds", [("7m", 420), ("1h30m", 5400), ("1d", 86_400)])
def test_buckets(ctx, interval, seconds):
    epoch = dt.datetime(1970, 1, 1)
    got = run(ctx, s("timeBucket", field="at", interval=interval, as_="b"))
    assert [r["b"] for r in got] == [epoch + dt.timedelta(seconds=(r["at"] - epoch).total_seconds() // seconds * seconds) for r in ROWS]
    with pytest.raises(Exception, match="is no time"):
        run(ctx, s("timeBucket", field="word", interval=interval, as_="b"))
    with pytest.raises(ValueError):
        run(ctx, s("timeBucket", field="at", interval="0d", as_="b"))


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("method", ["zero", "lastValue", "null", "value"])
def test_gaps_are_filled(ctx, spark, method, keys):
    """One row an hour and group at most, all on the hour; the hours between come in."""
    seen, rows = set(), []
    for r in ROWS:
        hour = r["at"].replace(minute=0, second=0)
        if r["i"] % 3 == 0 and (hour, *(r[k] for k in keys)) not in seen:
            seen.add((hour, *(r[k] for k in keys)))
            rows.append({**r, "at": hour})
    want = []
    for v in groups(rows, *keys).values():
        at, end, by_hour, last = min(r["at"] for r in v), max(r["at"] for r in v), {r["at"]: r for r in v}, None
        while at <= end:
            r = by_hour.get(at)
            filled = {"zero": 0, "value": 5, "null": None, "lastValue": last and last["n"]}[method]
            want.append((v[0]["g"] if keys else None, at, r["n"] if r else filled, r["i"] if r else {"zero": 0, "value": 5, "null": None, "lastValue": last and last["i"]}[method]))
            last, at = r or last, at + dt.timedelta(hours=1)
    df = spark.createDataFrame([(r["i"], r["g"], r["n"], r["at"]) for r in rows], "i long, g string, n long, at timestamp_ntz").repartition(4)
    got = Engine(Context(spark, Datasets().frame("r", df, key=("i",)))).execute({"from": "r", "pipe": [s("gapfill", field="at", interval="1h", method=method, groupBy=keys, **({"value": 5} if method == "value" else {}))]}).rows
    order = lambda x: (x[0] is not None, x[0] or "", x[1])
    assert [(r["g"] if keys else None, r["at"], r["n"], r["i"]) for r in got] == sorted(want, key=order)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, "40m"])
def test_nearest_in_time(ctx, direction, tolerance):
    """By key and without ever pairing rows; null keys match null keys, the last right row of one time counts."""
    right = made(60, 2)
    got = run(ctx, s("asofJoin", dataset="other", leftTime="at", rightTime="at", leftKey="g", rightKey="g", direction=direction, select=["i"], as_="o", **({"tolerance": tolerance} if tolerance else {})))
    for r in got:
        best = {}
        for o in right:
            if o["g"] == r["g"]:
                best[o["at"]] = o["i"]
        past, ahead = [t for t in best if t <= r["at"]], [t for t in best if t >= r["at"]]
        a, b = max(past, default=None), min(ahead, default=None)
        t = {"backward": a, "forward": b, "nearest": b if a is None else a if b is None or r["at"] - a <= b - r["at"] else b}[direction]
        if t is not None and tolerance and abs(t - r["at"]) > dt.timedelta(minutes=40):
            t = None
        assert r["o_i"] == (None if t is None else best[t]), r


# other rows
def test_lookups(ctx):
    last = {}
    for o in made(60, 2):
        last[o["n"]] = o["i"]
    on = {"left": "n", "right": "n"}
    assert [r["o_i"] for r in run(ctx, s("lookup", dataset="other", on=on, select=["i"], as_="o"))] == [last.get(r["n"]) for r in ROWS]
    got = run(ctx, s("lookup", dataset="other", on=on, mode="inner", select=["i"], as_="o", cacheTtlMs=60_000))
    assert [(r["i"], r["o_i"]) for r in got] == [(r["i"], last[r["n"]]) for r in ROWS if r["n"] in last]
    assert len(ctx.lookups) == 1
    ctx.release()
    assert not ctx.lookups
    pairs = run(ctx, s("project", select=["i"]), s("crossJoin", dataset="other", select=["i"], as_="o", limit=3))
    assert pairs == [{"i": r["i"], "o_i": k} for r in ROWS for k in range(3)]


def test_sets_and_branches(ctx):
    big, odd = s("filter", where={"expr": "n > 4"}), s("filter", where={"expr": "i % 2 = 1"})
    ns = {r["n"] for r in ROWS if r["i"] % 2 and r["n"] > 4}
    assert [r["i"] for r in run(ctx, s("intersect", by=["n"], sources=[{"pipe": [big]}, {"pipe": [odd]}]))] == [r["i"] for r in ROWS if r["n"] > 4 and r["n"] in ns]
    assert [r["i"] for r in run(ctx, s("except", by=["n"], left={"pipe": [odd]}, right={"pipe": [big]}))] == [r["i"] for r in ROWS if r["i"] % 2 and r["n"] <= 4]
    assert [r["i"] for r in run(ctx, s("merge", sources=[{"pipe": [odd]}, {"pipe": [big]}]))] == [r["i"] for r in ROWS if r["i"] % 2] + [r["i"] for r in ROWS if r["n"] > 4]
    mark = lambda v: s("compute", as_="mark", expr=f"'{v}'")
    got = run(ctx, s("branch", when="n > 4", then=[mark("big")], else_=[mark("small"), odd]), s("project", select=["i", "mark"]))
    assert got == [{"i": r["i"], "mark": "big"} for r in ROWS if r["n"] > 4] + [{"i": r["i"], "mark": "small"} for r in ROWS if r["n"] <= 4 and r["i"] % 2]
    assert {r["i"] for r in run(ctx, s("branch", when="n > 4", then=[odd], dropElse=True))} == {r["i"] for r in ROWS if r["n"] > 4 and r["i"] % 2}


def test_conditions_follow_three_valued_logic(ctx):
    low = lambda r: r["x"] is not None and not r["x"] > 20
    assert run(ctx, s("filter", where={"not": {"field": "x", "op": ">", "value": 20}})) == [r for r in ROWS if low(r)]
    assert run(ctx, s("filter", where={"field": "n", "op": "between", "value": ["2", 6]})) == [r for r in ROWS if 2 <= r["n"] <= 6]
    with pytest.raises(QueryError, match="between"):
        run(ctx, s("filter", where={"field": "n", "op": "between", "value": [2]}))
    inner = s("compute", as_="o", expr="if(n > 0, named_struct('g', g), null)")
    assert [r["i"] for r in run(ctx, inner, s("filter", where={"field": "o.g", "op": "==", "value": "east"}))] == [r["i"] for r in ROWS if r["n"] > 0 and r["g"] == "east"]


# sheets and the host
def test_sheets_run_in_the_order_of_references(ctx):
    ctx.reduces["um"] = "max"
    try:
        got = run(ctx, s("sheet", formulas=[{"as": "rel", "expr": "up / total"}, {"as": "up", "expr": "i + 1"}, {"as": "total", "reduce": "sum(up)"}, {"as": "n2", "reduce": "n count"}, {"as": "most", "reduce": "um(n)"}]))
    finally:
        ctx.reduces.clear()
    total = sum(r["i"] + 1 for r in ROWS)
    assert [(r["rel"], r["total"], r["n2"], r["most"]) for r in got] == [(pytest.approx((r["i"] + 1) / total), total, 120, max(x["n"] for x in ROWS)) for r in ROWS]
    with pytest.raises(QueryError, match="p, q"):
        run(ctx, s("sheet", formulas=[{"as": "p", "expr": "q * 2"}, {"as": "q", "expr": "p * 2"}, {"as": "z", "expr": "p"}]))
    with pytest.raises(QueryError, match="no column missing"):
        run(ctx, s("sheet", formulas=[{"as": "p", "expr": "missing * 2"}]))


def test_sheet_errors_are_counted(ctx):
    doc = {"from": "t", "pipe": [s("sheet", onError="null", formulas=[{"as": "a", "expr": "100 div n"}, {"as": "b", "expr": "x / n"}, {"as": "c", "expr": "a + 1"}])]}
    r = Engine(ctx).execute(doc)
    zero = [x for x in ROWS if x["n"] == 0]
    assert [x["a"] is None for x in r.rows] == [x["n"] == 0 for x in ROWS]
    got = r.errors()
    with_x = [x for x in zero if x["x"] is not None]
    assert got["by_formula"] == {"a": len(zero), "b": len(with_x), "c": 0} and got["total"] == len(zero) + len(with_x)
    assert [(e["formula"], e["row"]["i"]) for e in got["samples"]] == [("a", x["i"]) for x in zero] + [("b", x["i"]) for x in with_x]
    assert len(r.errors(samples=2)["samples"]) == 2 and r.errors(samples=2)["total"] == got["total"]
    with pytest.raises(Exception, match="(?i)zero"):
        run(ctx, s("sheet", formulas=[{"as": "a", "expr": "100 div n"}]))


def test_functions_and_apps_of_the_host(ctx, spark):
    own = Context(spark, ctx.datasets)
    own.functions["area"] = Callable_(lambda r: {"side": r["n"], "area": r["n"] ** 2}, "side bigint, area bigint")
    own.apps["ratio"] = Callable_(lambda r, p: {"i": r["i"], "of": r["i"] / p["by"]}, "i bigint, of double")
    got = run(own, s("callFunction", name="geo::area"), s("project", select=["side", "area"]))
    assert got == [{"side": r["n"], "area": r["n"] ** 2} for r in ROWS]
    assert run(own, s("callApp", appId="ratio", batch=False, payload={"by": 4})) == [{"i": r["i"], "of": r["i"] / 4} for r in ROWS]
    with pytest.raises(QueryError):
        run(own, s("algo", name="unheard-of"))


def test_windows_over_all_rows_in_many_parts(spark):
    """Parts are cut within groups of equal keys, and values cross them."""
    rows = [{"i": i, "k": i * 37 % 101 % 17, "v": None if i % 3 else i} for i in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "i long, k long, v long").repartition(7)
    ctx = Context(spark, Datasets().frame("t", df, key=("i",)))
    by = [{"field": "k", "dir": "desc"}]
    stages = [
        s("window", fn="row_number", orderBy=by, as_="n"), s("window", fn="rank", orderBy=by, as_="r"), s("window", fn="dense_rank", orderBy=by, as_="d"),
        s("window", fn="lag", field="i", orderBy=by, offset=2, default=-1, as_="p"), s("window", fn="lead", field="v", orderBy=by, as_="q"),
        s("window", fn="first_value", field="i", orderBy=by, as_="a"), s("window", fn="last_value", field="i", orderBy=by, as_="z"),
        s("compute", as_="w", expr="v"), s("fillNulls", columns=["w"], method="lastValue", orderBy=by), s("compute", as_="x", expr="v"), s("fillNulls", columns=["x"], method="nextValue", orderBy=by),
    ]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["i"]: r for r in Engine(ctx).execute({"from": "t", "pipe": stages}).rows}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda r: (-r["k"], r["i"]))
    kinds = sorted({-r["k"] for r in rows})
    last = None
    for n, r in enumerate(order):
        g = got[r["i"]]
        last = r["v"] if r["v"] is not None else last
        after = next((x["v"] for x in order[n:] if x["v"] is not None), None)
        want = (n + 1, 1 + sum(x["k"] > r["k"] for x in rows), kinds.index(-r["k"]) + 1, order[n - 2]["i"] if n > 1 else -1, order[n + 1]["v"] if n < 299 else None, order[0]["i"], order[-1]["i"], last, after)
        assert tuple(g[c] for c in "nrdpqazwx") == want


def test_asof_without_a_key(spark):
    left = spark.createDataFrame([(i, T(i % 24, i % 60)) for i in range(100)], "i long, t timestamp_ntz").repartition(5)
    right = spark.createDataFrame([(j, T(j % 24, j * 7 % 60, 30)) for j in range(40)], "j long, u timestamp_ntz").repartition(3)
    ctx = Context(spark, Datasets().frame("l", left, key=("i",)).frame("r", right, key=("j",)))
    rs = sorted((r["u"], r["j"]) for r in right.collect())
    for direction in ("backward", "forward", "nearest"):
        doc = {"from": "l", "pipe": [s("asofJoin", dataset="r", leftTime="t", rightTime="u", direction=direction)]}
        for r in Engine(ctx).execute(doc).rows:
            b = max((x for x in rs if x[0] <= r["t"]), default=None)
            a = min((x for x in rs if x[0] >= r["t"]), default=None, key=lambda x: (x[0], -x[1]))
            near = b if a is None or b and r["t"] - b[0] <= a[0] - r["t"] else a
            assert r["j"] == ((x := {"backward": b, "forward": a, "nearest": near}[direction]) and x[1]), direction


def test_hot_keys_are_spread_with_the_same_result(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", T(i % 24, i * 7 % 60), None if i % 4 else i) for i in range(240)]
    left = spark.createDataFrame(rows, "i long, k string, t timestamp_ntz, v long").repartition(6)
    right = spark.createDataFrame([(j, "hot" if j % 2 else f"k{j % 7}", T(j % 24, j % 60, 30)) for j in range(90)], "j long, rk string, u timestamp_ntz").repartition(3)
    stages = [s("asofJoin", dataset="r", leftTime="t", rightTime="u", leftKey="k", rightKey="rk", direction=d, as_=d, select=["j"]) for d in ("backward", "forward", "nearest")]
    stages += [s("compute", as_="w", expr="v"), s("fillNulls", columns=["v"], method="lastValue", partitionBy=["k"], orderBy=["t"]), s("fillNulls", columns=["w"], method="nextValue", partitionBy=["k"], orderBy=["t"])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [sorted(map(str, Engine(Context(spark, Datasets().frame("l", left, key=("i",)).frame("r", right, key=("j",)), hot_rows=n)).execute({"from": "l", "pipe": stages}).rows)) for n in (10, 10**6)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] and len(got[0]) == 240


def test_kmeans_keeps_incomplete_rows(spark):
    from pipeloom.plans.context import kmeans

    rows = [(1, 0.0, 1), (2, 0.1, 1), (3, 9.0, 8), (4, 9.1, 8), (5, None, 1), (6, float("nan"), 1), (7, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    got = {r["id"]: r["cluster"] for r in kmeans(df, {"columns": ["x", "y"], "k": 2}).collect()}
    assert set(got) == set(range(1, 8)) and got[5] is got[6] is got[7] is None
    assert got[1] == got[2] != got[3] == got[4] and None not in (got[1], got[3])
    assert [r["cluster"] for r in kmeans(df.where("id = 5"), {"columns": ["x", "y"]}).collect()] == [None]
