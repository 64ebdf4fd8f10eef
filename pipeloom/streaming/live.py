"""Live queries: pipes that run again as rows arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipeloom.functions.expr import interval_us
from pipeloom.operators.registry import QueryError
from pipeloom.plans import parse
from pipeloom.plans.catalog import CATALOG
from pipeloom.plans.engine import Engine, Result
from pipeloom.plans.frame import Frame
from pipeloom.plans.pipe import run_stages
from pipeloom.sources.scratch import written

#: Operators that Spark runs on an unbounded stream as they are.
ROW_WISE = frozenset("filter project rename drop compute transform cast dropNulls flatten unpivot tap callFunction lookup".split())


def sub_pipes(stage: dict[str, Any]) -> list[list[dict[str, Any]]]:
    out = [stage[k] for k in ("then", "else") if stage.get(k)]
    out += [s.get("pipe") or [] for s in stage.get("sources") or []]
    return out + [stage[k].get("pipe") or [] for k in ("left", "right") if isinstance(stage.get(k), dict)]


def is_live_safe(stages: list[dict[str, Any]]) -> bool:
    """True if running the stages again has no side effects: calls of functions only if pure, of apps never."""
    return all((CATALOG[s["op"]].live or s["op"] == "callFunction" and bool(s.get("pure"))) and all(map(is_live_safe, sub_pipes(s))) for s in stages)


def split_live(stages: list[dict[str, Any]]) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """(what runs once, what runs again): the cut is after the last stage with side effects."""
    last = max((i for i, s in enumerate(stages) if not is_live_safe([s])), default=-1)
    return stages[: last + 1], stages[last + 1 :]


@dataclass
class Primed:
    """A pipe whose stages with side effects have run once: their rows are a table, from which the rest runs again. Named stages
    of the first part that the rest reads are kept too."""

    engine: Engine
    doc: dict[str, Any]
    at: int
    frame: Frame
    named: dict[str, Frame]

    def replay(self) -> Result:
        """The stages from `at` on, over the kept rows. Nothing before them runs, nor does any with side effects."""
        stages = self.doc["pipe"][self.at :]
        ctx = self.engine.running()
        f = run_stages(self.frame, stages, ctx, named=dict(self.named))
        return Result(f, self.doc.get("from") or "", stages=stages, observed=[None] * (len(stages) + 1), taps=ctx.taps, sheets=ctx.sheets)


def prime(engine: Engine, doc: str | dict[str, Any], parameters: dict[str, Any] | None = None, on: DataFrame | None = None) -> Primed:
    """Runs a pipe up to its last stage with side effects and writes the rows there, in the shared folder."""
    q = engine.bound(doc, parameters, on)
    head, tail = split_live(q.get("pipe") or [])
    wanted = {s["from"] for s in tail if s.get("from")} - {s.get("id") for s in tail}
    named: dict[str, Frame] = {}
    ctx = engine.running()
    f = run_stages(engine.start(q, ctx, on), head, ctx, lambda i, s, g: named.update({s["id"]: g} if s.get("id") in wanted else {}))
    keep = lambda g: g.with_df(written(g.df, "primed"))
    last = next((s.get("id") for s in reversed(head)), None)
    kept = keep(f)
    return Primed(engine, q, len(head), kept, {n: kept if n == last else keep(g) for n, g in named.items()})


def stream(engine: Engine, doc: str | dict[str, Any], rows: DataFrame, time: str, watermark: str, window: str, slide: str | None = None) -> DataFrame:
    """A pipe on a streaming DataFrame: row-wise stages, then at most one aggregate, by event-time windows of `window` (sliding by
    `slide`), with rows later than `watermark` left out. Adds window_start and window_end."""
    q = parse.load(doc)
    stages = q.get("pipe") or []
    at = next((i for i, s in enumerate(stages) if s["op"] in ("groupBy", "aggregate")), len(stages))
    head, tail = stages[:at], stages[at:]
    bad = [s["op"] for s in head if s["op"] not in ROW_WISE]
    keys = [k for s in tail if s["op"] == "groupBy" for k in s["keys"]]
    aggs = [s for s in tail if s["op"] == "aggregate"]
    if bad or len(aggs) > 1 or len(tail) > 1 + (tail[:1] != [] and tail[0]["op"] == "groupBy"):
        raise QueryError(f"a stream takes row-wise stages and one aggregate, not {', '.join(bad) or 'what follows it'}")
    df = engine.execute({**q, "mode": "pipe", "pipe": head}, on=rows).df
    if not aggs:
        return df
    from pipeloom.functions.aggregates import aggregate

    spark_time = lambda text: f"{interval_us(text) // 1000} milliseconds"
    w = F.window(F.col(time).cast("timestamp"), spark_time(window), spark_time(slide or window))
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, spark_time(watermark))
    made = [aggregate(df, {"as": a["fn"].lower(), **a}, []) for a in aggs[0]["aggs"]]
    out = df.groupBy(w.alias("_w"), *(keys or aggs[0].get("keys") or [])).agg(*made)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(c for c in out.columns if c != "_w"))


def sessions(rows: DataFrame, time: str, watermark: str, gap: str, keys: list[str]) -> DataFrame:
    """Counts by session: a session ends after `gap` without a row of its keys."""
    ms = lambda text: f"{interval_us(text) // 1000} milliseconds"
    df = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ms(watermark))
    out = df.groupBy(F.session_window(time, ms(gap)).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "rows")


def subscribe(engine: Engine, doc: str | dict[str, Any], rows: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Runs a live-safe pipe on each batch of arriving rows and hands the result on."""
    q = parse.load(doc)
    if not is_live_safe(q.get("pipe") or []):
        raise QueryError("the pipe has stages with side effects; run those once, and the rest (split_live) again")

    def each(batch: DataFrame, number: int) -> None:
        on_change(engine.execute(q, on=batch).ordered(), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
