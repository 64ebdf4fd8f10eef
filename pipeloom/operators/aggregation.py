"""groupBy, aggregate, histogram."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeloom.functions.aggregates import aggregate as column_of
from pipeloom.operators.registry import QueryError, cols, known, register
from pipeloom.plans.frame import Frame


@register("groupBy")
def group_by(f: Frame, cfg: dict, ctx) -> Frame:
    """Rows pass; the keys count for the next aggregate."""
    cols(f, cfg["keys"])
    ctx.group_keys = list(cfg["keys"])
    return f


@register("aggregate")
def aggregate(f: Frame, cfg: dict, ctx) -> Frame:
    keys = cfg.get("keys") or getattr(ctx, "group_keys", None) or []
    ctx.group_keys = None
    if not cfg["aggs"]:
        raise QueryError("aggregate needs aggs")
    order = f.order_columns()
    made = [column_of(f.df, {"as": a.get("fn", "").lower(), **a}, order) for a in cfg["aggs"]]
    df = f.df.groupBy(*cols(f, keys)).agg(*made) if keys else f.df.agg(*made)
    return Frame(df, tuple((k, True) for k in keys))


@register("histogram")
def histogram(f: Frame, cfg: dict, ctx) -> Frame:
    """All bins, also empty ones; the last one holds the upper edge. Bounds that aren't given come from one pass over the column."""
    bins = cfg["bins"]
    if not isinstance(bins, int) or bins < 1:
        raise QueryError("histogram: bins must be a whole number from 1")
    v = known(f, cfg["field"]).cast("double")
    lo, hi = cfg.get("min"), cfg.get("max")
    if lo is None or hi is None:
        r = f.df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        lo, hi = (r["lo"] if lo is None else lo), (r["hi"] if hi is None else hi)
    if lo is None or hi is None or hi <= lo:
        raise QueryError("histogram: the upper bound must exceed the lower one")
    width = (hi - lo) / bins
    start, end, count = cfg.get("asStart") or "binStart", cfg.get("asEnd") or "binEnd", cfg.get("asCount") or "count"
    held = f.df.select(v.alias("v")).filter((F.col("v") >= lo) & (F.col("v") <= hi)).select(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    every = f.df.sparkSession.range(bins).withColumnRenamed("id", "b")
    out = every.join(held, "b", "left").select((F.lit(float(lo)) + F.col("b") * width).alias(start), (F.lit(float(lo)) + (F.col("b") + 1) * width).alias(end), F.coalesce("n", F.lit(0)).alias(count))
    return Frame(out, ((start, True),))
