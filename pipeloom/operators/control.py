"""branch, tap."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pipeloom.functions.expr import truthy_expr
from pipeloom.operators.registry import register
from pipeloom.plans.frame import Frame, union


@register("branch")
def branch(f: Frame, cfg: dict, ctx) -> Frame:
    """Rows for which `when` is truthy take `then`, the others `else`; without else they pass, or go with dropElse."""
    yes = truthy_expr(f.df, cfg["when"])
    then = ctx.sub_pipe(f.with_df(f.df.filter(yes)), cfg["then"])
    if not cfg.get("else") and cfg.get("dropElse"):
        return then
    rest = f.with_df(f.df.filter(~yes))
    return union([then, ctx.sub_pipe(rest, cfg["else"]) if cfg.get("else") else rest])


@register("tap")
def tap(f: Frame, cfg: dict, ctx) -> Frame:
    label = cfg.get("label") or f"tap{len(ctx.taps)}"
    if f.df.isStreaming:
        return f
    seen = Observation(f"{label}-{len(ctx.taps)}")
    ctx.taps[label] = seen
    return f.with_df(f.df.observe(seen, F.count(F.lit(1)).alias("rows")))
