"""intersect, except, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipeloom.operators.registry import QueryError, cols, register
from pipeloom.plans.frame import Frame, union


def related(a: Frame, b: Frame, by: list[str], how: str) -> Frame:
    """Rows of a with (left_semi) or without (left_anti) an equal row in b; nulls are equal, repeated rows of a stay."""
    names = by or a.columns
    cols(a, names)
    missing = [n for n in names if n not in b.columns]
    right = b.df.select(*(F.col(f"`{n}`").alias(f"_r{i}") if n not in missing else F.lit(None).alias(f"_r{i}") for i, n in enumerate(names))).distinct()
    on = reduce(Column.__and__, (F.col(f"`{n}`").eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)))
    return a.with_df(a.df.join(right, on, how))


@register("intersect")
def intersect(f: Frame, cfg: dict, ctx) -> Frame:
    if len(cfg["sources"]) < 2:
        raise QueryError("intersect needs two sources or more")
    parts = [ctx.sub_pipe(f, s["pipe"]) for s in cfg["sources"]]
    return reduce(lambda a, b: related(a, b, cfg.get("by") or [], "left_semi"), parts)


@register("except")
def except_(f: Frame, cfg: dict, ctx) -> Frame:
    return related(ctx.sub_pipe(f, cfg["left"]["pipe"]), ctx.sub_pipe(f, cfg["right"]["pipe"]), cfg.get("by") or [], "left_anti")


@register("merge")
def merge(f: Frame, cfg: dict, ctx) -> Frame:
    if not cfg["sources"]:
        raise QueryError("merge needs sources")
    return union([ctx.sub_pipe(f, s["pipe"]) for s in cfg["sources"]])
