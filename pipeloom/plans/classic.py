"""Queries by clauses: scope, joins, computed, where, groups, having, order, page, select."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from pipeloom.functions.aggregates import aggregate
from pipeloom.functions.expr import column
from pipeloom.functions.where import condition, field
from pipeloom.operators.registry import QueryError, sort_spec
from pipeloom.operators.rows import offset, sort
from pipeloom.operators.shape import project
from pipeloom.plans.context import mentions_version
from pipeloom.plans.frame import Frame

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def source(q: dict[str, Any]) -> str:
    f = q.get("from")
    return f if isinstance(f, str) else (f or {}).get("dataset") or ""


def run(q: dict[str, Any], ctx, start: Frame | None = None, page: bool = True) -> Frame:
    """start: rows to use instead of the source's. Names of a joined dataset that the rows have already get its alias and _ before them."""
    f = start or ctx.dataset(source(q), mentions_version(q.get("where")))
    for j in q.get("join") or []:
        f = joined(f, j, ctx, source(q))
    for c in q.get("computed") or []:
        f = f.set_column(c["name"], column(c["expr"]))
    if q.get("where"):
        f = f.with_df(f.df.filter(condition(f.df, q["where"])))
    keys, aggs = q.get("groupBy") or [], q.get("aggregate") or []
    if keys or aggs:
        made = [aggregate(f.df, {"as": a.get("fn", "").lower(), **a}, f.order_columns()) for a in aggs]
        columns = [field(f.df, k)[0].alias(k.rsplit(".", 1)[-1]) for k in keys]
        df = f.df.groupBy(*columns)
        df = df.agg(*made) if made else f.df.select(*columns).distinct()
        f = Frame(df, tuple((k.rsplit(".", 1)[-1], True) for k in keys))
    if q.get("having"):
        if not keys and not aggs:
            raise QueryError("having needs groupBy or aggregate")
        f = f.with_df(f.df.filter(condition(f.df, q["having"])))
    if q.get("orderBy"):
        sort_spec(f, q["orderBy"])
        f = sort(f, {"by": q["orderBy"]}, ctx)
    if page and (q.get("offset") or q.get("limit") is not None):
        limited = q.get("limit") is not None
        f = offset(f, q["offset"], limited) if q.get("offset") else f.with_df(f.sorted())
        f = f.with_df(f.df.limit(q["limit"])) if limited else f
    select = [s for s in q.get("select") or [] if s != "*"]
    if q.get("select") and not (aggs or keys) or select and any(isinstance(s, dict) for s in select):
        f = project(f, {"select": [s if isinstance(s, dict) else {"field": s if s in f.columns else s.rsplit(".", 1)[-1], "as": None} for s in q["select"]]}, ctx) if "*" not in q["select"] or select else f
    return f


def joined(f: Frame, j: dict[str, Any], ctx, primary: str) -> Frame:
    how = (j.get("type") or "inner").lower()
    right = ctx.dataset(j["dataset"], joined=True)
    alias = j.get("alias") or j["dataset"]
    strip = lambda name: name.split(".", 1)[1] if name.split(".", 1)[0] in (alias, primary, j["dataset"]) and "." in name else name
    names = {c: f"{alias}_{c}" if c in f.df.columns else c for c in right.columns}
    r = right.df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    if how == "cross":
        return f.with_df(f.df.crossJoin(r))
    if how not in HOW:
        raise QueryError(f"unknown join type {how!r}")
    left, right_col = strip(j["on"]["left"]), strip(j["on"]["right"])
    if left not in f.df.columns or right_col not in names:
        raise QueryError(f"join with {j['dataset']}: no column {left if left not in f.df.columns else right_col!r}")
    out = f.df.join(r, F.col(f"`{left}`") == F.col(f"`{names[right_col]}`"), HOW[how])
    order = [*f.order, *((names[n], up) for n, up in right.order if n in names)]
    return Frame(out, tuple(order))
