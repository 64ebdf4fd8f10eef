"""filter, project, rename, drop, compute, transform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipeloom.functions.expr import column, formula
from pipeloom.functions.where import condition
from pipeloom.operators.registry import QueryError, known, register
from pipeloom.plans.frame import Frame


@register("filter")
def filter_(f: Frame, cfg: dict, ctx) -> Frame:
    return f.with_df(f.df.filter(condition(f.df, cfg["where"])))


@register("project")
def project(f: Frame, cfg: dict, ctx) -> Frame:
    if cfg.get("select") and cfg.get("drop"):
        raise QueryError("project takes select or drop, not both")
    if cfg.get("drop"):
        return drop(f, {"columns": cfg["drop"]}, ctx)
    columns, names, same = [], [], []
    for s in cfg["select"]:
        s = {"field": s} if isinstance(s, str) else s
        if s.get("field") == "*":
            columns += [F.col(f"`{c}`") for c in f.columns]
            names += f.columns
            same += f.columns
            continue
        name = s.get("as") or s.get("field")
        if not name:
            raise QueryError("an expression in select needs a name in as")
        columns.append((column(s["expr"]) if s.get("expr") else known(f, s["field"])).alias(name))
        names.append(name)
        same += [name] if s.get("field") == name and not s.get("expr") else []
    return f.select(columns, names, same)


@register("rename")
def rename(f: Frame, cfg: dict, ctx) -> Frame:
    """All pairs at once, so that names can be swapped; a name that a pair takes hides a column that had it."""
    pairs = {a: b for a, b in cfg["map"].items() if a in f.df.columns}
    taken = set(pairs.values())
    columns = [(c, pairs.get(c, c)) for c in f.columns if c in pairs or c not in taken]
    f = f.keeping_order(c for c in f.columns if c in taken and c not in pairs)
    hidden = [c for c in f.df.columns if c.startswith("__ord_")]
    order = tuple((pairs.get(n, n), up) for n, up in f.order)
    return Frame(f.df.select(*(F.col(f"`{a}`").alias(b) for a, b in columns), *hidden), order)


@register("drop")
def drop(f: Frame, cfg: dict, ctx) -> Frame:
    f = f.keeping_order(cfg["columns"])
    return f.with_df(f.df.drop(*cfg["columns"]))


@register("compute")
def compute(f: Frame, cfg: dict, ctx) -> Frame:
    kind = cfg.get("kind") or "expr"
    if kind not in ("expr", "formula"):
        raise QueryError(f"compute: unknown kind {kind!r}")
    if kind == "expr":
        return f.set_column(cfg["as"], column(cfg["expr"]))
    value, wholes = formula(cfg["formula"])
    waiting: dict[str, Column] = {}
    for n, sql in wholes.items():
        if any(f"`{w}`" in sql for w in waiting):  # an aggregate within another
            f, waiting = with_row(f, waiting), {}
        waiting[n] = F.expr(sql)
    f = with_row(f, waiting).set_column(cfg["as"], value)
    return f.with_df(f.df.drop(*wholes))


def with_row(f: Frame, aggregates: dict[str, Column]) -> Frame:
    """f with a column for each aggregate over all its rows: one row, broadcast, where a window would gather all rows in one task."""
    if not aggregates:
        return f
    return f.with_df(f.df.crossJoin(F.broadcast(f.df.agg(*(c.alias(n) for n, c in aggregates.items())))))


@register("transform")
def transform(f: Frame, cfg: dict, ctx) -> Frame:
    made = []
    for c in cfg["compute"]:
        f = f.set_column(c["as"], column(c["expr"]) if c.get("expr") else known(f, c["from"]))
        made.append(c["as"])
    if cfg.get("replace"):
        made = list(dict.fromkeys(made))
        f = f.select([F.col(f"`{m}`") for m in made], made, made)
    return drop(f, {"columns": cfg["drop"]}, ctx) if cfg.get("drop") else f
