"""cast, dropNulls, fillNulls, dedupe, sample, assert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.functions.expr import truthy_expr
from pipeloom.functions.where import literal
from pipeloom.operators.registry import QueryError, cols, known, register, sort_spec
from pipeloom.plans.frame import HIDDEN, Frame
from pipeloom.plans.ranges import carried, has_hot_key, numbered


def casted(c: Column, kind: T.DataType, to: str) -> Column:
    """Null where the value is no value of the type. Texts are read strictly: no blanks, no "yes" for true."""
    text = isinstance(kind, T.StringType)
    match to:
        case "int":
            if text:
                return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
            return c.try_cast("bigint")
        case "float":
            return F.when(c.rlike(r"^\S+$"), c.try_cast("double")) if text else c.try_cast("double")
        case "bool":
            if text:
                return F.when(c.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(True)).when(c.isin("0", "f", "F", "FALSE", "false", "False"), F.lit(False))
            return c.try_cast("boolean")
        case "string":
            return c.cast("string")
        case "timestamp":
            if isinstance(kind, T.NumericType):
                # seconds, milli-, micro- or nanoseconds by their size
                us = F.when(F.abs(c) < 1e11, c * 1e6).when(F.abs(c) < 1e14, c * 1e3).when(F.abs(c) < 1e17, c).otherwise(c / 1e3)
                return F.timestamp_micros(us.cast("bigint"))
            return c.try_cast("timestamp")
    raise QueryError(f"cast: unknown type {to!r}")


@register("cast")
def cast(f: Frame, cfg: dict, ctx) -> Frame:
    for rule in cfg["casts"]:
        name, policy = rule["field"], rule.get("onError") or "null"
        c = known(f, name)
        new = casted(c, f.df.schema[name].dataType, rule["to"])
        if policy == "skip":
            f = f.with_df(f.df.filter(c.isNull() | new.isNotNull()))
        elif policy == "fail":
            new = F.when(c.isNotNull() & new.isNull(), F.raise_error(F.concat(F.lit(f"cast: {name} is no {rule['to']}: "), c.cast("string")))).otherwise(new)
        elif policy != "null":
            raise QueryError(f"cast: unknown onError {policy!r}")
        f = f.set_column(name, new)
    return f


@register("dropNulls")
def drop_nulls(f: Frame, cfg: dict, ctx) -> Frame:
    nulls = [c.isNull() for c in cols(f, cfg.get("columns") or f.columns)]
    return f.with_df(f.df.filter(~reduce(Column.__or__ if cfg.get("any", True) else Column.__and__, nulls)))


@register("fillNulls")
def fill_nulls(f: Frame, cfg: dict, ctx) -> Frame:
    method = cfg.get("method") or "value"
    names = cfg.get("columns") or f.columns
    kinds = {n: f.df.schema[n].dataType for n in names if known(f, n) is not None}
    if method in ("value", "zero"):
        value = cfg.get("value") if method == "value" else 0
        fits = [n for n, t in kinds.items() if method == "value" or isinstance(t, T.NumericType)]
        new = {n: F.coalesce(F.col(f"`{n}`"), literal(value, kinds[n]).try_cast(kinds[n])) for n in fits}
    elif method == "mean":
        # one aggregate over all rows, joined back as its single row: a window without partitions would gather them in one task
        fits = [n for n, t in kinds.items() if isinstance(t, T.NumericType)]
        if not fits:
            return f
        row = f.df.agg(*(F.avg(f"`{n}`").alias(f"{HIDDEN}mean{i}") for i, n in enumerate(fits)))
        f = f.with_df(f.df.crossJoin(F.broadcast(row)))
        for i, n in enumerate(fits):
            f = f.set_column(n, F.coalesce(F.col(f"`{n}`"), F.col(f"{HIDDEN}mean{i}")))
        return f.with_df(f.df.drop(*(f"{HIDDEN}mean{i}" for i in range(len(fits)))))
    elif method in ("lastValue", "nextValue") and not f.df.isStreaming and (not cfg.get("partitionBy") or has_hot_key(f.df, cfg["partitionBy"], ctx.hot_rows)):
        last, keys = method == "lastValue", [*sort_spec(f, cfg.get("orderBy")), *f.order_columns()]
        held = {n: f"{HIDDEN}fill{i}" for i, n in enumerate(names)}  # the order may go by the columns themselves
        df = f.df.withColumns({h: F.col(f"`{n}`") for n, h in held.items()})
        f = f.with_df(carried(df, [(c, up == last) for c, up in keys] or [(F.lit(0), True)], list(held.values()), cfg.get("partitionBy") or []))
        for n in names:
            f = f.keeping_order([n])
        return f.with_df(f.df.withColumns({n: F.col(h) for n, h in held.items()}).drop(*held.values()))
    elif method in ("lastValue", "nextValue"):
        w = f.window(cfg.get("partitionBy") or [], sort_spec(f, cfg.get("orderBy")))
        if method == "lastValue":
            w, fn = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.last
        else:
            w, fn = w.rowsBetween(Window.currentRow, Window.unboundedFollowing), F.first
        new = {n: fn(F.col(f"`{n}`"), ignorenulls=True).over(w) for n in names}
    else:
        raise QueryError(f"fillNulls: unknown method {method!r}")
    for n in new:
        f = f.keeping_order([n])
    return f.with_df(f.df.withColumns(new))


@register("dedupe")
def dedupe(f: Frame, cfg: dict, ctx) -> Frame:
    keep = cfg.get("keep") or "first"
    if keep not in ("first", "last"):
        raise QueryError(f"dedupe: keep must be first or last, not {keep!r}")
    return first_of(f, cfg["by"], sort_spec(f, cfg.get("orderBy")), keep == "last")


def first_of(f: Frame, by: list[str], order: list[tuple[Column, bool]], reverse: bool) -> Frame:
    """One row per key. The window's limit of 1 is applied before the shuffle too, so that a hot key costs a row a task."""
    cols(f, by)
    rn = f"{HIDDEN}rn"
    df = f.df.withColumn(rn, F.row_number().over(f.window(by, order, reverse))).filter(F.col(rn) == 1).drop(rn)
    return f.with_df(df)


@register("sample")
def sample(f: Frame, cfg: dict, ctx) -> Frame:
    n, ratio, method = cfg.get("n"), cfg.get("ratio"), cfg.get("method") or "random"
    if (n is None) == (ratio is None):
        raise QueryError("sample takes one of n and ratio")
    if ratio is not None and not 0 < ratio <= 1:
        raise QueryError("sample: ratio must be over 0 and at most 1")
    total = f.df.count() if ratio is not None or method == "systematic" else None
    target = n if n is not None else max(1, int(total * ratio))
    seed = int(cfg.get("seed") or 0)
    keys = [F.col(f"`{k}`") for k, _ in f.order] or [F.col(f"`{c}`") for c in f.columns]
    if method == "random":
        h = f"{HIDDEN}h"
        drawn = f.df.withColumn(h, F.xxhash64(F.lit(seed), *keys))
        if ratio is None:
            return f.with_df(drawn.orderBy(h, *f.sort_keys()).limit(target).drop(h))
        df, i = numbered(Frame(drawn, ((h, True), *f.order)))  # a share of all rows is too many for one task
        return f.with_df(df.filter(F.col(i) < target).drop(i, h))
    if method == "systematic":
        step = max(1, total // max(1, target))
        df, i = numbered(f)
        return f.with_df(df.filter((F.col(i) % step == 0) & (F.col(i) / step < target)).drop(i))
    raise QueryError(f"sample: unknown method {method!r}")


@register("assert")
def assert_(f: Frame, cfg: dict, ctx) -> Frame:
    scope, message = cfg.get("scope") or "row", cfg.get("message") or f"assertion failed: {cfg['expr']}"
    if scope == "row":
        return f.with_df(f.df.filter(F.when(truthy_expr(f.df, cfg["expr"]), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))))
    if scope == "overall":
        one = f.df.agg(F.count(F.lit(1)).alias("count"))
        if not one.select(truthy_expr(one, cfg["expr"])).first()[0]:
            raise AssertionError(message)
        return f
    raise QueryError(f"assert: unknown scope {scope!r}")
