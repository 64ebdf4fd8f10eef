"""sort, limit, skip, distinct, topPerGroup, window."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from pipeloom.functions.where import literal
from pipeloom.operators.quality import first_of
from pipeloom.operators.registry import QueryError, cols, known, register, sort_spec
from pipeloom.plans.frame import HIDDEN, Frame, _next
from pipeloom.plans.ranges import moved, numbered, ranked


@register("sort")
def sort(f: Frame, cfg: dict, ctx) -> Frame:
    """The keys go before the present order; nothing moves until an operator or the result needs it."""
    order = []
    for (c, up), k in zip(sort_spec(f, cfg["by"]), cfg["by"], strict=True):
        name = k if isinstance(k, str) else k.get("field")
        if name is None or name not in f.df.columns:
            name = f"{HIDDEN}{next(_next)}"
            f = f.with_df(f.df.withColumn(name, c))
        order.append((name, up))
    return Frame(f.df, (*order, *f.order))


def whole(n, what: str) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise QueryError(f"{what} must be a whole number from 0")
    return n


@register("limit")
def limit(f: Frame, cfg: dict, ctx) -> Frame:
    n = whole(cfg["n"], "limit: n")
    return f.with_df(f.df.limit(n) if ctx.skipped is f.df else f.sorted().limit(n))  # what skip left is sorted already


@register("skip")
def skip(f: Frame, cfg: dict, ctx) -> Frame:
    out = offset(f, whole(cfg["n"], "skip: n"), ctx.following == "limit")
    ctx.skipped = out.df if ctx.following == "limit" and not f.df.isStreaming else None
    return out


def offset(f: Frame, n: int, limited: bool) -> Frame:
    """Without the first n rows. With a limit behind it, each task keeps only the rows that may come first; alone, Spark's offset
    would bring all rows to one task, so that the rows are numbered in ranges instead."""
    if limited or f.df.isStreaming:
        return f.with_df(f.sorted().offset(n))
    if n == 0:
        return f
    df, i = numbered(f)
    return f.with_df(df.filter(F.col(i) >= n).drop(i))


@register("distinct")
def distinct(f: Frame, cfg: dict, ctx) -> Frame:
    if cfg.get("by"):
        return first_of(f, cfg["by"], [], False)
    if all(n in f.columns for n, _ in f.order):
        return f.with_df(f.visible().distinct())
    return first_of(f, f.columns, [], False)


@register("topPerGroup")
def top_per_group(f: Frame, cfg: dict, ctx) -> Frame:
    n, by, partition = whole(cfg["n"], "topPerGroup: n"), sort_spec(f, cfg["by"]), cfg.get("partitionBy") or []
    if n == 0:
        raise QueryError("topPerGroup: n must be over 0")
    cols(f, partition)
    if not partition:
        return f.with_df(f.df.orderBy(*f.sort_keys(by)).limit(n))
    rn = f"{HIDDEN}rn"
    return f.with_df(f.df.withColumn(rn, F.row_number().over(f.window(partition, by))).filter(F.col(rn) <= n).drop(rn))


RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
FUNCTIONS = (*RANKS, "lag", "lead", "first_value", "last_value")


@register("window")
def window(f: Frame, cfg: dict, ctx) -> Frame:
    fn, by, partition = cfg["fn"].lower(), sort_spec(f, cfg.get("orderBy")), cfg.get("partitionBy") or []
    cols(f, partition)
    if fn not in FUNCTIONS:
        raise QueryError(f"window: unknown fn {cfg['fn']!r}")
    if fn in (*RANKS, "lag", "lead") and not by:
        raise QueryError(f"window: {fn} needs orderBy")
    if fn not in RANKS and not cfg.get("field"):
        raise QueryError(f"window: {fn} needs field")
    if not partition and not f.df.isStreaming:
        return over_all(f, cfg, fn, by)
    w = f.window(partition, by)
    if fn == "row_number":
        out = F.row_number().over(w).cast("bigint")
    elif fn in RANKS:  # ties are ties in orderBy, not in the pipe's order
        keys = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in by]
        out = RANKS[fn]().over(Window.partitionBy(*cols(f, partition)).orderBy(*keys)).cast("bigint")
    else:
        c, kind = known(f, cfg["field"]), f.df.schema[cfg["field"]].dataType
        if fn in ("lag", "lead"):
            k = cfg.get("offset") or 1
            move = (F.lag if fn == "lag" else F.lead)(c, k if k > 0 else 1)
            out = move.over(w)
            if cfg.get("default") is not None:
                there = (F.lag if fn == "lag" else F.lead)(F.lit(1), k if k > 0 else 1).over(w)
                out = F.when(there.isNull(), literal(cfg["default"], kind).cast(kind)).otherwise(out)
        else:
            w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = (F.first if fn == "first_value" else F.last)(c).over(w)
    return f.set_column(cfg["as"], out)


def over_all(f: Frame, cfg: dict, fn: str, by: list[tuple[Column, bool]]) -> Frame:
    """A window without partitions."""
    name = cfg["as"]
    f = f.keeping_order([name])
    g, keys = f, []
    for c, up in by:  # the window's own order before the pipe's
        k = f"{HIDDEN}{next(_next)}"
        g = Frame(g.df.withColumn(k, c), g.order)
        keys.append((k, up))
    g = Frame(g.df, (*keys, *f.order))
    drop = [k for k, _ in keys]
    if fn == "row_number":
        df, i = numbered(g)
        return f.with_df(df.withColumn(name, F.col(i) + 1).drop(i, *drop))
    if fn in RANKS:
        return f.with_df(ranked(g, [(F.col(k), up) for k, up in keys], fn == "dense_rank", name).drop(*drop))
    c, kind = known(f, cfg["field"]), f.df.schema[cfg["field"]].dataType
    if fn in ("lag", "lead"):
        k = cfg.get("offset") or 1
        df, v, there = moved(g, cfg["field"], (-1 if fn == "lag" else 1) * (k if k > 0 else 1))
        value = F.col(v)
        if cfg.get("default") is not None:
            value = F.when(F.col(there).isNull(), literal(cfg["default"], kind).cast(kind)).otherwise(value)
        return f.with_df(df.withColumn(name, value).drop(v, there, *drop))
    edge = g if fn == "first_value" else Frame(g.df, tuple((n, not up) for n, up in g.order))
    v = f"{HIDDEN}{next(_next)}"
    order = edge.sort_keys() if fn == "first_value" else [x.asc_nulls_last() if up else x.desc_nulls_first() for x, up in edge.order_columns()]
    one = edge.df.orderBy(*order).limit(1).select(c.alias(v))
    return f.with_df(f.df.crossJoin(F.broadcast(one)).withColumn(name, F.col(v)).drop(v))
