"""lookup, asofJoin, crossJoin."""

from __future__ import annotations

import time

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from pipeloom.functions.expr import interval_us
from pipeloom.functions.where import condition
from pipeloom.operators.registry import QueryError, known, register
from pipeloom.operators.times import micros
from pipeloom.plans.frame import HIDDEN, Frame
from pipeloom.plans.ranges import carried, has_hot_key

def right_side(cfg: dict, ctx) -> Frame:
    """The dataset's rows that where keeps, at most limit of them, in the dataset's order."""
    key = (cfg["dataset"], repr(cfg.get("where")), cfg.get("limit"), repr(ctx.scope))
    ttl = cfg.get("cacheTtlMs") or 0
    f = ctx.dataset(cfg["dataset"])
    if cfg.get("where"):
        f = f.with_df(f.df.filter(condition(f.df, cfg["where"])))
    if cfg.get("limit") is not None:
        f = f.with_df(f.sorted().limit(cfg["limit"]))
    if ttl:
        kept = ctx.lookups.get(key)
        if kept and kept[0] > time.monotonic():
            return f.with_df(kept[1])
        if kept:
            kept[1].unpersist()
        f = f.with_df(f.df.persist())
        ctx.lookups[key] = (time.monotonic() + ttl / 1000, f.df)
    return f


def names_of(right: Frame, cfg: dict, skip: str | None = None) -> dict[str, str]:
    """Right columns and their names in the result."""
    select = cfg.get("select") or [c for c in right.columns]
    for c in select:
        known(right, c)
    prefix = f"{cfg['as']}_" if cfg.get("as") else ""
    return {c: prefix + c for c in select}


def merged(f: Frame, match: Column, names: dict[str, str]) -> Frame:
    """Right values from the struct column; a name that the left has already is overwritten."""
    for c, new in names.items():
        f = f.set_column(new, match.getField(c))
    return f


@register("lookup")
def lookup(f: Frame, cfg: dict, ctx) -> Frame:
    """At most one match a row, the last in the dataset's order; null keys match null keys. Spark broadcasts the right side where
    its size allows; else both are shuffled by the key."""
    right, (left_key, right_key) = right_side(cfg, ctx), (cfg["on"]["left"], cfg["on"]["right"])
    mode = cfg.get("mode") or "left"
    if mode not in ("left", "inner"):
        raise QueryError(f"lookup: unknown mode {mode!r}")
    names, k, m = names_of(right, cfg), f"{HIDDEN}key", f"{HIDDEN}match"
    record = F.struct(*(F.col(f"`{c}`") for c in names))
    keys = [c for c, _ in right.order_columns()]
    last = F.max_by(record, F.struct(*keys)) if keys and all(up for _, up in right.order) else F.last(record)
    one = right.df.groupBy(known(right, right_key).alias(k)).agg(last.alias(m))
    df = f.df.join(one, known(f, left_key).eqNullSafe(F.col(k)), mode).drop(k)
    out = merged(f.with_df(df), F.col(m), names)
    return out.with_df(out.df.drop(m))


@register("asofJoin")
def asof_join(f: Frame, cfg: dict, ctx) -> Frame:
    """The right row nearest in time, per key, by one pass over both sides sorted together: no pair is ever made.

    backward: the last at or before; forward: the first at or after; nearest: the closer of the two, the earlier on a tie. Of
    right rows at one time the last counts. Left rows without a time match nothing.
    """
    right, direction = right_side(cfg, ctx), cfg.get("direction") or "backward"
    if direction not in ("backward", "forward", "nearest"):
        raise QueryError(f"asofJoin: unknown direction {direction!r}")
    names = names_of(right, cfg)
    tol = interval_us(cfg["tolerance"]) if cfg.get("tolerance") else None
    key, t, side, rec, row = (f"{HIDDEN}{x}" for x in ("key", "t", "side", "rec", "left"))
    l_key = known(f, cfg["leftKey"]) if cfg.get("leftKey") else F.lit(0)
    r_key = known(right, cfg["rightKey"]) if cfg.get("rightKey") else F.lit(0)
    ties = [F.col(f"`{n}`") for n, _ in right.order] or [F.lit(0)]
    record = F.struct(*(F.col(f"`{c}`") for c in names), micros(right, cfg["rightTime"]).alias(t))
    # one row per key and time on the right, so that the window needs no tie-break
    r = right.df.select(r_key.alias(key), micros(right, cfg["rightTime"]).alias(t), record.alias(rec), F.struct(*ties).alias("o")).filter(F.col(t).isNotNull())
    r = r.groupBy(key, t).agg(F.max_by(rec, "o").alias(rec))
    left_row = F.struct(*(F.col(f"`{c}`") for c in f.df.columns))
    left = f.df.select(l_key.alias(key), micros(f, cfg["leftTime"]).alias(t), left_row.alias(row))
    both = left.withColumn(rec, F.lit(None).cast(r.schema[rec].dataType)).withColumn(side, F.lit(1)).unionByName(
        r.withColumn(row, F.lit(None).cast(left.schema[row].dataType)).withColumn(side, F.lit(0)))
    both = both.withColumn("_b", F.col(rec)).withColumn("_a", F.col(rec)).drop(rec)
    # side 1, the left, comes after right rows of its time in either direction
    keyed = bool(cfg.get("leftKey"))
    # counted on the bare keys, before anything is grouped or joined
    native = f.df.isStreaming or keyed and not has_hot_key(left.select(key).unionByName(right.df.select(r_key.alias(key))), [key], ctx.hot_rows)
    for c, up in (("_b", True), ("_a", False)):
        if direction == ("forward" if up else "backward"):
            continue
        if native:
            w = Window.partitionBy(key).orderBy(F.col(t).asc() if up else F.col(t).desc(), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            both = both.withColumn(c, F.last(c, ignorenulls=True).over(w))
        else:
            both = carried(both, [(F.col(t), up), (F.col(side), True)], [c], [key] if keyed else [])
    closer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (F.col(t) - F.col(f"_b.{t}") <= F.col(f"_a.{t}") - F.col(t)), F.col("_b")).otherwise(F.col("_a"))
    both = both.withColumn("_m", {"backward": F.col("_b"), "forward": F.col("_a"), "nearest": closer}[direction])
    near = F.col(t).isNotNull() if tol is None else F.abs(F.col(t) - F.col(f"_m.{t}")) <= tol
    out = both.filter(F.col(side) == 1).select(f"{row}.*", F.when(near & F.col(t).isNotNull(), F.col("_m")).alias(f"{HIDDEN}match"))
    done = merged(f.with_df(out), F.col(f"{HIDDEN}match"), names)
    return done.with_df(done.df.drop(f"{HIDDEN}match"))


@register("crossJoin")
def cross_join(f: Frame, cfg: dict, ctx) -> Frame:
    """Every pair of rows, as asked for. Spark broadcasts the right side if it is small."""
    right = right_side(cfg, ctx)
    names, m = names_of(right, cfg), f"{HIDDEN}match"
    keys = [F.col(f"`{n}`").alias(f"{HIDDEN}x{i}") for i, (n, _) in enumerate(right.order)]
    r = right.df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(m), *keys)
    done = merged(f.with_df(f.df.crossJoin(r)), F.col(m), names)
    return Frame(done.df.drop(m), (*done.order, *((f"{HIDDEN}x{i}", up) for i, (_, up) in enumerate(right.order))))
