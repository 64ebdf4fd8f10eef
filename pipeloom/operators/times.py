"""timeBucket, gapfill."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.functions.expr import interval_us
from pipeloom.functions.where import literal
from pipeloom.operators.quality import casted
from pipeloom.operators.registry import QueryError, cols, known, register
from pipeloom.plans.frame import HIDDEN, Frame
from pipeloom.plans.ranges import carried


def micros(f: Frame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp, date, number or text column, taken as UTC without a zone."""
    c, kind = known(f, name), f.df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.lit("UTC")))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return F.unix_micros(casted(c, kind, "timestamp") if not isinstance(kind, T.DateType) else c.cast("timestamp"))


def instant(text: str) -> Column:
    return F.unix_micros(F.lit(text).cast("timestamp"))


def back(us: Column, kind: T.DataType) -> Column:
    ts = F.timestamp_micros(us)
    return ts.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else ts


@register("timeBucket")
def time_bucket(f: Frame, cfg: dict, ctx) -> Frame:
    """The start of the row's bucket. With tz, buckets are aligned to that zone's wall clock. A time that is null or none at all
    fails the query."""
    width = interval_us(cfg["interval"])
    kind = f.df.schema[cfg["field"]].dataType
    us = micros(f, cfg["field"])
    us = F.when(us.isNull(), F.raise_error(F.lit(f"timeBucket: {cfg['field']} is no time")).cast("bigint")).otherwise(us)
    origin = instant(cfg["origin"]) if cfg.get("origin") else F.lit(0)
    tz = cfg.get("tz")
    if tz and tz != "UTC":
        local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), tz))
        start = local - F.pmod(local - origin, F.lit(width))
        out = F.to_utc_timestamp(F.timestamp_micros(start), tz)
        return f.set_column(cfg["as"], out.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else out)
    return f.set_column(cfg["as"], back(us - F.pmod(us - origin, F.lit(width)), kind))


@register("gapfill")
def gapfill(f: Frame, cfg: dict, ctx) -> Frame:
    """A row per slot of the interval, per group: the first row within half an interval after the slot, else a made one.

    Made rows have the group's keys and the slot's time; other columns follow the method once the group has had a real row.
    Rows outside of from and to go, and so do further rows of one slot.
    """
    field, width, keys, method = cfg["field"], interval_us(cfg["interval"]), cfg.get("groupBy") or [], cfg.get("method") or "null"
    if method not in ("zero", "null", "lastValue", "value"):
        raise QueryError(f"gapfill: unknown method {method!r}")
    cols(f, keys)
    kind, t, s, g = f.df.schema[field].dataType, f"{HIDDEN}us", f"{HIDDEN}slot", f"{HIDDEN}real"
    rows = f.df.withColumn(t, micros(f, field)).filter(F.col(t).isNotNull())
    begin, end = f"{HIDDEN}begin", f"{HIDDEN}end"
    lo = instant(cfg["from"]) if cfg.get("from") else F.col(f"{HIDDEN}lo")
    hi = instant(cfg["to"]) if cfg.get("to") else F.col(f"{HIDDEN}hi")
    ends = rows.groupBy(*keys).agg(F.min(t).alias(f"{HIDDEN}lo"), F.max(t).alias(f"{HIDDEN}hi")).select(*keys, lo.alias(begin), hi.alias(end))
    if keys:
        grid = ends.filter(F.col(end) >= F.col(begin)).select(*keys, begin, F.explode(F.sequence(begin, end, F.lit(width))).alias(s))
    else:  # one group: its slots are a range over many tasks
        one = ends.first()
        slots = (one[end] - one[begin]) // width + 1 if one[begin] is not None and one[end] is not None else 0
        grid = f.df.sparkSession.range(max(0, slots)).select((F.col("id") * width + F.lit(one[begin] or 0)).alias(s))
    null_safe = lambda a, b: [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys]
    on = null_safe("r", "e")
    joined = rows.alias("r").join(F.broadcast(ends.alias("e")) if not keys else ends.alias("e"), on or F.lit(True))
    nearest = F.col(begin) + F.floor((F.col(t) - F.col(begin) + F.lit(width / 2)) / width) * width
    first_half = F.pmod(F.col(t) - F.col(begin), F.lit(width)) < width / 2
    held = joined.filter((F.col(t) >= F.col(begin)) & (F.col(t) <= F.col(end)) & first_half).withColumn(s, nearest.cast("bigint")).select("r.*", s)
    w = Window.partitionBy(*keys, s).orderBy(t, *f.sort_keys())
    held = held.withColumn(f"{HIDDEN}rn", F.row_number().over(w)).filter(F.col(f"{HIDDEN}rn") == 1).drop(f"{HIDDEN}rn").withColumn(g, F.lit(True))
    out = grid.alias("g").join(held.alias("h"), [*null_safe("g", "h"), F.col(f"g.{s}") == F.col(f"h.{s}")], "left")
    real = F.coalesce(F.col(f"h.{g}"), F.lit(False))
    up_to = Window.partitionBy(*(F.col(f"g.`{k}`") for k in keys)).orderBy(F.col(f"g.{s}")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held_over: dict[str, Column] = {}  # hidden columns that go on until the next one that isn't null

    def going_on(value: Column) -> Column:
        if keys:
            return F.last(value, ignorenulls=True).over(up_to)
        held_over[name := f"{HIDDEN}on{len(held_over)}"] = value
        return F.col(name)

    seen = F.coalesce(going_on(F.when(real, F.lit(True))), F.lit(False)) if method in ("zero", "value") else None
    carry, picked = set(cfg.get("carry") or []), []
    for c in f.columns:
        v, ctype = F.col(f"h.`{c}`"), f.df.schema[c].dataType
        if c in keys:
            picked.append(F.col(f"g.`{c}`").alias(c))
        elif c == field:
            picked.append(F.when(real, v).otherwise(back(F.col(f"g.{s}"), kind).cast(ctype)).alias(c))
        elif method == "lastValue":
            old = going_on(F.when(real, F.struct(v.alias("v"))))["v"]
            picked.append((F.when(real, v).otherwise(old) if not carry or c in carry else v).alias(c))
        elif method in ("zero", "value"):
            value = 0 if method == "zero" else cfg.get("value")
            fits = isinstance(ctype, T.NumericType) or method == "value" and value is not None
            new = literal(value, ctype).try_cast(ctype) if fits else F.lit(None).cast(ctype)
            picked.append(F.when(~real & seen, new).otherwise(v).alias(c))
        else:
            picked.append(v.alias(c))
    order = f"{HIDDEN}slot_order"
    if held_over:
        # out's columns come from two sides; carried works on plain ones
        flat = {c: f"{HIDDEN}h{i}" for i, c in enumerate(f.columns)}
        plain = out.select(F.col(f"g.{s}").alias(s), real.alias(g), *(F.col(f"h.`{c}`").alias(n) for c, n in flat.items()), *(v.alias(n) for n, v in held_over.items()))
        both = carried(plain, [(F.col(s), True)], list(held_over))
        sides = both.select(F.struct(s).alias("g"), F.struct(F.col(g), *(F.col(n).alias(c) for c, n in flat.items())).alias("h"), *held_over)
        return Frame(sides.select(*picked, F.col(f"g.{s}").alias(order)), ((order, True),))
    return Frame(out.select(*picked, F.col(f"g.{s}").alias(order)), (*((k, True) for k in keys), (order, True)))
