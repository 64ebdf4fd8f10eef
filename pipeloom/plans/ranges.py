"""Windows over all rows without a task that sees all rows.

Rows are range-partitioned by the order's keys and written once, so that each keeps its part's number. What a row needs from
earlier parts is a sum or a last value by part: tables of one row a part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.plans.frame import HIDDEN, Frame, _next
from pipeloom.sources.scratch import written


SUM = f"{HIDDEN}sum"


def hidden(what: str) -> str:
    return f"{HIDDEN}{what}{next(_next)}"


def ranged(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, str]:
    """df with its part's number; of two parts, all rows of the lower one come first. A stream or a frame without keys is refused."""
    p = hidden("part")
    return written((df.repartitionByRange(*keys) if keys else df).withColumn(p, F.spark_partition_id()), "ranged"), p


def before(df: DataFrame, p: str, value: Column) -> DataFrame:
    """Per part, the sum of `value`, an aggregate, over all earlier parts: columns p and SUM."""
    by_part = df.groupBy(p).agg(value.alias("v"))
    return by_part.select(p, F.coalesce(F.sum("v").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(SUM))


def numbered(f: Frame) -> tuple[DataFrame, str]:
    """The rows with their places in order, from 0, in a hidden column."""
    i, keys = hidden("place"), f.sort_keys()
    df, p = ranged(f.df, keys)
    w = Window.partitionBy(p).orderBy(*(keys or [F.lit(0)]))
    df = df.withColumn(i, F.row_number().over(w))
    return df.join(before(df, p, F.max(i)), p).withColumn(i, (F.col(i) + F.col(SUM) - 1).cast("bigint")).drop(p, SUM), i


def ranked(f: Frame, by: list[tuple[Column, bool]], dense: bool, name: str) -> DataFrame:
    """rank or dense_rank over all rows; equal rows lie in one part."""
    keys = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in by]
    df, p = ranged(f.df, keys)
    r = hidden("rank")
    df = df.withColumn(r, (F.dense_rank() if dense else F.rank()).over(Window.partitionBy(p).orderBy(*keys)))
    out = df.join(before(df, p, F.max(r) if dense else F.count(F.lit(1))), p)
    return out.withColumn(name, (F.col(r) + F.col(SUM)).cast("bigint")).drop(p, r, SUM)


def moved(f: Frame, name: str, by: int) -> tuple[DataFrame, str, str]:
    """Each row with the value of `name` that stands `by` places later (earlier if negative), and a flag that is null if none does."""
    df, i = numbered(f)
    v, there = hidden("value"), hidden("there")
    df = written(df, "numbered")
    other = df.select((F.col(i) - by).alias(i), F.col(f"`{name}`").alias(v), F.lit(1).alias(there))
    return df.join(other, i, "left").drop(i), v, there


def carried(df: DataFrame, keys: list[tuple[Column, bool]], names: list[str], group: list[str] = ()) -> DataFrame:
    """Replaces each of the columns by its last value that isn't null, up to the row itself, in the order of the keys; with
    `group`, by the last one of the row's own group. A group may lie in many parts."""
    keys = [*((F.col(f"`{g}`"), True) for g in group), *keys]
    sort = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys]
    df, p = ranged(df, sort)
    w = Window.partitionBy(p).orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)]
    wrapped = {n: F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.col(f"`{n}`").alias("v"), *own)) for n in names}
    df = df.withColumns({n: F.last(wrapped[n], ignorenulls=True).over(w) for n in names})
    end = hidden("end")
    rn = df.withColumn(end, F.row_number().over(Window.partitionBy(p).orderBy(*sort)))
    lasts = rn.groupBy(p).agg(*(F.max_by(F.col(f"`{n}`"), end).alias(f"{HIDDEN}c{k}") for k, n in enumerate(names)))
    earlier = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(p, *(F.last(f"{HIDDEN}c{k}", ignorenulls=True).over(earlier).alias(f"{HIDDEN}c{k}") for k in range(len(names))))
    out = df.join(carry, p)

    def value(k: int, n: str) -> Column:
        # groups lie one behind the other: a last value of another group means that this one has none yet
        last = F.coalesce(F.col(f"`{n}`"), F.col(f"{HIDDEN}c{k}"))
        same = reduce(Column.__and__, (last[f"g{i}"].eqNullSafe(F.col(f"`{g}`")) for i, g in enumerate(group)), F.lit(True))
        return F.when(last.isNotNull() & same, last["v"])

    return out.withColumns({n: value(k, n) for k, n in enumerate(names)}).drop(p, *(f"{HIDDEN}c{k}" for k in range(len(names))))


def has_hot_key(df: DataFrame, key: list[str], most: int) -> bool:
    """True if some key has more than `most` rows: one count by key, of which a row comes back."""
    top = df.groupBy(*(F.col(f"`{k}`") for k in key)).count().agg(F.max("count")).first()[0]
    return (top or 0) > most
