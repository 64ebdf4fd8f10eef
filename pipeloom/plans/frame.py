"""A DataFrame with the logical order of its rows.

Spark keeps no order across shuffles, so a pipe's order is a list of sort keys beside the DataFrame. Sorting prepends to it,
which is what a stable sort does; operators that depend on order put the keys into their windows or limits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = "__ord_"
_next = itertools.count()


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    #: (column, ascending), the first the strongest; names may be hidden columns.
    order: tuple[tuple[str, bool], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def keeping_order(self, lost: Iterable[str]) -> Frame:
        """Copies order keys that are about to be dropped or overwritten to hidden columns."""
        lost = set(lost)
        df, order = self.df, []
        for name, up in self.order:
            if name in lost:
                new = f"{HIDDEN}{next(_next)}"
                df = df.withColumn(new, F.col(f"`{name}`"))
                name = new
            order.append((name, up))
        return Frame(df, tuple(order))

    def set_column(self, name: str, value: Column) -> Frame:
        f = self.keeping_order([name] if name in self.df.columns else [])
        return f.with_df(f.df.withColumn(name, value))

    def select(self, columns: list[Column], names: list[str], kept: Iterable[str] = ()) -> Frame:
        """Only these columns; order keys that aren't among `kept` (columns that stay as they are) become hidden."""
        kept = set(kept)
        f = self.keeping_order(n for n, _ in self.order if n not in kept and not n.startswith(HIDDEN))
        hidden = [c for c in f.df.columns if c.startswith(HIDDEN)]
        return f.with_df(f.df.select(*columns, *hidden))

    def order_columns(self) -> list[tuple[Column, bool]]:
        return [(F.col(f"`{n}`"), up) for n, up in self.order]

    def sort_keys(self, by: list[tuple[Column, bool]] = ()) -> list[Column]:
        return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in [*by, *self.order_columns()]]

    def window(self, partition: list[str], by: list[tuple[Column, bool]] = (), reverse: bool = False):
        keys = [(c, up != reverse) for c, up in [*by, *self.order_columns()]]
        w = Window.partitionBy(*(F.col(f"`{p}`") for p in partition)) if partition else Window.partitionBy()
        sort = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys] or [F.lit(0)]
        return w.orderBy(*sort)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.sort_keys()) if self.order else self.df

    def visible(self) -> DataFrame:
        return self.df.select(*(F.col(f"`{c}`") for c in self.columns))

    def unsorted(self) -> Frame:
        return Frame(self.visible())


def union(frames: list[Frame]) -> Frame:
    """All rows of the first frame, then of the next, each in its own order; missing columns are null."""
    out: DataFrame | None = None
    tag = f"{HIDDEN}{next(_next)}"
    width = max(len(f.order) for f in frames)
    ups = [[f.order[i][1] if i < len(f.order) else True for f in frames] for i in range(width)]
    names = [f"{HIDDEN}{next(_next)}" for _ in range(width)]
    # Keys of one place may differ in type or direction: then each frame has a column of its own.
    shared = [len({(f.df.schema[f.order[i][0]].dataType.simpleString() if i < len(f.order) else None) for f in frames} - {None}) <= 1 and len({u for u, f in zip(ups[i], frames, strict=True) if i < len(f.order)}) <= 1 for i in range(width)]
    order: list[tuple[str, bool]] = [(tag, True)]
    for i in range(width):
        order += [(names[i], next(u for u, f in zip(ups[i], frames, strict=True) if i < len(f.order)))] if shared[i] else [(f"{names[i]}_{k}", f.order[i][1]) for k, f in enumerate(frames) if i < len(f.order)]
    for k, f in enumerate(frames):
        keys = [F.col(f"`{n}`").alias(names[i] if shared[i] else f"{names[i]}_{k}") for i, (n, _) in enumerate(f.order)]
        part = f.df.select(*(F.col(f"`{c}`") for c in f.columns), F.lit(k).alias(tag), *keys)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return Frame(out, tuple(order))
