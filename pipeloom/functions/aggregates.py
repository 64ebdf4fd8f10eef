"""Aggregate clauses {fn, field, expr, args, as} as columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeloom.functions.expr import column, truthy_expr
from pipeloom.functions.where import field

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX", "STDEV", "VARIANCE", "MEDIAN", "PERCENTILE", "FIRST", "LAST", "ARRAY_AGG", "STRING_AGG", "COUNTIF", "SUMIF", "EXPR", "COUNT_DISTINCT", "APPROX_COUNT_DISTINCT")
PARTIAL = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def aggregate(df: DataFrame, a: dict[str, Any], order: list[tuple[Column, bool]]) -> Column:
    """order: what FIRST, LAST and the lists go by, as (column, ascending)."""
    fn, args = a["fn"].upper(), a.get("args") or []
    name = a.get("field")
    if fn == "COUNT" and name in (None, "", "*"):
        out = F.count(F.lit(1))
    elif fn == "COUNTIF":
        out = F.count_if(truthy_expr(df, a["expr"]))
    elif fn == "EXPR":
        out = column(a["expr"])
    else:
        c = column(a["expr"]) if a.get("expr") and not name else field(df, name)[0]
        match fn:
            case "COUNT":
                out = F.count(c)
            case "SUM":
                out = F.sum(c)
            case "AVG":
                out = F.avg(c)
            case "MIN":
                out = F.min(c)
            case "MAX":
                out = F.max(c)
            case "STDEV":
                out = F.stddev_samp(c)
            case "VARIANCE":
                out = F.var_samp(c)
            case "MEDIAN":
                out = F.median(c)
            case "PERCENTILE":
                p = float(args[0]) if args else 0.5
                out = F.percentile(c, p / 100 if p > 1 else p)
            case "FIRST" | "LAST":
                out = _edge(c, order, fn == "FIRST")
            case "ARRAY_AGG":
                out = _listed(c, order)
            case "STRING_AGG":
                out = F.array_join(_listed(c.cast("string"), order), str(args[0]) if args else ",")
            case "SUMIF":
                out = F.sum(F.when(truthy_expr(df, a["expr"]), c))
            case "COUNT_DISTINCT":
                out = F.count_distinct(c)
            case "APPROX_COUNT_DISTINCT":
                out = F.approx_count_distinct(c)
            case _:
                raise ValueError(f"unknown aggregate {a['fn']!r}")
    return out.alias(a["as"])


def _edge(c: Column, order: list[tuple[Column, bool]], first: bool) -> Column:
    if not order:
        return F.first(c) if first else F.last(c)
    if len({up for _, up in order}) > 1:  # a struct compares all its fields the same way
        listed = _sorted(c, order)
        return F.element_at(listed, 1 if first else -1)["v"]
    key = F.struct(*[x for x, _ in order])
    return (F.min_by if first == order[0][1] else F.max_by)(c, key)


def _sorted(c: Column, order: list[tuple[Column, bool]]) -> Column:
    rows = F.collect_list(F.struct(c.alias("v"), *[x.alias(f"k{i}") for i, (x, _) in enumerate(order)]))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(order))):
            x, y = (a[f"k{i}"], b[f"k{i}"]) if up else (b[f"k{i}"], a[f"k{i}"])
            out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), F.lit(-1)).otherwise(F.lit(1))
        return out

    return F.array_sort(rows, compare)


def _listed(c: Column, order: list[tuple[Column, bool]]) -> Column:
    """Values without nulls, in order."""
    if not order:
        return F.array_sort(F.collect_list(c))
    return F.transform(F.filter(_sorted(c, order), lambda x: x["v"].isNotNull()), lambda x: x["v"])
