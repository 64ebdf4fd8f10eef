"""Condition trees as columns, with SQL's logic of three values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.functions.expr import truthy_expr

OPS = ("==", "!=", ">", "<", ">=", "<=", "in", "not_in", "like", "not_like", "starts_with", "ends_with", "contains", "between", "is_null", "is_not_null")


def literal(value: Any, kind: T.DataType | None) -> Column:
    """A literal of the column's type, where the value can be cast to it."""
    c = F.lit(value)
    if value is None or kind is None:
        return c
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return c.try_cast(kind) if not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return F.lit(str(value).lower() if isinstance(value, bool) else str(value))
    return c


def field(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """A column by name, also a struct's field by a dotted path; a name with a table before it is found by its last part."""
    if name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    head, _, rest = name.partition(".")
    if rest and head not in df.columns and rest in df.columns:
        return F.col(f"`{rest}`"), df.schema[rest].dataType
    return F.col(name), df.select(F.col(name).alias("x")).schema["x"].dataType


def condition(df: DataFrame, w: dict[str, Any]) -> Column:
    """Of a node's parts the first counts: expr, field, and, or, not. An empty node is true."""
    if w.get("expr"):
        return truthy_expr(df, w["expr"])
    if w.get("field"):
        return simple(df, w)
    if w.get("and"):
        out = condition(df, w["and"][0])
        for x in w["and"][1:]:
            out = out & condition(df, x)
        return out
    if w.get("or"):
        out = condition(df, w["or"][0])
        for x in w["or"][1:]:
            out = out | condition(df, x)
        return out
    if w.get("not"):
        return ~condition(df, w["not"])
    return F.lit(True)


def simple(df: DataFrame, w: dict[str, Any]) -> Column:
    (c, kind), op, v = field(df, w["field"]), w.get("op", "=="), w.get("value")
    lit = lambda x: literal(x, kind)
    match op:
        case "==" | "=":
            return c == lit(v)
        case "!=":
            return c != lit(v)
        case ">":
            return c > lit(v)
        case "<":
            return c < lit(v)
        case ">=":
            return c >= lit(v)
        case "<=":
            return c <= lit(v)
        case "in" | "not_in":
            some = c.isin([lit(x) for x in v]) if v else F.lit(False)
            return some if op == "in" else ~some
        case "like" | "not_like":
            some = c.cast("string").like(str(v))
            return some if op == "like" else ~some
        case "starts_with":
            return c.cast("string").startswith(str(v))
        case "ends_with":
            return c.cast("string").endswith(str(v))
        case "contains":
            return c.cast("string").contains(str(v))
        case "between":
            if not isinstance(v, (list, tuple)) or len(v) != 2:
                raise ValueError(f"between takes two values, not {v!r}")
            return c.between(lit(v[0]), lit(v[1]))
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
    raise ValueError(f"unknown condition {op!r}")
