"""Operators by name: compile(frame, config, context) -> frame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipeloom.functions.expr import column
from pipeloom.plans.frame import Frame

Compile = Callable[[Frame, dict[str, Any], Any], Frame]
OPERATORS: dict[str, Compile] = {}


class QueryError(ValueError):
    """A query document that can't be compiled."""


def register(name: str) -> Callable[[Compile], Compile]:
    """Adds an operator; a name can be taken once."""

    def add(f: Compile) -> Compile:
        if name in OPERATORS:
            raise ValueError(f"operator {name!r} is registered already")
        OPERATORS[name] = f
        return f

    return add


def sort_spec(frame: Frame, by: Any) -> list[tuple[Column, bool]]:
    """Sort keys of ["a"], [{"field", "dir"}] or [{"expr", "dir"}]."""
    out = []
    for k in by or []:
        k = {"field": k} if isinstance(k, str) else k
        up = str(k.get("dir") or "asc").lower()
        if up not in ("asc", "desc"):
            raise QueryError(f"dir must be asc or desc, not {k['dir']!r}")
        out.append((column(k["expr"]) if k.get("expr") else known(frame, k["field"]), up == "asc"))
    return out


def known(frame: Frame, name: str) -> Column:
    if name not in frame.df.columns:
        if "." in name and name.split(".")[0] in frame.df.columns:
            return F.col(name)
        raise QueryError(f"no column {name!r}; there are {', '.join(frame.columns)}")
    return F.col(f"`{name}`")


def cols(frame: Frame, names: list[str]) -> list[Column]:
    return [known(frame, n) for n in names]
