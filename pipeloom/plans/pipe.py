"""Pipes: stages in order, each consuming the one before or a named one."""

from __future__ import annotations

from typing import Any

from pipeloom.operators import OPERATORS
from pipeloom.operators.registry import QueryError
from pipeloom.plans.frame import Frame

META = ("op", "id", "from")


def config(stage: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in stage.items() if k not in META}


def run_stages(frame: Frame, stages: list[dict[str, Any]], ctx, seen=None, named: dict[str, Frame] | None = None) -> Frame:
    """seen: called with (index, stage, frame) after each stage. named: earlier stages that `from` may name. A stage that two others consume is planned twice, and read
    once where Spark finds the common exchange."""
    if len(stages) > ctx.max_stages:
        raise QueryError(f"a pipe has at most {ctx.max_stages} stages, not {len(stages)}")
    named = {} if named is None else named
    for i, stage in enumerate(stages):
        op = stage.get("op")
        if op not in OPERATORS:
            raise QueryError(f"pipe[{i}]: unknown operator {op!r}")
        if stage.get("from"):
            if stage["from"] not in named:
                raise QueryError(f"pipe[{i}]: no earlier stage is named {stage['from']!r}")
            frame, ctx.group_keys = named[stage["from"]], None
        after = stages[i + 1] if i + 1 < len(stages) else {}
        ctx.following = None if after.get("from") or stage.get("id") else after.get("op")
        try:
            frame = OPERATORS[op](frame, config(stage), ctx)
        except KeyError as e:
            raise QueryError(f"pipe[{i}] ({op}): {e.args[0]!r} is missing") from e
        if op not in ("groupBy", "aggregate", "tap"):
            ctx.group_keys = ctx.group_keys if op == "filter" else None
        if stage.get("id"):
            if stage["id"] in named:
                raise QueryError(f"pipe[{i}]: {stage['id']!r} names two stages")
            named[stage["id"]] = frame
        if seen:
            seen(i, stage, frame)
    return frame
