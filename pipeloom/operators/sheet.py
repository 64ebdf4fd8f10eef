"""sheet: a set of formulas, run in the order of their references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeloom.functions.expr import column, references, tokens, translate
from pipeloom.operators.registry import QueryError, register
from pipeloom.plans.frame import HIDDEN, Frame


def ordered(formulas: list[dict]) -> list[dict]:
    """Formulas after those that they refer to; otherwise as declared. A cycle is an error that names its members."""
    names = [x.get("as") or "" for x in formulas]
    if not formulas:
        raise QueryError("sheet needs formulas")
    if any(not n.strip() for n in names):
        raise QueryError("sheet: a formula needs a name in as")
    if len(set(names)) < len(names):
        raise QueryError(f"sheet: {', '.join(sorted({n for n in names if names.count(n) > 1}))} is there twice")
    for x in formulas:
        if bool(x.get("expr")) == bool(x.get("reduce")):
            raise QueryError(f"sheet: {x['as']} takes one of expr and reduce")
    needs = {x["as"]: {r for r in references(x.get("expr") or x["reduce"]) if r in names} for x in formulas}
    out, left = [], list(formulas)
    while left:
        ready = next((x for x in left if needs[x["as"]] <= {y["as"] for y in out}), None)
        if ready is None:
            rest = {x["as"] for x in left}
            while rest != (inner := {n for n in rest if needs[n] & rest and any(n in needs[m] for m in rest)}):
                rest = inner
            raise QueryError(f"sheet: formulas refer to each other: {', '.join(sorted(rest))}")
        out.append(ready)
        left.remove(ready)
    return out


def reduced(text: str, ctx) -> str:
    """`fn(col)`, or `col fn` after the column."""
    parts = text.split()
    if len(parts) == 2 and parts[1] in ("sum", "avg", "min", "max", "count") and "(" not in text:
        text = f"{parts[1]}({parts[0]})"
    toks = tokens(text)
    return " ".join(ctx.reduces.get(v, v) if kind == "name" and toks[i + 1 : i + 2] == [("op", "(")] else v for i, (kind, v) in enumerate(toks))


@register("sheet")
def sheet(f: Frame, cfg: dict, ctx) -> Frame:
    """Row formulas become columns. Each run of whole-column reduces is one aggregate, whose single row is broadcast back, so that
    no window gathers all rows in one task.

    onError null makes errors nulls. A cell counts as failed if it is null though all columns that its formula reads have values;
    the result's errors tell their number and some of them.
    """
    formulas, on_error = ordered(cfg["formulas"]), cfg.get("onError") or "fail"
    if on_error not in ("fail", "null"):
        raise QueryError(f"sheet: unknown onError {on_error!r}")
    have = set(f.columns) | {x["as"] for x in formulas}
    missing = sorted({r for x in formulas for r in references(x.get("expr") or x["reduce"]) if r not in have and r.split(".")[0] not in have and r not in ("sum", "avg", "min", "max", "count")})
    if missing:
        raise QueryError(f"sheet: no column {', '.join(missing)}")
    conf, key = f.df.sparkSession.conf, "spark.sql.ansi.enabled"
    ansi = conf.get(key)
    if on_error == "null":
        conf.set(key, "false")
    try:
        waiting: list[dict] = []
        flags: dict[str, str] = {}  # formula -> hidden column

        def flush(f: Frame) -> Frame:
            if not waiting:
                return f
            row: DataFrame = f.df.agg(*(F.expr(translate(reduced(x["reduce"], ctx))).alias(f"__ord_r{i}") for i, x in enumerate(waiting)))
            f = f.with_df(f.df.crossJoin(F.broadcast(row)))
            for i, x in enumerate(waiting):
                f = f.set_column(x["as"], F.col(f"__ord_r{i}"))
            f = f.with_df(f.df.drop(*(f"__ord_r{i}" for i in range(len(waiting)))))
            waiting.clear()
            return f

        for x in formulas:
            text = x.get("expr") or x["reduce"]
            if any(r in {y["as"] for y in waiting} for r in references(text)):
                f = flush(f)
            if x.get("reduce"):
                waiting.append(x)
            else:
                read = [f"`{r}`" if r in f.df.columns else r for r in references(text)]
                value = column(text)
                if on_error == "null":
                    flags[x["as"]] = flag = f"{HIDDEN}failed{len(flags)}"
                    f = f.with_df(f.df.withColumn(flag, reduce(Column.__and__, (F.col(r).isNotNull() for r in read), value.isNull())))
                f = f.set_column(x["as"], value)
        f = flush(f)
        if flags:
            ctx.sheets.append((list(flags), f, list(flags.values())))
            f = f.with_df(f.df.drop(*flags.values()))
        return f
    finally:
        conf.set(key, ansi)
