"""callFunction, callApp, algo: what the host registers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.operators.registry import QueryError, known, register
from pipeloom.plans.frame import HIDDEN, Frame


@register("callFunction")
def call_function(f: Frame, cfg: dict, ctx) -> Frame:
    """perRow: the function gets the row's columns and the arguments as a dict, and its result goes to `as`; of a struct without
    `as`, each field becomes a column. batch: the function turns the DataFrame into another, or pandas frames into frames of
    the registered schema. Functions on Arrow batches keep rows in their places."""
    fn = ctx.function(cfg["name"])
    mode, args = cfg.get("mode") or "perRow", cfg.get("args") or {}
    if mode == "batch":
        if fn.whole:
            return Frame(fn.call(f.visible(), args), tuple(k for k in f.order if k[0] in f.columns))
        schema = fn.schema()
        return Frame(f.visible().mapInPandas(lambda frames: (fn.call(x, args) for x in frames), schema))
    if mode != "perRow":
        raise QueryError(f"callFunction: unknown mode {mode!r}")
    resolved = {}
    for k, v in args.items():
        resolved[k] = known(f, v[1:]) if isinstance(v, str) and v.startswith("$") and not cfg.get("literalArgs") else F.lit(v) if not isinstance(v, (dict, list)) else F.lit(None)
    fixed = {k: v for k, v in args.items() if isinstance(v, (dict, list))}
    given = F.struct(*(F.col(f"`{c}`") for c in f.columns if c not in resolved), *(c.alias(k) for k, c in resolved.items()))
    kind = fn.kind()
    call = fn.call

    if isinstance(kind, T.StructType):

        def rows(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([call({**r, **fixed}) or {} for r in x.to_dict("records")], columns=kind.names, index=x.index)
    else:

        def rows(x: pd.DataFrame) -> pd.Series:
            return pd.Series([call({**r, **fixed}) for r in x.to_dict("records")], index=x.index)

    out = F.pandas_udf(rows, kind)(given)
    if isinstance(kind, T.StructType) and not cfg.get("as"):
        r = f"{HIDDEN}call"
        f = f.with_df(f.df.withColumn(r, out))
        for n in kind.names:
            f = f.set_column(n, F.col(f"{r}.`{n}`"))
        return f.with_df(f.df.drop(r))
    return f.set_column(cfg.get("as") or "_result", out)


@register("callApp")
def call_app(f: Frame, cfg: dict, ctx) -> Frame:
    """A batch app turns the DataFrame into another, and None into the same one; else it gets a row as a dict at a time."""
    app = ctx.app(cfg["appId"], cfg.get("method") or "transform", cfg.get("capability") or "pipe_query")
    payload = {**(cfg.get("payload") or {}), **({"dataset": cfg["dataset"]} if cfg.get("dataset") else {})}
    if cfg.get("batch", True):
        out: DataFrame | None = app.call(f.visible(), payload)
        return f if out is None else Frame(out, tuple(k for k in f.order if k[0] in out.columns))
    schema, call = app.schema(), app.call

    def each(frames):
        for x in frames:
            yield pd.DataFrame([call(r, payload) for r in x.to_dict("records")], columns=schema.names)

    out = f.visible().mapInPandas(each, schema)
    return Frame(out, tuple(k for k in f.order if k[0] in out.columns))


@register("algo")
def algo(f: Frame, cfg: dict, ctx) -> Frame:
    out = ctx.algorithm(cfg["name"])(f.visible(), cfg.get("params") or {})
    return Frame(out, tuple(k for k in f.order if k[0] in out.columns))
