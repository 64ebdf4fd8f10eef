"""flatten, unnestObject, nest, pivot, unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.functions.aggregates import aggregate as column_of
from pipeloom.functions.where import literal
from pipeloom.operators.registry import QueryError, cols, known, register
from pipeloom.plans.frame import HIDDEN, Frame, _next


#: Columns that a pass over the data may find; the plan of a wider table would be of no use.
MOST_FOUND = 10_000


def found(names: DataFrame, what: str) -> list:
    """The rows of a short list; a list of over MOST_FOUND is refused before it comes to the driver."""
    rows = names.limit(MOST_FOUND + 1).collect()
    if len(rows) > MOST_FOUND:
        raise QueryError(f"{what}: over {MOST_FOUND} columns; name those wanted")
    return rows


@register("flatten")
def flatten(f: Frame, cfg: dict, ctx) -> Frame:
    name, into, index, keep = cfg["field"], cfg.get("as") or cfg["field"], cfg.get("indexAs"), bool(cfg.get("preserveEmpty"))
    c, kind = known(f, name), f.df.schema[name].dataType
    if not isinstance(kind, T.ArrayType):  # a scalar has no elements
        if not keep:
            return f.with_df(f.df.filter(F.lit(False)))
        f = f.set_column(into, F.lit(None).cast(kind))
        return f.set_column(index, F.lit(None).cast("bigint")) if index else f
    f = f.keeping_order([into, *([index] if index else [])])
    pos, item = f"{HIDDEN}{next(_next)}", f"{HIDDEN}item"
    df = f.df.select("*", (F.posexplode_outer if keep else F.posexplode)(c).alias(pos, item)).withColumn(into, F.col(item)).drop(item)
    df = df.withColumn(index, F.col(pos).cast("bigint")) if index else df
    return Frame(df, (*f.order, (pos, True)))


@register("unnestObject")
def unnest_object(f: Frame, cfg: dict, ctx) -> Frame:
    """Structs spread by their fields. Maps and JSON texts have their keys in `keys`, or else in a pass over the data."""
    name, prefix = cfg["field"], cfg.get("prefix") or ""
    c, kind = known(f, name), f.df.schema[name].dataType
    if isinstance(kind, T.StructType):
        made = {k: c.getField(k) for k in kind.names}
    else:
        if isinstance(kind, T.StringType):
            schema = cfg.get("schema")
            if not schema:
                schema = _json_schema(f, name, cfg.get("keys"))
            parsed = F.from_json(c, schema)
            made = {k: parsed.getField(k) for k in f.df.select(parsed.alias("x")).schema["x"].dataType.names}
        elif isinstance(kind, T.MapType):
            keys = cfg.get("keys") or sorted(r[0] for r in found(f.df.select(F.explode(F.map_keys(c)).alias("k")).distinct(), "unnestObject"))
            made = {k: F.try_element_at(c, F.lit(k)) for k in keys}
        else:
            raise QueryError(f"unnestObject: {name!r} is no object")
    for k, v in made.items():
        f = f.set_column(prefix + k, v)
    if cfg.get("drop"):
        f = f.keeping_order([name])
        f = f.with_df(f.df.drop(name)) if name not in [prefix + k for k in made] else f
    return f


def _json_schema(f: Frame, name: str, keys: list[str] | None) -> T.StructType:
    """Fields of JSON texts with their widest type: names and kinds are counted in one aggregate."""
    pairs = f.df.select(F.explode(F.from_json(F.col(f"`{name}`"), "map<string,string>")).alias("k", "v"))
    kinds = pairs.groupBy("k").agg(F.bool_and(F.col("v").rlike(r"^-?\d{1,18}$")).alias("i"), F.bool_and(F.col("v").try_cast("double").isNotNull()).alias("d"), F.bool_and(F.col("v").isin("true", "false")).alias("b"))
    if keys:
        kinds = kinds.where(F.col("k").isin(*keys))
    kind_of = {r["k"]: "bigint" if r["i"] else "double" if r["d"] else "boolean" if r["b"] else "string" for r in found(kinds, "unnestObject")}
    return T.StructType([T.StructField(k, {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[kind_of.get(k, "string")]) for k in (keys or sorted(kind_of))])


@register("nest")
def nest(f: Frame, cfg: dict, ctx) -> Frame:
    by, include = cfg["by"], cfg.get("include") or [c for c in f.columns if c not in cfg["by"]]
    record = F.struct(*cols(f, include))
    order = f.order_columns()
    from pipeloom.functions.aggregates import _sorted

    rows = F.transform(_sorted(record, order), lambda x: x["v"]) if order else F.collect_list(record)
    return Frame(f.df.groupBy(*cols(f, by)).agg(rows.alias(cfg["into"])), tuple((k, True) for k in by))


@register("pivot")
def pivot(f: Frame, cfg: dict, ctx) -> Frame:
    """Cells without a source row get fillValue; those whose rows aggregate to null stay null. `values` saves the pass that finds
    the names of the new columns."""
    keys, column_key, value, how, prefix = cfg.get("rowKeys") or [], cfg["columnKey"], cfg["valueField"], (cfg.get("aggregate") or "first").upper(), cfg.get("prefix") or ""
    names = [str(v) for v in cfg["values"]] if cfg.get("values") else sorted(r[0] for r in found(f.df.select(F.coalesce(known(f, column_key).cast("string"), F.lit("null"))).distinct(), "pivot"))
    agg = column_of(f.df, {"fn": how, "field": value, "as": "v"}, f.order_columns())
    cells = f.df.withColumn(f"{HIDDEN}c", F.coalesce(known(f, column_key).cast("string"), F.lit("null")))
    wide = cells.groupBy(*cols(f, keys)).pivot(f"{HIDDEN}c", names).agg(agg, F.count(F.lit(1)).alias("n"))
    kind = cells.agg(agg).schema["v"].dataType
    fill = literal(cfg.get("fillValue"), kind).cast(kind)
    out = [F.when(F.coalesce(F.col(f"`{n}_n`"), F.lit(0)) == 0, fill).otherwise(F.col(f"`{n}_v`")).alias(prefix + n) for n in names]
    return Frame(wide.select(*(F.col(f"`{k}`") for k in keys), *out), tuple((k, True) for k in keys))


@register("unpivot")
def unpivot(f: Frame, cfg: dict, ctx) -> Frame:
    ids, values = cfg.get("idCols"), cfg.get("valueCols")
    if ids is None:
        ids = [c for c in f.columns if c not in (values or [])] if values else []
    values = values or [c for c in f.columns if c not in ids]
    cols(f, [*ids, *values])
    kinds = {f.df.schema[v].dataType.simpleString() for v in values}
    number = all(isinstance(f.df.schema[v].dataType, T.NumericType) for v in values)
    f = f.keeping_order(n for n, _ in f.order if n not in ids and not n.startswith(HIDDEN))
    cell = lambda v: F.col(f"`{v}`") if len(kinds) == 1 else F.col(f"`{v}`").cast("double" if number else "string")
    place, x = f"{HIDDEN}{next(_next)}", f"{HIDDEN}x"
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("n"), cell(v).alias("v")) for i, v in enumerate(values)))
    hidden = [c for c in f.df.columns if c.startswith(HIDDEN)]
    df = f.df.select(*(F.col(f"`{c}`") for c in ids), *hidden, F.explode(rows).alias(x))
    df = df.select(*(F.col(f"`{c}`") for c in ids), F.col(f"{x}.n").alias(cfg["nameAs"]), F.col(f"{x}.v").alias(cfg["valueAs"]), *hidden, F.col(f"{x}.i").alias(place))
    return Frame(df, (*f.order, (place, True)))
