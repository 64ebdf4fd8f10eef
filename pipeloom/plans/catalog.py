"""What each operator takes: for validation, JSON Schema, completion and documentation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operator:
    name: str
    about: str
    fields: tuple[Field, ...]
    category: str
    #: Whether re-running it on changed rows has no side effect.
    live: bool = True
    #: Services of the host that it needs.
    needs: tuple[str, ...] = ()


def _op(name: str, category: str, about: str, fields: str, live: bool = True, needs: tuple[str, ...] = ()) -> Operator:
    """fields: `name:kind`, with ! if required and choices as =a|b|c."""
    out = []
    for f in fields.split():
        head, _, choices = f.partition("=")
        field, _, kind = head.partition(":")
        out.append(Field(field.rstrip("!"), kind or "string", field.endswith("!"), tuple(choices.split("|")) if choices else ()))
    return Operator(name, about, tuple(out), category, live, needs)


CATALOG: dict[str, Operator] = {
    o.name: o
    for o in (
        _op("filter", "rows", "Keeps rows for which a condition is true.", "where!:object"),
        _op("project", "columns", "Keeps or drops columns, with new names and expressions.", "select:array drop:array"),
        _op("rename", "columns", "Renames columns, all at once.", "map!:object"),
        _op("drop", "columns", "Drops columns.", "columns!:array"),
        _op("compute", "columns", "Adds a column by an expression or a spreadsheet formula.", "as! kind=expr|formula expr formula"),
        _op("sheet", "columns", "Adds columns by formulas that may refer to each other and to whole columns.", "formulas!:array onError=fail|null columnBudgetBytes:integer"),
        _op("transform", "columns", "Adds columns one after another; drops or keeps only these.", "compute!:array drop:array replace:boolean"),
        _op("cast", "quality", "Changes columns' types.", "casts!:array"),
        _op("dropNulls", "quality", "Drops rows with nulls.", "columns:array any:boolean"),
        _op("fillNulls", "quality", "Fills nulls with a value, a mean or a neighbour's value.", "columns:array method=value|zero|lastValue|nextValue|mean value:any partitionBy:array orderBy:array"),
        _op("flatten", "reshape", "A row for each element of an array.", "field! as indexAs preserveEmpty:boolean"),
        _op("unnestObject", "reshape", "An object's keys become columns.", "field! prefix drop:boolean keys:array"),
        _op("nest", "reshape", "Groups become one row with a list of records.", "by!:array into! include:array"),
        _op("pivot", "reshape", "A column's values become columns.", "rowKeys:array columnKey! valueField! aggregate fillValue:any prefix values:array"),
        _op("unpivot", "reshape", "Columns become rows of name and value.", "idCols:array valueCols:array nameAs! valueAs!"),
        _op("distinct", "rows", "One row of each kind.", "by:array"),
        _op("dedupe", "quality", "The first or last row of each key.", "by!:array keep=first|last orderBy:array"),
        _op("sample", "quality", "Some rows, at random or at even distances.", "n:integer ratio:number seed:integer method=random|systematic"),
        _op("assert", "quality", "Fails the query unless an expression holds.", "scope=row|overall expr! message"),
        _op("timeBucket", "time", "The start of the time bucket that a row falls in.", "field! interval! as! tz origin"),
        _op("gapfill", "time", "Adds rows for missing times.", "field! interval! method=zero|null|lastValue|value value:any from to groupBy:array carry:array"),
        _op("sort", "rows", "Orders rows; equal ones keep their order.", "by!:array"),
        _op("limit", "rows", "The first rows.", "n:integer"),
        _op("skip", "rows", "All but the first rows.", "n:integer"),
        _op("topPerGroup", "rows", "The first rows of each group by a sort.", "n!:integer by!:array partitionBy:array"),
        _op("groupBy", "aggregation", "Keys for the next aggregate.", "keys!:array"),
        _op("aggregate", "aggregation", "A row per group with aggregates.", "keys:array aggs!:array"),
        _op("histogram", "aggregation", "Counts in bins of equal width.", "field! bins!:integer min:number max:number asCount asStart asEnd"),
        _op("window", "aggregation", "A window function per row.", "fn!=row_number|rank|dense_rank|lag|lead|first_value|last_value partitionBy:array orderBy:array field offset:integer default:any as!"),
        _op("lookup", "joins", "Columns of the one matching row of a dataset.", "dataset! on!:object mode=left|inner as select:array where:object limit:integer cacheTtlMs:integer", needs=("datasets",)),
        _op("asofJoin", "joins", "Columns of the row of a dataset that is nearest in time.", "dataset! leftTime! rightTime! leftKey rightKey direction=backward|forward|nearest tolerance as select:array where:object limit:integer", needs=("datasets",)),
        _op("crossJoin", "joins", "Every pair with a dataset's rows.", "dataset! as select:array where:object limit:integer", needs=("datasets",)),
        _op("intersect", "sets", "Rows that all sub-pipes have.", "sources!:array by:array"),
        _op("except", "sets", "Rows of one sub-pipe that another lacks.", "left!:object right!:object by:array"),
        _op("callFunction", "host", "Calls a registered function per row or batch.", "name! mode=perRow|batch pure:boolean args:object literalArgs:boolean as", False, ("functions",)),
        _op("callApp", "host", "Calls a registered app with the rows.", "appId! method capability batch:boolean payload:object dataset", False, ("apps",)),
        _op("algo", "host", "Runs a registered algorithm over the rows.", "name! params:object", needs=("algorithms",)),
        _op("branch", "control", "Sub-pipes by a condition.", "when! then!:array else:array dropElse:boolean"),
        _op("merge", "control", "The rows of all sub-pipes.", "sources!:array"),
        _op("tap", "control", "Counts the rows that pass.", "label"),
    )
}

KINDS: dict[str, dict[str, Any]] = {"any": {}, "array": {"type": "array"}, "boolean": {"type": "boolean"}, "integer": {"type": "integer"}, "number": {"type": "number"}, "object": {"type": "object"}, "string": {"type": "string"}}


def operator_schema(op: Operator) -> dict[str, Any]:
    props: dict[str, Any] = {"op": {"const": op.name}, "id": {"type": "string"}, "from": KINDS["string"]}
    for f in op.fields:
        if f.name == "from" and op.name != "gapfill":
            continue
        props[f.name] = {**KINDS[f.kind], **({"enum": list(f.choices)} if f.choices else {})}
    return {"type": "object", "description": op.about, "properties": props, "required": ["op", *(f.name for f in op.fields if f.required)], "additionalProperties": False}


def json_schema() -> dict[str, Any]:
    """Draft-07 schema of a pipe document."""
    return {
        "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["from", "pipe"],
        "properties": {
            "mode": {"const": "pipe"}, "from": {"oneOf": [{"type": "string"}, {"type": "object", "properties": {"dataset": {"type": "string"}}, "required": ["dataset"]}]},
            "parameters": {"type": "object"}, "pipe": {"type": "array", "maxItems": 32, "items": {"oneOf": [{"$ref": f"#/definitions/{n}"} for n in CATALOG]}},
        },
        "definitions": {n: operator_schema(o) for n, o in CATALOG.items()},
    }


def missing_requirements(op: str, ctx) -> list[str]:
    """Services that the operator needs and the context has none of."""
    have = {"datasets": bool(ctx.datasets.names()), "functions": bool(ctx.functions), "apps": bool(ctx.apps), "algorithms": bool(ctx.algorithms)}
    return [n for n in CATALOG[op].needs if not have[n]]


def reference() -> str:
    """All operators as Markdown."""
    out = ["# Operators", ""]
    for o in CATALOG.values():
        out += [f"## `{o.name}`", "", o.about, "", "| field | type | required | choices |", "|---|---|---|---|"]
        out += [f"| `{f.name}` | {f.kind} | {'yes' if f.required else ''} | {', '.join(f.choices)} |" for f in o.fields] + [""]
    return "\n".join(out)
