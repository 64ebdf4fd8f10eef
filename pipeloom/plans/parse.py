"""Documents: reading, parameters and validation."""

from __future__ import annotations

import json
from typing import Any

from pipeloom.functions.aggregates import FUNCTIONS
from pipeloom.functions.where import OPS
from pipeloom.operators.registry import QueryError
from pipeloom.plans.catalog import CATALOG
from pipeloom.plans.pipe import META

JOINS = ("inner", "left", "right", "full", "cross")
PARAMETER_TYPES = {"string": str, "int32": int, "int64": int, "float": float, "bool": bool, "datetime": str}


def load(doc: str | bytes | dict[str, Any]) -> dict[str, Any]:
    """A document from JSON text or a dict; a text that isn't JSON is taken as a pipe in text form."""
    if isinstance(doc, dict):
        return doc
    text = doc.decode() if isinstance(doc, bytes) else doc
    if text.lstrip().startswith("{"):
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise QueryError(f"not JSON: {e}") from e
    from pipeloom.plans.text import parse

    return parse(text)


def is_pipe(q: dict[str, Any]) -> bool:
    return q.get("mode") == "pipe" or bool(q.get("pipe"))


def bind(value: Any, parameters: dict[str, Any]) -> Any:
    """Values that are a parameter's name, with its $, replaced everywhere."""
    if isinstance(value, str) and value.startswith("$"):
        return parameters.get(value, parameters.get(value[1:], value))
    if isinstance(value, list):
        return [bind(v, parameters) for v in value]
    if isinstance(value, dict):
        return {k: v if k == "args" and value.get("op") == "callFunction" else bind(v, parameters) for k, v in value.items()}
    return value


def declared(values: dict[str, Any], declarations: list[dict[str, Any]]) -> dict[str, Any]:
    """Values of declared parameters, checked and with their defaults."""
    out = dict(values)
    for p in declarations:
        if p.get("type") not in PARAMETER_TYPES:
            raise QueryError(f"parameter {p['name']}: unknown type {p.get('type')!r}")
        v = out.get(p["name"], out.get("$" + p["name"], p.get("default")))
        if v is None and p.get("required"):
            raise QueryError(f"parameter {p['name']} is required")
        kind = PARAMETER_TYPES[p["type"]]
        if v is not None and kind is not str:
            try:
                v = {"true": True, "false": False}[str(v).lower()] if kind is bool else kind(v)
            except (KeyError, ValueError) as e:
                raise QueryError(f"parameter {p['name']}: {v!r} is no {p['type']}") from e
        out["$" + p["name"].lstrip("$")] = v
    return out


def where_errors(w: Any, path: str) -> list[str]:
    if not isinstance(w, dict):
        return [f"{path}: must be an object"]
    out = []
    if w.get("field"):
        op = w.get("op", "==")
        if op not in OPS and op != "=":
            out.append(f"{path}.op: unknown condition {op!r}")
        if op == "between" and not (isinstance(w.get("value"), (list, tuple)) and len(w["value"]) == 2):
            out.append(f"{path}.value: between takes two values")
        if op in ("in", "not_in") and not isinstance(w.get("value"), (list, tuple)) and not str(w.get("value")).startswith("$"):
            out.append(f"{path}.value: {op} takes a list")
    for k in ("and", "or"):
        for i, x in enumerate(w.get(k) or []):
            out += where_errors(x, f"{path}.{k}[{i}]")
    return out + (where_errors(w["not"], f"{path}.not") if w.get("not") else [])


def agg_errors(aggs: Any, path: str) -> list[str]:
    out = []
    for i, a in enumerate(aggs or []):
        fn = str(a.get("fn", "")).upper()
        if fn not in FUNCTIONS:
            out.append(f"{path}[{i}].fn: unknown aggregate {a.get('fn')!r}")
        elif fn in ("EXPR", "COUNTIF", "SUMIF") and not a.get("expr"):
            out.append(f"{path}[{i}].expr: {fn} needs it")
        elif fn not in ("COUNT", "EXPR", "COUNTIF") and not a.get("field") and not a.get("expr"):
            out.append(f"{path}[{i}].field: {fn} needs it")
    return out


def stage_errors(stages: Any, path: str = "pipe") -> list[str]:
    out, named = [], set()
    if not isinstance(stages, list):
        return [f"{path}: must be a list"]
    for i, s in enumerate(stages):
        at, op = f"{path}[{i}]", s.get("op") if isinstance(s, dict) else None
        if op not in CATALOG:
            out.append(f"{at}.op: unknown operator {op!r}")
            continue
        if s.get("from") and s["from"] not in named:
            out.append(f"{at}.from: no earlier stage is named {s['from']!r}")
        if s.get("id") in named and s.get("id"):
            out.append(f"{at}.id: {s['id']!r} names two stages")
        named |= {s["id"]} if s.get("id") else set()
        spec = CATALOG[op]
        out += [f"{at}.{x.name}: is required" for x in spec.fields if x.required and s.get(x.name) in (None, "", [], {})]
        known = {x.name for x in spec.fields} | set(META)
        out += [f"{at}.{k}: {op} has no such field" for k in s if k not in known]
        for x in spec.fields:
            if x.choices and s.get(x.name) not in (None, "") and str(s[x.name]).lower() not in [c.lower() for c in x.choices]:
                out.append(f"{at}.{x.name}: must be one of {', '.join(x.choices)}")
        if op in ("filter", "lookup", "asofJoin", "crossJoin") and s.get("where"):
            out += where_errors(s["where"], f"{at}.where")
        if op == "aggregate":
            out += agg_errors(s.get("aggs"), f"{at}.aggs")
        if op == "branch":
            out += [e for k in ("then", "else") if s.get(k) for e in stage_errors(s[k], f"{at}.{k}")]
        if op in ("merge", "intersect"):
            out += [e for k, x in enumerate(s.get("sources") or []) for e in stage_errors(x.get("pipe"), f"{at}.sources[{k}].pipe")]
        if op == "except":
            out += [e for k in ("left", "right") if s.get(k) for e in stage_errors(s[k].get("pipe"), f"{at}.{k}.pipe")]
    return out


def validate(doc: str | dict[str, Any], needs_source: bool = True) -> list[str]:
    """What is wrong with a document's shape, each with its path; no services are needed."""
    try:
        q = load(doc)
    except QueryError as e:
        return [str(e)]
    out = []
    src = q.get("from")
    if needs_source and not (src if isinstance(src, str) else (src or {}).get("dataset")):
        out.append("from: is required")
    if q.get("mode") not in (None, "", "classic", "pipe"):
        out.append(f"mode: unknown mode {q['mode']!r}")
    if is_pipe(q):
        return out + stage_errors(q.get("pipe") or [])
    for k in ("where", "having"):
        out += where_errors(q[k], k) if q.get(k) else []
    if q.get("having") and not (q.get("groupBy") or q.get("aggregate")):
        out.append("having: needs groupBy or aggregate")
    out += agg_errors(q.get("aggregate"), "aggregate")
    for i, j in enumerate(q.get("join") or []):
        if (j.get("type") or "inner").lower() not in JOINS:
            out.append(f"join[{i}].type: unknown join type {j.get('type')!r}")
        if not j.get("dataset"):
            out.append(f"join[{i}].dataset: is required")
        if (j.get("type") or "inner").lower() != "cross" and not ((j.get("on") or {}).get("left") and (j.get("on") or {}).get("right")):
            out.append(f"join[{i}].on: needs left and right")
    for i, o in enumerate(q.get("orderBy") or []):
        if isinstance(o, dict) and str(o.get("dir") or "asc").lower() not in ("asc", "desc"):
            out.append(f"orderBy[{i}].dir: must be asc or desc")
    for k in ("limit", "offset"):
        if q.get(k) is not None and (not isinstance(q[k], int) or q[k] < 0):
            out.append(f"{k}: must be a whole number from 0")
    for i, c in enumerate(q.get("computed") or []):
        out += [f"computed[{i}].{k}: is required" for k in ("name", "expr") if not c.get(k)]
    return out
