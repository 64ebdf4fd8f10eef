"""The expression language: Spark SQL expressions, with a few spellings of other languages translated outside of string literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"""\s+|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<quoted>`[^`]*`)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)|(?P<op>->|&&|\|\||==|!=|<=>|<=|>=|<>|::|.)""", re.DOTALL)  # fmt: skip
WORDS = frozenset(
    "and or not in is null true false like rlike ilike between case when then else end as distinct cast try_cast interval date timestamp escape over partition by order rows range unbounded preceding following current row asc desc nulls first last "
    "int integer bigint long double float string boolean decimal year years month months week weeks day days hour hours minute minutes second seconds millisecond milliseconds microsecond microseconds div from for filter where within group".split()
)
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return out


def interval_us(text: str) -> int:
    """Microseconds of "5m", "1h30m", "1d" or "1w"."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw])", text or "")
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not an interval: {text!r}")
    us = round(sum(float(n) * UNITS[u] for n, u in parts))
    if us <= 0:
        raise ValueError(f"an interval must be longer than nothing: {text!r}")
    return us


def translate(text: str, bars_are_or: bool = True) -> str:
    """Spark SQL for an expression: && || ! and ns::name become Spark's, duration("1h") an interval."""
    toks, out, i = tokens(text), [], 0
    while i < len(toks):
        kind, v = toks[i]
        if kind == "op" and v == "&&":
            v = "AND"
        elif kind == "op" and v == "||" and bars_are_or:
            v = "OR"
        elif kind == "op" and v == "!":
            v = "NOT"
        elif kind == "name" and "::" in v:
            v = v.rsplit("::", 1)[1]
        elif kind == "name" and v == "duration" and [t for _, t in toks[i + 1 : i + 2]] == ["("] and i + 3 < len(toks) and toks[i + 2][0] == "string":
            us = interval_us(toks[i + 2][1][1:-1])
            v, i = f"INTERVAL {us // 1_000_000}.{us % 1_000_000:06d} SECOND", i + 3
            v = f"INTERVAL '{us // 1_000_000}.{us % 1_000_000:06d}' SECOND"
        out.append(v)
        i += 1
    return " ".join(out).replace(" . ", ".")


def column(text: str) -> Column:
    return F.expr(translate(text))


def references(text: str) -> list[str]:
    """Column names that an expression reads, in order: not functions, literals, lambda parameters or fields of structs."""
    toks = [t for t in tokens(text)]
    bound: set[str] = set()
    for i, (_, v) in enumerate(toks):
        if v == "->" and i:
            if toks[i - 1][1] == ")":
                j = i - 1
                while j >= 0 and toks[j][1] != "(":
                    bound |= {toks[j][1]} if toks[j][0] == "name" else set()
                    j -= 1
            else:
                bound.add(toks[i - 1][1])
    out: dict[str, None] = {}
    for i, (kind, v) in enumerate(toks):
        before = toks[i - 1][1] if i else ""
        after = toks[i + 1][1] if i + 1 < len(toks) else ""
        if kind == "quoted":
            out.setdefault(v[1:-1])
        elif kind == "name" and after != "(" and before != "." and v.lower() not in WORDS and v not in bound:
            out.setdefault(v)
    return list(out)


def truthy(c: Column, kind: T.DataType) -> Column:
    """Null is false; strings are true but for "", "false" and "0", numbers but for 0; other values are true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(~c.isin("", "false", "0"), F.lit(False))
    return c.isNotNull()


def truthy_expr(df, text: str) -> Column:
    c = column(text)
    return truthy(c, df.select(c.alias("x")).schema["x"].dataType)


#: Spreadsheet functions and what they are here; others are looked up by their own name.
SHEET = {"AVERAGE": "avg", "CONCATENATE": "concat", "LEN": "length", "MID": "substring", "ROUND": "round", "ABS": "abs", "POWER": "power", "SQRT": "sqrt", "MOD": "mod", "UPPER": "upper", "LOWER": "lower", "TRIM": "trim", "LEFT": "left", "RIGHT": "right", "INT": "floor", "IFERROR": "coalesce", "ISBLANK": "isnull", "AND": "__and", "OR": "__or", "NOT": "not", "MAX": "max", "MIN": "min", "SUM": "sum", "COUNT": "count"}
WHOLE = {"avg", "sum", "count", "min", "max"}


def formula(text: str) -> tuple[Column, dict[str, str]]:
    """A spreadsheet formula, and the aggregates over all rows that it reads as columns, by their names there: SUM(x) and the like
    of one argument. Aggregates of several arguments are taken within the row. = is equality, <> inequality, & concatenates."""
    toks = tokens(text.strip().removeprefix("="))
    pos = 0
    wholes: dict[str, str] = {}

    def peek() -> str:
        return toks[pos][1] if pos < len(toks) else ""

    def take() -> tuple[str, str]:
        nonlocal pos
        pos += 1
        return toks[pos - 1]

    def compare() -> str:
        left = joined()
        while peek() in ("=", "==", "<>", "!=", "<", ">", "<=", ">="):
            op = take()[1]
            left = f"({left} {'=' if op == '==' else op} {joined()})"
        return left

    def joined() -> str:
        parts = [added()]
        while peek() == "&":
            take()
            parts.append(added())
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    def added() -> str:
        left = times()
        while peek() in ("+", "-"):
            op = take()[1]
            left = f"({left} {op} {times()})"
        return left

    def times() -> str:
        left = power()
        while peek() in ("*", "/"):
            op, right = take()[1], power()
            left = f"({left} {op} {right})" if op == "*" else f"try_divide({left}, {right})"
        return left

    def power() -> str:
        left = unary()
        if peek() == "^":
            take()
            return f"power({left}, {power()})"
        return left

    def unary() -> str:
        if peek() == "-":
            take()
            return f"(-{unary()})"
        value = atom()
        while peek() == "%":
            take()
            value = f"({value} / 100)"
        return value

    def atom() -> str:
        kind, v = take()
        if v == "(":
            inner = compare()
            take()
            return f"({inner})"
        if kind == "name" and peek() == "(":
            take()
            args = []
            while peek() != ")":
                args.append(compare())
                if peek() in (",", ";"):
                    take()
            take()
            return call(v.upper(), args)
        if kind == "string":
            return "'" + v[1:-1].replace("'", "\\'") + "'"
        if kind == "name" and v.upper() in ("TRUE", "FALSE"):
            return v.lower()
        return f"`{v}`" if kind == "name" else v

    def call(name: str, args: list[str]) -> str:
        if name == "IF":
            return f"CASE WHEN {args[0]} THEN {args[1]} ELSE {args[2] if len(args) > 2 else 'false'} END"
        f = SHEET.get(name, name.lower())
        if f in ("__and", "__or"):
            return "(" + f" {f[2:]} ".join(args) + ")"
        if f in WHOLE:
            if len(args) == 1:
                name = f"__ord_whole{len(wholes)}"
                wholes[name] = f"{f}({args[0]})"
                return f"`{name}`"
            return {"sum": f"({' + '.join(args)})", "avg": f"({' + '.join(args)}) / {len(args)}", "min": f"least({', '.join(args)})", "max": f"greatest({', '.join(args)})", "count": "(" + " + ".join(f"int({a} is not null)" for a in args) + ")"}[f]
        return f"{f}({', '.join(args)})"

    out = compare()
    if pos != len(toks):
        raise ValueError(f"formula goes on after its end: {text!r}")
    return F.expr(out), wholes
