"""The engine: documents in, lazy results out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.operators.registry import QueryError
from pipeloom.plans import classic, parse
from pipeloom.plans.catalog import CATALOG
from pipeloom.plans.context import Context, mentions_version
from pipeloom.plans.frame import Frame
from pipeloom.plans.pipe import run_stages

DEFAULT_LIMIT, MAX_LIMIT, MAX_ROWS = 100, 10_000, 100_000
#: Columns that name a user in any dataset.
SYSTEM_USERS = ("created_by", "updated_by", "deleted_by", "committed_by")


@dataclass
class Result:
    """A query's rows, not yet computed. df has no order of its own; ordered() sorts it."""

    frame: Frame
    source: str
    computed: frozenset[str] = frozenset()
    aggregated: frozenset[str] = frozenset()
    page_size: int | None = None
    offset: int = 0
    stages: list[dict[str, Any]] = field(default_factory=list)
    observed: list[Observation | None] = field(default_factory=list)
    taps: dict[str, Observation] = field(default_factory=dict)
    sheets: list[tuple[list[str], Frame, list[str]]] = field(default_factory=list)
    ms: int | None = None

    @property
    def df(self) -> DataFrame:
        return self.frame.visible()

    def ordered(self) -> DataFrame:
        return self.frame.sorted().select(*(F.col(f"`{c}`") for c in self.frame.columns))

    @cached_property
    def _rows(self) -> list[Row]:
        began = time.monotonic()
        cap = (self.page_size or MAX_ROWS) + 1
        rows = self.ordered().limit(cap).collect()
        if self.page_size is None and len(rows) > MAX_ROWS:
            raise QueryError(f"the result has more than {MAX_ROWS} rows; read .df instead")
        self.ms = round((time.monotonic() - began) * 1000)
        return rows

    @property
    def rows(self) -> list[dict[str, Any]]:
        """The page's rows, or all of a result without pages, up to MAX_ROWS."""
        return [r.asDict(recursive=True) for r in self._rows[: self.page_size]]

    @property
    def has_more(self) -> bool:
        return self.page_size is not None and len(self._rows) > self.page_size

    @property
    def page(self) -> int | None:
        return None if not self.page_size else self.offset // self.page_size + 1

    def total(self) -> int:
        return self.df.count()

    @property
    def columns(self) -> list[dict[str, str]]:
        def kind(t: T.DataType) -> str:
            return "number" if isinstance(t, T.NumericType) else "bool" if isinstance(t, T.BooleanType) else "array" if isinstance(t, T.ArrayType) else "object" if isinstance(t, (T.StructType, T.MapType)) else "string"

        return [{"name": f.name, "type": kind(f.dataType), "source": "aggregate" if f.name in self.aggregated else "computed" if f.name in self.computed else "raw"} for f in self.df.schema]

    def stats(self) -> dict[str, Any]:
        """Counts by stage, of the last run. A stage whose rows no action has read has none."""
        counts: list[int | None] = []
        for o in self.observed:
            try:
                counts.append(None if o is None or self.ms is None else o.get.get("rows"))
            except Exception:  # noqa: BLE001  not every plan keeps every stage
                counts.append(None)
        pipe = [{"index": i, "op": s["op"], **({"id": s["id"]} if s.get("id") else {}), **({"label": s["label"]} if s.get("label") else {}), "rowsIn": counts[i], "rowsOut": counts[i + 1]} for i, s in enumerate(self.stages)]
        return {"executionMs": self.ms, "sourcesQueried": [self.source], **({"pipe": pipe} if pipe else {})}

    def errors(self, samples: int = 100) -> dict[str, Any]:
        """Cells that sheets made null for an error: total, by_formula, and at most `samples` of them, each with its formula, its
        row's place in order among the failed and the row's own values. Counts are one aggregate a sheet."""
        total, by_formula, some = 0, {}, []
        for names, f, flags in self.sheets:
            counts = f.df.agg(*(F.count_if(F.col(x)).alias(x) for x in flags)).first()
            for n, x in zip(names, flags, strict=True):
                total += counts[x]
                by_formula[n] = by_formula.get(n, 0) + counts[x]
                if counts[x] and len(some) < samples:
                    rows = f.with_df(f.df.filter(x)).sorted().limit(samples - len(some)).select(*(F.col(f"`{c}`") for c in f.columns)).collect()
                    some += [{"formula": n, "place": i, "row": r.asDict(recursive=True), "message": f"{n} has no value"} for i, r in enumerate(rows)]
        return {"total": total, "by_formula": by_formula, "samples": some}

    def to_json(self) -> DataFrame:
        return self.df.select(F.to_json(F.struct("*")).alias("value"))


class Engine:
    def __init__(self, context: Context, observe: bool = False):
        """observe: count rows after each stage of a pipe as it runs."""
        self.context, self.observe = context, observe

    def execute(self, doc: str | dict[str, Any], parameters: dict[str, Any] | None = None, on: DataFrame | None = None, scope: list | None = None, page: bool = False) -> Result:
        """on: rows to use instead of the source's. page: apply the default and greatest limits of a classic query."""
        q, ctx = self.bound(doc, parameters, on), self.running(scope)
        start = None if on is None else self.start(q, ctx, on)
        return self._pipe(q, ctx, start) if parse.is_pipe(q) else self._classic(q, ctx, start, page)

    def bound(self, doc: str | dict[str, Any], parameters: dict[str, Any] | None = None, on: DataFrame | None = None) -> dict[str, Any]:
        """The document, validated, with its parameters' values."""
        q = parse.load(doc)
        errors = parse.validate(q, needs_source=on is None)
        if errors:
            raise QueryError("; ".join(errors))
        return parse.bind(q, {**(q.get("parameters") or {}), **(parameters or {})})

    def running(self, scope: list | None = None) -> Context:
        """The context with a state of its own for one run."""
        return Context(**{**vars(self.context), **({"scope": scope} if scope is not None else {}), "group_keys": None, "taps": {}, "sheets": [], "skipped": None})

    def start(self, q: dict[str, Any], ctx: Context, on: DataFrame | None = None) -> Frame:
        """The rows that a pipe begins with."""
        if on is None:
            return ctx.dataset(classic.source(q), any(mentions_version(s.get("where")) for s in q.get("pipe") or []))
        return Frame(on.withColumn("__ord_read", F.monotonically_increasing_id()), (("__ord_read", True),)) if not on.isStreaming else Frame(on)

    def _pipe(self, q: dict[str, Any], ctx: Context, start: Frame | None) -> Result:
        stages, seen = q.get("pipe") or [], []
        f = start or self.start(q, ctx)
        observe = self.observe and not q.get("omit_pipe_stats") and not f.df.isStreaming

        def counted(f: Frame) -> tuple[Frame, Observation | None]:
            if not observe:
                return f, None
            o = Observation()
            return f.with_df(f.df.observe(o, F.count(F.lit(1)).alias("rows"))), o

        f, first = counted(f)
        seen.append(first)
        if observe:
            for s in stages:
                if s.get("from"):
                    observe = False  # stages that are read twice would be counted twice
            if observe:
                for i, s in enumerate(stages):
                    kept = ctx.max_stages
                    f = run_stages(f, [s], ctx) if i < kept else run_stages(f, stages, ctx)
                    f, o = counted(f)
                    seen.append(o)
            else:
                f = run_stages(f, stages, ctx)
                seen = [None] * (len(stages) + 1)
        else:
            f = run_stages(f, stages, ctx, lambda *_: seen.append(None))
        f = expand(f, q, ctx)
        made = {s["as"] for s in stages if s.get("as")} | {c["as"] for s in stages for c in (s.get("compute") or []) + (s.get("formulas") or [])}
        aggregated = {a.get("as") or a["fn"].lower() for s in stages if s["op"] == "aggregate" for a in s["aggs"]}
        return Result(f, classic.source(q), frozenset(made), frozenset(aggregated), stages=stages, observed=seen, taps=ctx.taps, sheets=ctx.sheets)

    def _classic(self, q: dict[str, Any], ctx: Context, start: Frame | None, page: bool) -> Result:
        size = None
        if page:
            size = min(DEFAULT_LIMIT if q.get("limit") is None else q["limit"], MAX_LIMIT)
            f = classic.run({**q, "limit": size + 1}, ctx, start)  # one more tells whether there is a next page
        else:
            f = classic.run(q, ctx, start)
        f = expand(f, q, ctx)
        return Result(f, classic.source(q), frozenset(c["name"] for c in q.get("computed") or []), frozenset(a.get("as") or a["fn"].lower() for a in q.get("aggregate") or []), size, q.get("offset") or 0)

    def explain(self, doc: str | dict[str, Any], **kw) -> dict[str, Any]:
        """The stages and Spark's plan; nothing runs but what a stage needs to know its columns."""
        q = parse.load(doc)
        r = self.execute(q, **kw)
        plan = r.df._jdf.queryExecution().explainString(r.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        steps = [s["op"] for s in q.get("pipe") or []] or [k for k in ("join", "computed", "where", "groupBy", "aggregate", "having", "orderBy", "limit", "select") if q.get(k)]
        return {"dataset": classic.source(q), "steps": steps, "columns": r.columns, "plan": plan, "liveSafe": all(CATALOG[s["op"]].live or s.get("pure") for s in q.get("pipe") or [])}


def expand(f: Frame, q: dict[str, Any], ctx: Context) -> Frame:
    """_meta: for each column that refers to a directory, the entry of its value, or null. Entries are unique by id; Spark
    broadcasts a directory where its size allows."""
    wanted = q.get("expand")
    if not wanted:
        return f
    source = ctx.datasets.resolve(classic.source(q), ctx.spark) if classic.source(q) else None
    refs = {**{c: "user" for c in SYSTEM_USERS}, **(source.references if source else {})}
    picked = [c for c in f.columns if c in refs and refs[c] in ctx.directories and (wanted is True or c in wanted)]
    if not picked:
        return f
    df, parts = f.df, []
    for i, c in enumerate(picked):
        d = ctx.directories[refs[c]].dropDuplicates(["id"])
        e = f"__ord_meta{i}"
        one = d.select(F.col("id").cast("string").alias(f"{e}_id"), F.struct(*d.columns).alias(e))
        df = df.join(one, F.col(f"`{c}`").cast("string") == F.col(f"{e}_id"), "left").drop(f"{e}_id")
        parts.append(F.col(e).alias(c))
    df = df.withColumn("_meta", F.struct(*parts)).drop(*(f"__ord_meta{i}" for i in range(len(picked))))
    return f.with_df(df)
