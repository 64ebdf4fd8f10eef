"""What a query may use: datasets, functions, apps, algorithms, directories and a scope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.operators.registry import QueryError
from pipeloom.plans.frame import Frame
from pipeloom.sources.datasets import VERSION_COLUMNS, Datasets


@dataclass(frozen=True)
class ScopeColumn:
    """An equality that holds for every dataset with the column. required: a dataset without it is refused."""

    name: str
    value: Any
    required: bool = False
    joins: bool = True


@dataclass
class Callable_:
    """A function or app of the host. returns: a type or schema, as DDL or a DataType. whole: takes and gives a DataFrame."""

    call: Callable
    returns: str | T.DataType | None = None
    whole: bool = False

    def kind(self) -> T.DataType:
        if self.returns is None:
            raise QueryError("a function needs its type in returns")
        if isinstance(self.returns, T.DataType):
            return self.returns
        text = self.returns.strip()
        return T._parse_datatype_string(text)

    def schema(self) -> T.StructType:
        kind = self.kind()
        if not isinstance(kind, T.StructType):
            raise QueryError("returns must be a schema here")
        return kind


@dataclass
class Context:
    spark: SparkSession
    datasets: Datasets = field(default_factory=Datasets)
    functions: dict[str, Callable_] = field(default_factory=dict)
    apps: dict[str, Callable_] = field(default_factory=dict)
    algorithms: dict[str, Callable[[DataFrame, dict], DataFrame]] = field(default_factory=lambda: dict(ALGORITHMS))
    #: Directory name -> DataFrame with `id` and further columns.
    directories: dict[str, DataFrame] = field(default_factory=dict)
    #: Columns every dataset is restricted by. An empty list restricts nothing; None refuses all queries.
    scope: list[ScopeColumn] | None = field(default_factory=list)
    #: Own reduces for sheets: name -> SQL aggregate.
    reduces: dict[str, str] = field(default_factory=dict)
    max_stages: int = 32
    #: Keys with more rows than this are spread over many tasks where a fill or an as-of join would have them in one.
    hot_rows: int = 5_000_000
    group_keys: list[str] | None = None
    #: The operator that consumes the present stage, if only the next stage does.
    following: str | None = None
    taps: dict[str, Any] = field(default_factory=dict)
    #: Right sides of joins that are kept for their cacheTtlMs: (time of expiry, persisted frame).
    lookups: dict[tuple, tuple[float, DataFrame]] = field(default_factory=dict)
    #: Sheets whose errors became nulls: the formulas, their rows, and the column that flags each formula's failed cells.
    sheets: list[tuple[list[str], Frame, list[str]]] = field(default_factory=list)
    #: What skip has left of a sorted frame, for the limit that follows.
    skipped: DataFrame | None = None

    def release(self) -> None:
        """Frees the rows kept for lookups."""
        for _, df in self.lookups.values():
            df.unpersist()
        self.lookups.clear()

    def function(self, name: str) -> Callable_:
        for n in (name, name.rsplit("::", 1)[-1]):
            if n in self.functions:
                return self.functions[n]
        raise QueryError(f"unknown function {name!r}")

    def app(self, app_id: str, method: str, capability: str) -> Callable_:
        for n in (f"{app_id}.{method}", app_id):
            if n in self.apps:
                return self.apps[n]
        raise QueryError(f"unknown app {app_id!r}")

    def algorithm(self, name: str) -> Callable[[DataFrame, dict], DataFrame]:
        if name not in self.algorithms:
            raise QueryError(f"unknown algorithm {name!r}")
        return self.algorithms[name]

    def add_reduce(self, name: str, sql: str) -> None:
        if name in ("sum", "avg", "min", "max", "count") or name in self.reduces:
            raise QueryError(f"reduce {name!r} is there already")
        self.reduces[name] = sql

    def dataset(self, name: str, all_versions: bool = False, joined: bool = False) -> Frame:
        """The dataset's rows within the scope; of a versioned one, the current rows."""
        if self.scope is None:
            raise QueryError("no scope was given")
        d = self.datasets.resolve(name, self.spark)
        df = d.load(self.spark)
        for s in self.scope:
            if s.name in df.columns and (s.joins or not joined):
                df = df.filter(F.col(s.name) == F.lit(s.value))
            elif s.required and s.name not in df.columns:
                raise QueryError(f"dataset {name!r} has no column {s.name!r}, which the scope requires")
        if d.versioned and not all_versions and "_is_current" in df.columns:
            df = df.filter(F.col("_is_current"))
        if d.key or df.isStreaming:
            return Frame(df, tuple((k, True) for k in d.key if k in df.columns))
        # without a key, order is as the files are read
        return Frame(df.withColumn("__ord_read", F.monotonically_increasing_id()), (("__ord_read", True),))

    def sub_pipe(self, frame: Frame, stages: list[dict]) -> Frame:
        from pipeloom.plans.pipe import run_stages

        kept, self.group_keys = self.group_keys, None
        try:
            return run_stages(frame, stages, self)
        finally:
            self.group_keys = kept


def mentions_version(where: Any) -> bool:
    if isinstance(where, dict):
        return where.get("field") in VERSION_COLUMNS or any(map(mentions_version, where.values())) or any(v in str(where.get("expr") or "") for v in VERSION_COLUMNS)
    return isinstance(where, list) and any(map(mentions_version, where))


def minmax_scale(df: DataFrame, params: dict) -> DataFrame:
    """columns: each is scaled to 0..1 (a constant one to 0), in place or with the suffix `as`."""
    names = params.get("columns") or ([params["field"]] if params.get("field") else [])
    suffix = params.get("as") or ""
    row = df.agg(*(f(F.col(c).cast("double")).alias(f"_{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(row))
    for c in names:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c + suffix, F.when(F.col(c).isNotNull(), F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)))
    return out.drop(*row.columns)


def robust_zscore(df: DataFrame, params: dict) -> DataFrame:
    """(x - median) / (1.4826 * median absolute deviation), under `as` or <column>_z."""
    out = df
    for c in params.get("columns") or [params["field"]]:
        mid = out.agg(F.median(c).alias("_m"))
        out = out.crossJoin(F.broadcast(mid))
        mad = out.agg(F.median(F.abs(F.col(c) - F.col("_m"))).alias("_d"))
        out = out.crossJoin(F.broadcast(mad)).withColumn(params.get("as") or f"{c}_z", F.when(F.col("_d") > 0, (F.col(c) - F.col("_m")) / (1.4826 * F.col("_d"))).otherwise(F.when(F.col(c).isNotNull(), 0.0))).drop("_m", "_d")
    return out


def kmeans(df: DataFrame, params: dict) -> DataFrame:
    """Cluster numbers under `as` (cluster) by the numeric columns given; k clusters, seed. Rows with a null or NaN in one of them
    don't count for the clusters and get null."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    names, to = params["columns"], params.get("as") or "cluster"
    complete = F.lit(True)
    for c in names:
        complete &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    marked = df.withColumn("_complete", complete)
    known = marked.where("_complete")
    if known.isEmpty():
        return df.withColumn(to, F.lit(None).cast("int"))
    filled = {f"_x{i}": F.when(F.col("_complete"), F.col(c).cast("double")).otherwise(0.0) for i, c in enumerate(names)}
    vectors = VectorAssembler(inputCols=list(filled), outputCol="_features")
    model = KMeans(k=params.get("k", 2), seed=params.get("seed", 0), featuresCol="_features", predictionCol="_cluster").fit(vectors.transform(known.withColumns(filled)))
    found = model.transform(vectors.transform(marked.withColumns(filled)))
    return found.withColumn(to, F.when(F.col("_complete"), F.col("_cluster"))).drop("_complete", "_features", "_cluster", *filled)


ALGORITHMS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"minmax_scale": minmax_scale, "robust_zscore": robust_zscore, "kmeans": kmeans}
