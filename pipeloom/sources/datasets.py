"""Dataset names and what they stand for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

VERSION_COLUMNS = ("_version", "_is_current", "_committed_at", "_committed_by")


@dataclass(frozen=True)
class Dataset:
    name: str
    load: Callable[[SparkSession], DataFrame]
    #: Columns that order the rows; unique together, so that results don't depend on how the rows are dealt.
    key: tuple[str, ...] = ()
    #: Only rows with _is_current count unless a query speaks of versions.
    versioned: bool = False
    #: Columns that refer to a directory of users or teams: column -> directory.
    references: dict[str, str] = field(default_factory=dict)


class Datasets:
    """A registry of datasets; unknown names are looked up in Spark's catalog."""

    def __init__(self, datasets: Iterable[Dataset] = ()):
        self._by_name = {d.name: d for d in datasets}

    def add(self, dataset: Dataset) -> Datasets:
        self._by_name[dataset.name] = dataset
        return self

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def table(self, name: str, source: str | None = None, **options) -> Datasets:
        """A table or view of Spark's catalog."""
        return self.add(Dataset(name, lambda spark, n=source or name: spark.table(n), **options))

    def frame(self, name: str, df: DataFrame, **options) -> Datasets:
        return self.add(Dataset(name, lambda spark: df, **options))

    def files(self, name: str, path: str, format: str = "parquet", read: dict[str, str] | None = None, schema=None, **options) -> Datasets:
        """Files that a Spark reader opens: parquet, orc, json, csv, text or any other registered format."""

        def load(spark: SparkSession) -> DataFrame:
            reader = spark.read.format(format).options(**(read or {}))
            return (reader.schema(schema) if schema is not None else reader).load(path)

        return self.add(Dataset(name, load, **options))

    def jdbc(self, name: str, url: str, table: str, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None, **options) -> Datasets:
        """A database's table; partition: a numeric column, its bounds and the number of parallel reads."""

        def load(spark: SparkSession) -> DataFrame:
            extra = dict(zip(("column", "lowerBound", "upperBound", "numPartitions"), partition, strict=True)) if partition else {}
            return spark.read.jdbc(url, table, properties=properties or {}, **extra)

        return self.add(Dataset(name, load, **options))

    def stream(self, name: str, path: str, schema, format: str = "parquet", read: dict[str, str] | None = None, **options) -> Datasets:
        return self.add(Dataset(name, lambda spark: spark.readStream.format(format).schema(schema).options(**(read or {})).load(path), **options))

    def directory(self, path: str, keys: dict[str, tuple[str, ...]]) -> Datasets:
        """<path>/<name>.parquet for each name of keys."""
        for name, key in keys.items():
            self.files(name, f"{path}/{name}.parquet", key=key)
        return self

    def resolve(self, name: str, spark: SparkSession) -> Dataset:
        if name in self._by_name:
            return self._by_name[name]
        if spark.catalog.tableExists(name):
            return Dataset(name, lambda s: s.table(name))
        raise KeyError(f"unknown dataset {name!r}; there are {', '.join(self.names())}")
