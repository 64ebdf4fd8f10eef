"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.sources.scratch import shared_dir, written

__all__ = ["free_name", "id_field", "labelled_sample", "salts", "shared_dir", "small_batches", "table", "texts", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text (null: empty); other columns can't clash with an operator's own."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType, True)


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """Texts may be long: Arrow batches of at most this many rows keep a Python worker's memory low."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most `limit` labelled rows, those with the smallest hashes, with the identifier, the text and an integer label `y`.

    Rows whose crc32(identifier as text) is divisible by 5 are held out. Repeated labels of one identifier count once, as their maximum.
    The identifiers are broadcast: `limit` of 8 bytes each bound them.
    """
    y = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
        .where("_id is not null and y is not null").where(F.crc32(F.col("_id").cast("string")) % 5 != 0)
        .groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    d = docs.select(F.col(id_col).alias("_id"), "text")
    return d.join(F.broadcast(y), "_id").select(F.col("_id").alias(id_col), "text", "y")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many more strokes before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salts(n: int, per: int) -> int:
    """Groups of about `per` rows that n rows are dealt to."""
    return max(1, math.ceil(n / per))
