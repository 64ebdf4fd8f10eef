"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without one gets a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="pipeloom-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def scratch(df: DataFrame, what: str, format: str = "parquet", **options: str) -> str:
    """Writes df to files in the shared folder, which are removed as the driver ends, and gives their path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.format(format).options(**options).save(path)
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and no executor's loss takes it away."""
    return df.sparkSession.read.schema(df.schema).parquet(scratch(df, what, compression="zstd"))


@contextmanager
def freed() -> Iterator[None]:
    """Removes at its end the tables that were written inside, so that a long session doesn't gather them. Results that read them
    must have been written or collected by then."""
    start = len(_made)
    try:
        yield
    finally:
        _clear(start)


def _clear(start: int = 0) -> None:
    while len(_made) > start:
        spark, path = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            return
