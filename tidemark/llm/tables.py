"""Tables between stages, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.cluster import checkpoint_root

_open: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of our own below checkpoint_root."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: what comes after starts from files, not from df's plan."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of new_folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def recorded():
    """The list of the folders that are made within."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        if _open:
            _open[-1].extend(made)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """What is written within is removed at the end; results that read from it must have been written outside by then."""
    with recorded() as made:
        try:
            yield
        finally:
            for path in made:
                drop(spark, path)
            made.clear()


def kept(df: DataFrame, name: str) -> DataFrame:
    """As written, beyond the scopes and records around."""
    around, _open[:] = list(_open), []
    try:
        return written(df, name)
    finally:
        _open[:] = around


def unused(spark: SparkSession, paths: list[str], by: DataFrame) -> list[str]:
    """Those of the folders that a table does not read from."""
    files = [f.split(":", 1)[-1].lstrip("/") for f in by.inputFiles()]
    plain = {p: p.split(":", 1)[-1].lstrip("/") + "/" for p in paths}
    return [p for p in paths if not any(f.startswith(plain[p]) for f in files)]
