"""Session settings this library relies on, and the one place that writes intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
SHARED = "spark.checkpoint.dir"

_open_scopes: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


@cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="triagelake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A single-process session without the setting gets a folder of its own, removed when the
    process ends. A cluster without it is an error, never a machine-local folder.
    """
    folder = spark.conf.get(SHARED, None)
    if folder is None and is_local(spark):
        folder = _own_dir()
    if folder is None:
        raise RuntimeError(f"set {SHARED} to a folder that driver and executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str = "table") -> str:
    """An unused path in the shared folder; an open ``intermediates`` scope removes it."""
    path = f"{shared_dir(spark)}/triagelake-{label}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes every intermediate table written inside, once the results are stored."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            delete_path(spark, path)


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Later branches share the written rows instead of computing them again, a lost executor
    costs no recomputation, and Spark knows the true size when it picks a join strategy.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
