"""Readers for incident lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.incidents import union_lists
from triagelake.schemas import INCIDENT_CSV, INCIDENT_JSON


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_incident_csv(spark: SparkSession, path: str) -> DataFrame:
    """The prepared incident table; descriptions may span lines."""
    raw = spark.read.schema(INCIDENT_CSV).csv(path, header=True, multiLine=True, escape='"')
    return raw.select(
        F.monotonically_increasing_id().alias("ord"), "uuid",
        F.col("start_timestamp").alias("start_ns"), F.col("end_timestamp").alias("end_ns"),
        "date", F.col("start_time_hour").alias("hour_key"),
        F.col("duration_seconds").alias("duration_s"),
        F.col("duration_minutes").alias("duration_min"),
        F.col("Anomaly Description").alias("description"),
    )


def read_incident_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array file; ``ord`` follows the order inside the array."""
    raw = spark.read.schema(INCIDENT_JSON).json(path, multiLine=True)
    return raw.select(
        F.monotonically_increasing_id().alias("ord"), "uuid",
        F.col("Anomaly Description").alias("description"),
    )


def read_incident_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lists in the given order; a missing file is left out, none at all is an error."""
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        raise FileNotFoundError("no incident list found")
    return union_lists(*[read_incident_json(spark, p) for p in present])
