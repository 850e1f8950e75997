"""A catalogue of raw telemetry files, so that only files some window needs are opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.texts import pod_of_file
from triagelake.operators.windows import used_keys

DELETED = "deleted"
DB_FILE_PREFIX = {"tidb-tidb": "infra_tidb_", "tidb-pd": "infra_pd_", "tidb-tikv": "infra_tikv_"}
#: Folder below the day, the kind of its rows, and whether it has a file per hour.
FOLDERS = [
    ("log-parquet", "log"), ("trace-parquet", "span"), ("metric-parquet/apm/pod", "apm_pod"),
    ("metric-parquet/infra/infra_node", "node"), ("metric-parquet/infra/infra_pod", "pod"),
    ("metric-parquet/infra/infra_tidb", "db_component"), ("metric-parquet/other", "db_component"),
]
HOURLY = ("log", "span")
DAY = r"(\d{4}-\d{2}-\d{2})"


def db_component(name: Column) -> Column:
    found = F.lit(None).cast("string")
    for component, prefix in DB_FILE_PREFIX.items():
        found = F.when(F.startswith(name, F.lit(prefix)), F.lit(component)).otherwise(found)
    return found


def file_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, name, kind, entity, metric, date, hour_key, deleted) of all files below.

    Everything follows from the listing; no file is opened. The kind is NULL in a folder that is
    not part of the layout, date and hour are NULL where the name does not tell them.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(root).select("path", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit(None).cast("string")
    for folder, value in FOLDERS:
        kind = F.when(F.contains("path", F.lit(f"/{folder}/")), F.lit(value)).otherwise(kind)
    day = F.regexp_extract(name, DAY, 1)
    hour = F.regexp_extract(name, DAY[:-1] + r"_\d{2})", 1)
    own = F.regexp_extract(name, r"^infra_(?:node|pod|tidb|pd|tikv)_(.*)_" + DAY, 1)
    of_metric = F.col("kind").isin("node", "pod", "db_component")
    return listing.select(
        "path", "length", name.alias("name"), kind.alias("kind"),
        F.nullif(day, F.lit("")).alias("date"), F.nullif(hour, F.lit("")).alias("hour_key"),
        F.contains("path", F.lit(DELETED)).alias("deleted"),
    ).withColumn("entity", F.when(F.col("kind") == "apm_pod", pod_of_file(F.col("name"))).when(
        F.col("kind") == "db_component", db_component(F.col("name")))
    ).withColumn("metric", F.when(of_metric, F.nullif(own, F.lit(""))))


def files_for_windows(
    catalogue: DataFrame, windows: DataFrame, metrics: list[str] | None = None,
) -> DataFrame:
    """The files that rows inside some window can come from, without deleted ones.

    Log and span files are matched by local hour, metric files by local date and, if asked, by
    metric. A file whose name tells no time is kept, since it may hold anything.
    """
    live = catalogue.where(~F.col("deleted") & F.col("kind").isNotNull())
    if metrics is not None:
        live = live.where(F.col("metric").isNull() | F.col("metric").isin(metrics))
    hourly = F.col("kind").isin(*HOURLY)
    parts = []
    for rows, key in ((live.where(hourly), "hour_key"), (live.where(~hourly), "date")):
        timed = rows.where(F.col(key).isNotNull())
        parts += [timed.join(used_keys(windows, key), key, "left_semi").select(*catalogue.columns),
                  rows.where(F.col(key).isNull()).select(*catalogue.columns)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def paths_of(files: DataFrame, kind: str) -> list[str]:
    """The paths of one kind; as many as Spark's own file index of the read will hold."""
    return sorted(r.path for r in files.where(F.col("kind") == F.lit(kind)).select("path").collect())
