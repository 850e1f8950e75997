"""Writers: partitioned telemetry, evidence text, catalogues, models, results and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake import versions
from triagelake.operators.results import RESULT_COLUMNS, upsert_results, with_defaults
from triagelake.sources.incidents import path_exists
from triagelake.sources.results import read_results


def write_normalised(
    df: DataFrame, path: str, partitions: tuple[str, ...] = ("date", "hour_key"),
    mode: str = "overwrite",
) -> None:
    """Partitioned Parquet, sorted by time inside each file.

    The rebalance hint brings the rows of a partition together; adaptive execution splits a
    partition that is too large for one task and merges small ones.
    """
    together = df.hint("rebalance", *partitions)
    together.sortWithinPartitions(*partitions, "timestamp_ns").write.mode(mode).partitionBy(
        *partitions
    ).parquet(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Models, baseline statistics, templates and merged spans are plain Parquet tables."""
    df.write.mode(mode).parquet(path)


def write_evidence_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Evidence lines ordered inside every incident, one folder per incident.

    Lines are dealt by ranges of (uuid, line_no), so a large incident becomes several files,
    which hold its lines in order when read by name.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(tasks, "uuid", "line_no").sortWithinPartitions("uuid", "line_no").select(
        "uuid", "line"
    ).write.mode(mode).partitionBy("uuid").text(path)


def write_catalogue(catalogue: DataFrame, path: str, kind: str = "csv") -> None:
    """Template catalogue, largest templates first."""
    ordered = catalogue.orderBy(F.col("count").desc(), "template")
    if kind == "csv":
        ordered.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        ordered.write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines sorted by incident with the fields in their fixed order."""
    ordered = with_defaults(results).select(*RESULT_COLUMNS).orderBy("uuid")
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upsert_result_file(fresh: DataFrame, path: str, order: str = "seq") -> None:
    """Merges fresh results into the stored ones: a fresh one wins, the rest stay.

    The merged table becomes the next version (``versions``); what is stored stays as it is, so
    readers always find a whole table, whenever a run ends. If another writer stores results
    meanwhile, the merge is done again on those. A complete table that an earlier release left
    beside the path is put in place first.
    """
    spark = fresh.sparkSession
    aside = f"{path.rstrip('/')}.next"
    whole = path_exists(spark, f"{aside}/_SUCCESS") or path_exists(spark, f"{aside}/manifest")
    if not path_exists(spark, path) and whole:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
        old.getFileSystem(conf).rename(new, old)
    columns = [*RESULT_COLUMNS, order]

    def merged() -> DataFrame:
        none = F.lit(None).cast(fresh.schema[order].dataType)
        stored = read_results(spark, path).withColumn(order, none)
        return upsert_results(stored.select(*columns), fresh.select(*columns), order)

    versions.update(spark, path, merged, write_results)


def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").parquet(path)
