"""Readers for the telemetry folder layout and for the normalised tables.

Layout below a root: ``<date>/log-parquet``, ``<date>/trace-parquet`` (one file per local
hour) and ``<date>/metric-parquet/{apm/pod, infra/infra_node, infra/infra_pod,
infra/infra_tidb, other}`` (one file per pod or metric and date).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.fixed_values import (
    APM_METRICS, DB_METRICS, EXTRA_NODE_METRICS, LOCAL_ZONE, NODE_METRICS, POD_METRICS,
)
from triagelake.functions.numbers import nan_to_null
from triagelake.functions.texts import pod_of_file, service_of_metric_pod
from triagelake.functions.times import (
    iso_to_ns, local_date, local_hour_key, ns_to_local, ns_to_utc,
)
from triagelake.operators.metrics import unpivot_wide
from triagelake.operators.traces import span_fields
from triagelake.schemas import RAW_LOG, RAW_SPAN, raw_metric
from triagelake.session import cut_lineage
from triagelake.sources.catalogue import (
    DELETED, db_component, file_catalogue, files_for_windows, paths_of,
)

def _load(spark: SparkSession, schema: T.StructType, files: str | list[str]) -> DataFrame:
    """Rows of a glob or of listed files with ``source_file``; deleted files are left out."""
    with_file = T.StructType([*schema.fields, T.StructField("source_file", T.StringType())])
    if not files:
        return spark.createDataFrame([], with_file)
    raw = spark.read.schema(schema).parquet(*([files] if isinstance(files, str) else files))
    live = raw.where(~F.contains(F.col("_metadata.file_path"), F.lit(DELETED)))
    return live.withColumn("source_file", F.col("_metadata.file_name"))


def _keys(df: DataFrame, zone: str) -> DataFrame:
    ns = F.col("timestamp_ns")
    return (
        df.withColumn("time_utc", ns_to_utc(ns)).withColumn("time_local", ns_to_local(ns, zone))
        .withColumn("date", local_date(ns, zone)).withColumn("hour_key", local_hour_key(ns, zone))
    )


def normalize_logs(raw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    return _keys(raw.withColumn("timestamp_ns", iso_to_ns(F.col("`@timestamp`"))), zone)


def normalize_metrics(raw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    return _keys(raw.withColumn("timestamp_ns", iso_to_ns(F.col("time"))), zone)


def normalize_spans(raw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    return _keys(raw.withColumn("timestamp_ns", F.col("startTime") * F.lit(1000)), zone)


def _hour_glob(hours: list[str] | None) -> str:
    return "*.parquet" if not hours else "*{" + ",".join(hours) + "}*"


def read_logs(
    spark: SparkSession, root: str, hours: list[str] | None = None, files: list[str] | None = None
) -> DataFrame:
    """All log files, only those of some local hours (``YYYY-MM-DD_HH``), or listed ones."""
    where = f"{root}/*/log-parquet/{_hour_glob(hours)}" if files is None else files
    return normalize_logs(_load(spark, RAW_LOG, where)).select(
        "timestamp_ns", "time_utc", "time_local", "date", "hour_key",
        F.col("k8_node_name").alias("node_name"), F.col("k8_pod").alias("pod_name"), "message",
        "source_file",
    )


def read_spans(
    spark: SparkSession, root: str, hours: list[str] | None = None, files: list[str] | None = None
) -> DataFrame:
    """Flat spans with the name of the file they come from."""
    where = f"{root}/*/trace-parquet/{_hour_glob(hours)}" if files is None else files
    return _keys(span_fields(_load(spark, RAW_SPAN, where), ["source_file"]), LOCAL_ZONE)


def read_apm(
    spark: SparkSession, root: str, date: str = "*", files: list[str] | None = None
) -> DataFrame:
    """Per-pod service metrics, unpivoted; the pod name is part of the file name."""
    where = f"{root}/{date}/metric-parquet/apm/pod/*.parquet" if files is None else files
    raw = _load(spark, raw_metric(APM_METRICS, []), where)
    pod = pod_of_file(F.col("source_file"))
    rows = normalize_metrics(raw.withColumn("entity", pod)).withColumn(
        "service", service_of_metric_pod(F.col("entity"))
    )
    long = unpivot_wide(rows, ["timestamp_ns", "date", "entity", "service"], APM_METRICS)
    return _long(long, "apm_pod")


def _long(df: DataFrame, kind: str) -> DataFrame:
    def maybe(column):
        return F.col(column) if column in df.columns else F.lit(None).cast("string")

    return df.select(
        "timestamp_ns", "date", F.lit(kind).alias("entity_kind"), "entity",
        maybe("service").alias("service"), "metric", "value",
        maybe("instance").alias("instance"), maybe("device").alias("device"),
    )


def _read_infra(spark, files, metrics, entity_columns) -> DataFrame:
    """Files that hold one metric each, in a column of the metric's own name: a row stays a row."""
    rows = normalize_metrics(_load(spark, raw_metric(metrics, entity_columns), files))
    held = [F.when(nan_to_null(F.col(m)).isNotNull(),
                   F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))) for m in metrics]
    # generated once, so that later conditions do not repeat the long choice; code that does is
    # too long for the JVM to compile
    return rows.select(
        "timestamp_ns", "date", "source_file", *entity_columns, F.inline(F.array(F.coalesce(*held))),
    ).where(F.col("value").isNotNull())


def read_node_metrics(
    spark: SparkSession, root: str, date: str = "*", files: list[str] | None = None
) -> DataFrame:
    where = f"{root}/{date}/metric-parquet/infra/infra_node/*.parquet" if files is None else files
    rows = _read_infra(
        spark, where, [*NODE_METRICS, *EXTRA_NODE_METRICS], ["kubernetes_node", "instance"])
    return _long(rows.withColumnRenamed("kubernetes_node", "entity"), "node")


def read_pod_metrics(
    spark: SparkSession, root: str, date: str = "*", files: list[str] | None = None
) -> DataFrame:
    where = f"{root}/{date}/metric-parquet/infra/infra_pod/*.parquet" if files is None else files
    rows = _read_infra(spark, where, POD_METRICS, ["pod", "instance", "device"])
    rows = rows.withColumnRenamed("pod", "entity").withColumn(
        "service", service_of_metric_pod(F.col("entity"))
    )
    return _long(rows, "pod")


def read_db_metrics(
    spark: SparkSession, root: str, date: str = "*", files: list[str] | None = None
) -> DataFrame:
    """Database metrics; the component follows from the file name, its instances are pooled."""
    where = f"{root}/{date}/metric-parquet/{{infra/infra_tidb,other}}/*.parquet"
    metrics = sorted({m for names in DB_METRICS.values() for m in names})
    rows = _read_infra(spark, where if files is None else files, metrics, ["instance"])
    rows = rows.withColumn("entity", db_component(F.col("source_file")))
    wanted = F.lit(False)
    for name, known in DB_METRICS.items():
        wanted = wanted | ((F.col("entity") == F.lit(name)) & F.col("metric").isin(known))
    return _long(rows.where(wanted), "db_component")


FAMILIES = {"apm_pod": read_apm, "node": read_node_metrics, "pod": read_pod_metrics,
            "db_component": read_db_metrics}


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_metrics(spark: SparkSession, root: str, date: str = "*") -> DataFrame:
    """All four metric families as one long table."""
    return _union([read(spark, root, date) for read in FAMILIES.values()])


def read_in_windows(
    spark: SparkSession, root: str, windows: DataFrame, kind: str,
    metrics: list[str] | None = None,
) -> DataFrame:
    """The rows of the files that some window needs: ``log``, ``span`` or ``metric``.

    The files are chosen from the listing before any is opened, and each kind is read once.
    """
    files = cut_lineage(
        files_for_windows(file_catalogue(spark, root), windows, metrics), "files")
    if kind == "metric":
        return _union([
            read(spark, root, files=paths_of(files, family)) for family, read in FAMILIES.items()])
    read = {"log": read_logs, "span": read_spans}[kind]
    return read(spark, root, files=paths_of(files, kind))


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A normalised table; date and hour filters prune its partitions."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


#: Bytes of a file up to which a task opens it whole to find out why it gave no rows.
LONG_FILE = 1 << 30
MAGIC = b"PAR1"
NO_BYTES = "empty: no bytes"
FINDING_DDL = "path string, cause string"


def _cause(content: bytes) -> str:
    """Why a Parquet file gave no rows."""
    if content[:4] != MAGIC:
        return "broken: does not start as Parquet"
    if len(content) < 12 or content[-4:] != MAGIC:
        return "broken: cut off"
    try:
        rows = pq.ParquetFile(pa.BufferReader(content)).metadata.num_rows
    except (OSError, pa.ArrowException) as e:
        return f"broken: {type(e).__name__}"
    return "empty: no rows" if rows == 0 else "broken: rows that cannot be read"


def _causes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_cause(x.as_buffer().to_pybytes()) for x in b.column("content")]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.string())],
                                         names=["path", "cause"])


def file_report(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length, status, rows, cause) per raw file.

    The status is ``success``, ``skipped`` (a deleted file) or ``error``, and the cause of an
    error begins with ``empty`` or ``broken``. The listing reads no file content; the success
    check counts rows and skips files that cannot be read. Only files without any rows are
    opened again, one at a time per task; of files beyond 1 GB the cause says so.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    # the names of Spark's own file index; a scan leaves files without any bytes out
    names = [(re.sub(r"^(\w+):///", r"\1:/", unquote(p)),) for p in files.inputFiles()]
    listing = spark.createDataFrame(names, "path string").join(
        files.select("path", "length"), "path", "left"
    ).select("path", F.coalesce("length", F.lit(0)).alias("length"))
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    readable = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", "true").schema("_none string").parquet(root)
        .groupBy(F.url_decode(encoded).alias("path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    status = (
        F.when(F.contains("path", F.lit(DELETED)), F.lit("skipped"))
        .when(F.col("rows") > F.lit(0), F.lit("success")).otherwise(F.lit("error"))
    )
    report = cut_lineage(listing.join(readable, "path", "left").select(
        "path", "length", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows")
    ), "report")
    long = F.col("length") > F.lit(LONG_FILE)
    bad = report.where((F.col("status") == F.lit("error")) & ~long & (F.col("length") > F.lit(0)))
    # as many paths as Spark's own file index of the read will hold
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in bad.select("path").collect()]
    if paths:
        opened = spark.read.format("binaryFile").load(paths).select("path", "content")
        found = opened.mapInArrow(_causes, FINDING_DDL)
    else:
        found = spark.createDataFrame([], FINDING_DDL)
    unknown = F.when(F.col("status") == F.lit("error"), F.when(
        F.col("length") == F.lit(0), F.lit(NO_BYTES)).otherwise(F.lit("broken: too long to examine")))
    return report.join(found, "path", "left").withColumn("cause", F.coalesce("cause", unknown))


def file_report_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
