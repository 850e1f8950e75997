"""Telemetry-shaped views of the given tables, as DataFrames.

Every view is a projection or a grouping of a whole table; nothing is invented, cut or
sampled. The SQL twins are in ``workload.oracle``.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import HOUR_NS, SECOND_NS
from triagelake.functions.times import local_date, local_hour_key
from triagelake.session import configure

BIN = 3 * HOUR_NS
RECOVERY = 12 * HOUR_NS
PAD = 2 * HOUR_NS
SAMPLE_N = 50
CONTAMINATION = 0.10
NODES = [f"node-{i:02d}" for i in range(1, 8)] + ["node-99"]
PODS = [f"{t}-{i}" for t in ("click", "error", "purchase", "signup") for i in (0, 1)] + [
    "view-0", "ghost-0",
]
DB_PAIRS = [("tidb-tidb", "cpu_usage"), ("tidb-pd", "cpu_usage"), ("tidb-tikv", "cpu_usage")]
ISO = "yyyy-MM-dd'T'HH:mm:ss"
CART_FAILURE = (
    ' "error":"could not retrieve cart: rpc error: code = Unavailable desc = timed out",'
    '"http.req.id":"r1","http.req.method":"GET","http.req.path":"/cart"'
)
DEADLINE = " code = DeadlineExceeded desc = context deadline exceeded from 10.233.1.2:7070"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", ts.alias("ts"), (F.unix_micros(ts) * F.lit(1000)).alias("ts_ns"),
        "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per day, from the first error of the day on; some run into the next."""
    first = F.min(F.when(F.col("event_type") == "error", F.col("ts_ns")))
    start = F.expr(f"(_first div {SECOND_NS}) * {SECOND_NS}")
    hours = F.lit(12) + F.when(F.col("ord") % 7 == 3, F.lit(14)).otherwise(F.lit(0))
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    found = events(spark, sf_dir).groupBy(day.alias("ord")).agg(first.alias("_first"))
    return (
        found.where(F.col("_first").isNotNull())
        .withColumn("start_ns", start)
        .withColumn("end_ns", F.col("start_ns") + hours.cast("long") * F.lit(HOUR_NS))
        .select(
            "ord", F.concat(F.lit("inc-"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias(
                "uuid"), "start_ns", "end_ns", local_date(F.col("start_ns")).alias("date"),
            local_hour_key(F.col("start_ns")).alias("hour_key"),
        )
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-text report per event, with one, two or three instants."""
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("k") + F.lit(1)).cast("long") * F.lit(60_000_000))
    t1 = F.concat(F.date_format("ts", ISO), F.lit("Z"))
    t2 = F.concat(F.date_format(end, ISO), F.lit("Z"))
    kind = F.col("k") % 10
    text = (
        F.when(kind == 0, F.concat(F.lit("An anomaly began at "), t1, F.lit(".")))
        .when(kind == 1, F.concat(F.lit("From "), t1, F.lit(" to "), t2, F.lit(", not "), t1))
        .otherwise(F.concat(F.lit("The system was abnormal from "), t1, F.lit(" to "), t2,
                            F.lit(". Please find the cause.")))
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("rep-"), F.col("event_id").cast("string")).alias("uuid"),
        text.alias("description"), "event_type",
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven measurements per event in the long metric form; some are missing."""
    value = F.when(F.col("k") != 97, F.col("value"))
    level = F.col("k").cast("double")
    pod = F.concat("event_type", F.lit("-"), (F.col("user_id") % 2).cast("string"))
    node = F.concat(F.lit("node-0"), (F.col("user_id") % 8 + 1).cast("string"))
    part = F.element_at(
        F.array(*[F.lit(n) for n in ("tidb-tidb", "tidb-pd", "tidb-tikv")]),
        (F.col("user_id") % 3 + 1).cast("int"),
    )
    device = F.when(F.col("k") % 5 == 0, F.lit("/dev/dmb")).when(
        F.col("k") % 5 > 1, F.lit("/dev/vda"))
    none = F.lit(None).cast("string")

    def row(kind, entity, service, metric, number, instance=none, dev=none):
        return F.struct(
            F.lit(kind).alias("entity_kind"), entity.alias("entity"), service.alias("service"),
            F.lit(metric).alias("metric"), number.alias("value"),
            instance.alias("instance"), dev.alias("device"),
        )

    kind = F.col("event_type")
    rows = F.array(
        row("apm_pod", pod, kind, "rrt", value), row("apm_pod", pod, kind, "request", level),
        row("pod", pod, kind, "pod_cpu_usage", value, node, device),
        row("pod", pod, kind, "pod_processes", level, node, device),
        row("node", node, none, "node_cpu_usage_rate", value),
        row("node", node, none, "node_memory_usage_rate", level),
        row("db_component", part, none, "cpu_usage", value),
    )
    return events(spark, sf_dir).select(
        F.col("ts_ns").alias("timestamp_ns"), local_date(F.col("ts_ns")).alias("date"),
        F.explode(rows).alias("m"),
    ).select("timestamp_ns", "date", "m.*")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event; some name the fault injector, some have no text."""
    text = F.concat(
        F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="),
        F.col("value").cast("string"), F.lit(" k="), F.col("k").cast("string"),
        F.when(F.col("k") % 10 == 3, F.lit(" java.lang.Error Injected")).when(
            F.col("k") % 10 == 4, F.lit(" Error, code")).when(
            F.col("k") % 10 == 5, F.lit(CART_FAILURE)).when(
            F.col("k") % 10 == 6, F.lit(DEADLINE)).otherwise(F.lit("")),
    )
    return events(spark, sf_dir).select(
        F.col("ts_ns").alias("timestamp_ns"), F.col("event_id").alias("row_id"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 2).cast("string")).alias("pod_name"),
        F.concat(F.lit("node-0"), (F.col("user_id") % 8 + 1).cast("string")).alias("node_name"),
        F.when(F.col("k") != 97, text).alias("message"),
        local_hour_key(F.col("ts_ns")).alias("hour_key"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(F.split("text", "\n")).alias("line_no", "message")
    return table(spark, sf_dir, "documents").select("doc_id", lines)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents and all log lines."""
    docs = document_lines(spark, sf_dir).select(
        F.col("doc_id").alias("a"), F.col("line_no").cast("long").alias("b"), "message"
    )
    own = logs(spark, sf_dir).select(
        F.lit(-1).cast("long").alias("a"), F.col("row_id").alias("b"), "message"
    )
    return docs.unionByName(own)


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested spans; the parent is an earlier event at a distance set by the user."""
    names = F.array(*[F.lit(n) for n in ("frontend", "cart", "redis")])
    service = F.element_at(names, (F.col("user_id") % 3 + 1).cast("int"))
    pod = F.concat(service, F.lit("-0"))
    node = F.concat(F.lit("node-0"), (F.col("user_id") % 8 + 1).cast("string"))

    def tag(key, value):
        return F.struct(
            F.lit(key).alias("key"), F.lit("string").alias("type"), value.alias("value")
        )

    even = F.col("event_id") % 2 == 0
    process_tags = F.when(even, F.array(tag("podName", pod), tag("nodeName", node))).otherwise(
        F.array(tag("name", pod), tag("node_name", node)))
    parent = (F.col("event_id") - F.lit(1) - F.col("user_id") % 7).cast("string")
    reference = F.struct(F.lit("CHILD_OF").alias("refType"), F.concat(
        F.lit("s"), parent).alias("spanID"), F.lit("t").alias("traceID"))
    nothing = F.array().cast("array<struct<refType:string,spanID:string,traceID:string>>")
    references = (
        F.when(F.col("event_id") % 10 == 0, nothing)
        .when(F.col("event_id") % 11 == 0, F.array(reference, reference))
        .otherwise(F.array(reference))
    )
    code = tag("status.code", (F.col("k") % 3).cast("string"))
    text = tag("status.message", F.col("event_type"))
    method = tag("http.method", F.lit("GET"))
    tags = F.when(F.col("event_id") % 13 == 0, F.array(text, method)).otherwise(
        F.array(method, code, text))
    return events(spark, sf_dir).select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("spanID"),
        F.unix_micros("ts").alias("startTime"), F.col("value").alias("duration"),
        F.concat(F.lit("op"), (F.col("event_id") % 2).cast("string")).alias("operationName"),
        F.struct(service.alias("serviceName"), process_tags.alias("tags")).alias("process"),
        references.alias("references"), tags.alias("tags"),
        F.col("event_id").alias("row_id"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-text reply per event: prose around JSON, sometimes broken or absent."""
    component = F.element_at(
        F.array(*[F.lit(n) for n in (
            "cartservice", "frontend-1", "aiops-k8s-03", "redis-cart", "no-such-part")]),
        (F.col("user_id") % 5 + 1).cast("int"),
    )
    reason = F.when(F.col("k") % 9 == 0, F.lit("")).otherwise(
        F.concat(F.lit("high "), F.col("event_type")))
    body = F.concat(
        F.lit('{"component": "'), component, F.lit('", "reason": "'), reason,
        F.lit('", "reasoning_trace": [{"step": 1, "action": "look", "observation": "k='),
        F.col("k").cast("string"), F.lit('"}]}'),
    )
    text = (
        F.when(F.col("k") % 7 == 0, F.lit("No answer."))
        .when(F.col("k") % 5 == 0, F.lit('Broken {"component": "x", '))
        .when(F.col("k") % 8 == 1, F.concat(F.lit('Short:\n{"component":\n"'), component,
                                            F.lit('"}\nend')))
        .otherwise(F.concat(F.lit("Answer:\n"), body, F.lit("\nDone.")))
    )
    return events(spark, sf_dir).select(
        F.concat(F.lit("rep-"), F.expr("event_id div 3").cast("string")).alias("uuid"),
        F.col("event_id").alias("seq"), text.alias("reply"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("uuid"), F.col("turn"),
        F.col("role").alias("call_type"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("prompt"),
        F.col("text").alias("response"),
    )


def write_raw_layout(rows: DataFrame, root: str, staged: str | None = None) -> None:
    """Rows with ``folder`` and ``file`` as raw files ``<root>/<folder>/<file>``, one each."""
    spark = rows.sparkSession
    place = F.concat_ws("|", "folder", "file")
    staged = staged or f"{root}.staged"
    rows.withColumn("_at", place).drop("folder", "file").repartition("_at").write.partitionBy(
        "_at").parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(conf)
    for folder in system.listStatus(path(staged)):
        name = unquote(folder.getPath().getName())
        if not name.startswith("_at="):
            continue
        target, file = name.removeprefix("_at=").split("|")
        system.mkdirs(path(f"{root}/{target}"))
        part = next(x.getPath() for x in system.listStatus(folder.getPath())
                    if x.getPath().getName().endswith(".parquet"))
        system.rename(part, path(f"{root}/{target}/{file}"))


def _placed(rows: DataFrame, ns: str, folder: str, prefix: str) -> DataFrame:
    """One file per local hour; at noon some rows also lie in a deleted file."""
    hour = local_hour_key(F.col(ns))
    file = F.concat(F.lit(prefix), hour, F.lit("-00-00.parquet"))
    placed = rows.withColumn("folder", F.concat(local_date(F.col(ns)), F.lit(f"/{folder}")))
    gone = placed.where(F.endswith(hour, F.lit("_12"))).withColumn(
        "file", F.concat(F.lit("deleted_"), hour, F.lit("-00-00.parquet")))
    return placed.withColumn("file", file).unionByName(gone).drop(ns)


def iso_micros(ns: str):
    instant = F.timestamp_micros(F.expr(f"{ns} div 1000"))
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def write_raw_logs(spark: SparkSession, sf_dir: str, root: str) -> None:
    rows = logs(spark, sf_dir).select(
        "timestamp_ns", iso_micros("timestamp_ns").alias("@timestamp"),
        F.col("pod_name").alias("k8_pod"), F.col("node_name").alias("k8_node_name"), "message")
    write_raw_layout(_placed(rows, "timestamp_ns", "log-parquet", "log_filebeat-server_"), root)


def write_raw_spans(spark: SparkSession, sf_dir: str, root: str) -> None:
    rows = raw_spans(spark, sf_dir).drop("row_id").withColumns({
        "ns": F.col("startTime") * F.lit(1000), "duration": F.floor("duration")})
    write_raw_layout(_placed(rows, "ns", "trace-parquet", "trace_jaeger-span_"), root)


def write_raw_metrics(spark: SparkSession, sf_dir: str, root: str) -> None:
    """APM rows wide by pod, the other families one metric a file."""
    rows = metrics(spark, sf_dir).withColumn("time", iso_micros("timestamp_ns"))
    end = F.concat(F.lit("_"), F.col("date"), F.lit(".parquet"))

    # dealt by entity and time, which serves the numbering and the grouping
    apm = rows.where("entity_kind = 'apm_pod'").repartition("entity", "time")
    number = Window.partitionBy("entity", "metric", "time").orderBy(F.col("value").asc_nulls_last())
    wide = apm.withColumn("nr", F.row_number().over(number)).groupBy(
        "date", "entity", "time", "nr").agg(*[
            F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("rrt", "request")])
    parts = [(wide, "apm/pod", F.concat(F.lit("pod_"), "entity"), ["time", "rrt", "request"])]
    for kind, folder, names, entity in (
        ("node", "infra/infra_node", ("node_cpu_usage_rate", "node_memory_usage_rate"),
         [F.col("entity").alias("kubernetes_node")]),
        ("pod", "infra/infra_pod", ("pod_cpu_usage", "pod_processes"),
         [F.col("entity").alias("pod"), "instance", "device"]),
    ):
        for metric in names:
            part = rows.where((F.col("entity_kind") == kind) & (F.col("metric") == metric))
            parts.append((part, folder, F.lit(f"infra_{kind}_{metric}"),
                          ["time", *entity, F.col("value").alias(metric)]))
    for component, folder in (("tidb", "infra/infra_tidb"), ("pd", "other"), ("tikv", "other")):
        part = rows.where((F.col("entity_kind") == "db_component")
                          & (F.col("entity") == f"tidb-{component}"))
        parts.append((part, folder, F.lit(f"infra_{component}_cpu_usage"),
                      ["time", "instance", F.col("value").alias("cpu_usage")]))
    for i, (part, folder, name, columns) in enumerate(parts):
        placed = part.select(
            *columns, F.concat(F.col("date"), F.lit(f"/metric-parquet/{folder}")).alias("folder"),
            F.concat(name, end).alias("file"))
        write_raw_layout(placed, root, f"{root}.staged-{i}")
