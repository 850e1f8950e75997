import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from triagelake.operators import metrics
from triagelake.sinks import writers
from triagelake.sources import catalogue, telemetry

DAY = "2025-06-06"


def put(path, frame):
    path.parent.mkdir(parents=True, exist_ok=True)
    frame.to_parquet(path, index=False)


TAG = pa.struct([("key", pa.string()), ("type", pa.string()), ("value", pa.string())])
SPAN = pa.schema([
    ("spanID", pa.string()), ("startTime", pa.int64()), ("duration", pa.int64()),
    ("operationName", pa.string()),
    ("process", pa.struct([("serviceName", pa.string()), ("tags", pa.list_(TAG))])),
    ("references", pa.list_(pa.struct([("refType", pa.string()), ("spanID", pa.string()),
                                       ("traceID", pa.string())]))),
    ("tags", pa.list_(TAG)),
])


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "data" / DAY
    log = pd.DataFrame({
        "@timestamp": ["2025-06-05T16:30:00.123456789Z", "2025-06-05T16:10:00Z"],
        "k8_pod": ["cart-0", "cart-1"], "k8_node_name": ["n1", "n2"], "message": ["error", "x"]})
    put(base / "log-parquet" / f"log_filebeat-server_{DAY}_00-00-00.parquet", log)
    put(base / "log-parquet" / f"log_filebeat-server_{DAY}_01-00-00.parquet",
        log.assign(message="later"))
    put(base / "log-parquet" / f"deleted_{DAY}_00-00-00.parquet", log.assign(message="gone"))
    spans = pa.Table.from_pylist([{
        "spanID": "a", "startTime": 1749139802000001, "duration": 7, "operationName": "op",
        "process": {"serviceName": "cart", "tags": [
            {"key": "podName", "type": "string", "value": "cart-0"}]},
        "references": [], "tags": [{"key": "status.code", "type": "int64", "value": "0"}]}], SPAN)
    path = base / "trace-parquet" / f"trace_jaeger-span_{DAY}_00-00-00.parquet"
    path.parent.mkdir(parents=True)
    pq.write_table(spans, path)
    metric = base / "metric-parquet"
    time = ["2025-06-05T16:00:00Z", "2025-06-05T16:01:00Z"]
    put(metric / "apm" / "pod" / f"pod_cart-0_{DAY}.parquet",
        pd.DataFrame({"time": time, "rrt": [1.0, float("nan")], "request": [5.0, 6.0]}))
    put(metric / "infra" / "infra_node" / f"infra_node_node_cpu_usage_rate_{DAY}.parquet",
        pd.DataFrame({"time": time, "kubernetes_node": ["aiops-k8s-01", "master"],
                      "node_cpu_usage_rate": [0.5, 0.6]}))
    put(metric / "infra" / "infra_pod" / f"infra_pod_pod_cpu_usage_{DAY}.parquet",
        pd.DataFrame({"time": time, "pod": ["cart-0", "cart-0"], "instance": ["n1", "n1"],
                      "device": ["/dev/dmb", None], "pod_cpu_usage": [1.0, 2.0]}))
    put(metric / "infra" / "infra_tidb" / f"infra_tidb_cpu_usage_{DAY}.parquet",
        pd.DataFrame({"time": time, "instance": ["i", "j"], "cpu_usage": [1.0, 2.0]}))
    put(metric / "other" / f"infra_pd_cpu_usage_{DAY}.parquet",
        pd.DataFrame({"time": time, "instance": ["i", "j"], "cpu_usage": [3.0, 4.0]}))
    put(metric / "other" / f"infra_tikv_store_up_count_{DAY}.parquet",
        pd.DataFrame({"time": time, "instance": ["i", "j"], "store_up_count": [9.0, 9.0]}))
    return str(tmp_path / "data")


def test_logs_keep_nanoseconds_and_skip_deleted_files(spark, root):
    found = telemetry.read_logs(spark, root)
    assert found.count() == 4
    assert rows(found.where("message = 'error'"), "timestamp_ns", "date", "hour_key", "pod_name",
                "node_name") == [(1749141000123456789, DAY, f"{DAY}_00", "cart-0", "n1")]
    hour = telemetry.read_logs(spark, root, hours=[f"{DAY}_01"])
    assert rows(hour.select("message").distinct()) == [("later",)]


def test_spans_carry_their_file(spark, root):
    row = telemetry.read_spans(spark, root).first()
    assert row["timestamp_ns"] == 1749139802000001000 and row["pod"] == "cart-0"
    assert row["source_file"] == f"trace_jaeger-span_{DAY}_00-00-00.parquet"
    assert row["date"] == DAY and row["hour_key"] == f"{DAY}_00"


def test_metric_families(spark, root):
    apm = telemetry.read_apm(spark, root)
    present = apm.where("value IS NOT NULL")
    assert rows(present, "entity", "service", "metric", "value") == [
        ("cart-0", "cart", "request", 5.0), ("cart-0", "cart", "request", 6.0),
        ("cart-0", "cart", "rrt", 1.0)]
    nodes = metrics.keep_entities(telemetry.read_node_metrics(spark, root), ["aiops-k8s-01"])
    assert rows(nodes, "entity", "metric", "value") == [("aiops-k8s-01", "node_cpu_usage_rate", 0.5)]
    pods = metrics.drop_device(telemetry.read_pod_metrics(spark, root))
    assert rows(pods, "entity", "instance", "value") == [("cart-0", "n1", 2.0)]
    db = telemetry.read_db_metrics(spark, root)
    assert rows(db, "entity", "metric", "value") == [
        ("tidb-pd", "cpu_usage", 3.0), ("tidb-pd", "cpu_usage", 4.0),
        ("tidb-tidb", "cpu_usage", 1.0), ("tidb-tidb", "cpu_usage", 2.0)]
    every = telemetry.read_metrics(spark, root, DAY)
    assert rows(every.groupBy("entity_kind").count()) == [
        ("apm_pod", 14), ("db_component", 4), ("node", 2), ("pod", 2)]


def test_only_files_that_a_window_needs_are_opened(spark, root):
    found = {r.name: r for r in catalogue.file_catalogue(spark, root).collect()}
    assert len(found) == 10 and found[f"deleted_{DAY}_00-00-00.parquet"].deleted
    apm, db = found[f"pod_cart-0_{DAY}.parquet"], found[f"infra_tikv_store_up_count_{DAY}.parquet"]
    assert (apm.kind, apm.entity, apm.date, apm.metric) == ("apm_pod", "cart-0", DAY, None)
    assert (db.kind, db.entity, db.metric) == ("db_component", "tidb-tikv", "store_up_count")
    start = 1749141000123456789  # within the first local hour of the day
    span = spark.createDataFrame([("u", "fault", start - 5, start + 5), ("none", "fault", 9, 3)],
                                 "uuid string, kind string, w_start_ns long, w_end_ns long")
    logs_ = telemetry.read_in_windows(spark, root, span, "log")
    assert [f.rsplit("/", 1)[1] for f in logs_.inputFiles()] == [
        f"log_filebeat-server_{DAY}_00-00-00.parquet"]
    assert rows(logs_, "message") == [("error",), ("x",)]
    few = telemetry.read_in_windows(spark, root, span, "metric", ["node_cpu_usage_rate"])
    assert {f.rsplit("/", 1)[1] for f in few.inputFiles()} == {
        f"infra_node_node_cpu_usage_rate_{DAY}.parquet", f"pod_cart-0_{DAY}.parquet"}
    late = span.select("uuid", "kind", (F.col("w_start_ns") + 10**15).alias("w_start_ns"),
                       (F.col("w_end_ns") + 10**15).alias("w_end_ns"))
    for kind in ("log", "span", "metric"):
        nothing = telemetry.read_in_windows(spark, root, late, kind)
        assert nothing.count() == 0 and nothing.inputFiles() == []


def test_normalised_table_is_partitioned_and_pruned(spark, root, tmp_path):
    path = str(tmp_path / "logs")
    logs = telemetry.read_logs(spark, root)
    writers.write_normalised(logs, path)
    back = telemetry.read_table(spark, path, logs.schema)
    assert rows(back, "timestamp_ns", "message") == rows(logs, "timestamp_ns", "message")
    plan = back.where(F.col("hour_key") == f"{DAY}_00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(hour_key" in plan


def test_file_report(spark, root, tmp_path):
    bad = tmp_path / "data" / DAY / "log-parquet" / f"broken_{DAY}_02.parquet"
    bad.write_bytes(b"not parquet")
    folder = f"{root}/{DAY}/log-parquet"
    totals = telemetry.file_report_totals(telemetry.file_report(spark, folder))
    assert rows(totals) == [("error", 1), ("skipped", 1), ("success", 2)]


def test_evidence_lines_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 1, "c")],
                               "uuid string, line_no int, line string")
    writers.write_evidence_text(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t" / "uuid=u").glob("part-*")))
    assert text == "a\nb\n"


def test_catalogue_formats(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1), ("c", 5)], "template string, count long")
    for kind in ("csv", "json"):
        writers.write_catalogue(df, str(tmp_path / kind), kind)
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert rows(back) == [("a,b", "1"), ("c", "5")]
    assert rows(spark.read.json(str(tmp_path / "json")), "template", "count") == [("a,b", 1), ("c", 5)]


def test_the_metric_of_a_row_is_chosen_once(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2024-01-01T00:00:00.1234567Z", "n", 1.0, float("nan")),
         ("2024-01-01T00:00:01Z", "n", float("nan"), 2.0), ("2024-01-01T00:00:02Z", "n", 3.0, 4.0),
         ("2024-01-01T00:00:03Z", "n", None, None)],
        "time string, kubernetes_node string, node_cpu_usage_rate double,"
        " node_memory_usage_rate double")
    path = f"{tmp_path}/2024-01-01/metric-parquet/infra/infra_node"
    rows.write.parquet(path)
    read = telemetry.read_node_metrics(spark, str(tmp_path))
    late = read.where(F.col("timestamp_ns") > 0)
    found = {r.timestamp_ns - 1704067200 * 10**9: (r.metric, r.value) for r in late.collect()}
    first = telemetry.NODE_METRICS.index("node_cpu_usage_rate") < telemetry.NODE_METRICS.index(
        "node_memory_usage_rate")
    both = ("node_cpu_usage_rate", 3.0) if first else ("node_memory_usage_rate", 4.0)
    assert found == {123456700: ("node_cpu_usage_rate", 1.0),
                     10**9: ("node_memory_usage_rate", 2.0), 2 * 10**9: both}
    assert late._jdf.queryExecution().optimizedPlan().toString().count("isnan(node_cpu_usage") == 1
