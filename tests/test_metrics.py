import json

from conftest import rows

from triagelake.functions.numbers import round_even
from triagelake.operators import metrics
from triagelake.plans.evidence import metric_evidence, metric_report_json
from triagelake.session import cut_lineage
from pyspark.sql import functions as F

LONG = ("timestamp_ns long, date string, entity_kind string, entity string, service string, "
        "metric string, value double, instance string, device string")


def long_rows(spark, kind, entity, metric, normal, fault, device=None, instance=None):
    data = [(t, "d", kind, entity, None, metric, None if v is None else float(v), instance, device)
            for t, v in [(100 + i, v) for i, v in enumerate(normal)]
            + [(1001 + i, v) for i, v in enumerate(fault)]]
    return spark.createDataFrame(data, LONG)


def both_windows(spark, uuid="u"):
    return spark.createDataFrame(
        [(uuid, "normal_before", 0, 999), (uuid, "fault", 1000, 1999)],
        "uuid string, kind string, w_start_ns long, w_end_ns long")


def one_incident(spark):
    return spark.createDataFrame([("u", "d")], "uuid string, date string")


def test_rounding_is_half_even_on_the_scaled_value(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (0.125,), (0.375,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(round_even(F.col("x"), 2)).collect()] == [
        1.0, 2.68, 0.12, 0.38, -1.5]


def test_only_normal_is_trimmed_and_overlaps_count_twice(spark):
    table = long_rows(spark, "pod", "p", "m", [0, 1, 5, 6, 7, 100, 200], [1, 2, 3, 4, 50])
    stats = metrics.fault_vs_normal(table, both_windows(spark), ["entity", "metric"]).first()
    assert (stats["normal_n"], stats["normal_min"], stats["normal_max"]) == (3, 5.0, 7.0)
    assert (stats["fault_n"], stats["fault_max"]) == (5, 50.0)
    twice = both_windows(spark).union(both_windows(spark).where("kind = 'normal_before'"))
    again = metrics.fault_vs_normal(table, twice, ["entity", "metric"]).first()
    assert again["normal_n"] == 10


def test_stable_metrics_leave_the_report_and_unknown_ratios_stay(spark):
    entity = ["entity", "metric"]
    table = long_rows(spark, "pod", "a", "m", [100.0] * 4, [104.9] * 4).unionByName(
        long_rows(spark, "pod", "b", "m", [100.0] * 4, [105.3] * 4)).unionByName(
        long_rows(spark, "pod", "c", "m", [], [1.0])).unionByName(
        long_rows(spark, "pod", "d", "m", [None], [None]))
    paired = metrics.fault_vs_normal(table, both_windows(spark), entity, keep_empty=True)
    plain = metrics.report_rows(paired, entity)
    assert rows(plain, "entity", "status", "normal_p50", "fault_p50") == [
        ("b", "ok", 100.0, 105.3), ("d", "ok", None, None)]
    counted = metrics.fault_vs_normal(table, both_windows(spark), entity)
    grid = metrics.presence_grid(table, one_incident(spark), entity)
    marked = metrics.report_rows(counted, entity, grid)
    assert rows(marked, "entity", "status") == [("b", "ok"), ("c", "missing"), ("d", "missing")]


def test_device_filter_keeps_rows_without_device(spark):
    df = spark.createDataFrame(
        [("/dev/dmb", 1), ("/dev/vda", 2), (None, 3)], "device string, id int")
    assert rows(metrics.drop_device(df), "id") == [(2,), (3,)]
    assert metrics.drop_device(df.drop("device")).count() == 3


def test_unpivot_keeps_present_columns_and_nulls_nan(spark):
    wide = spark.createDataFrame([(1, "p", 2.0, float("nan"))],
                                 "timestamp_ns long, entity string, rrt double, request double")
    assert rows(metrics.unpivot_wide(wide, ["entity"]), "metric", "value") == [
        ("request", None), ("rrt", 2.0)]


def test_node_pod_map_prefers_cpu_and_completes_nodes(spark):
    data = [("d1", "pod_cpu_usage", "n1", "a"), ("d1", "pod_processes", "n1", "b"),
            ("d2", "pod_processes", "n2", "c"), ("d2", "pod_fs_reads_bytes", "n2", "e")]
    df = spark.createDataFrame(data, "date string, metric string, instance string, entity string")
    assert rows(metrics.node_pod_map(df, ["n1", "n2"])) == [
        ("d1", "n1", "a"), ("d1", "n2", None), ("d2", "n1", None), ("d2", "n2", "e")]


def test_labels_and_coverage(spark):
    df = spark.createDataFrame([("u", "node_cpu_usage_rate"), ("u", "other"), ("u", "other")],
                               "uuid string, metric string")
    assert rows(metrics.metric_coverage(df)) == [
        ("u", 2, "node_cpu_usage_rate,other", "CPU使用率,other")]


def test_metric_evidence_and_nested_json(spark):
    parts = [
        long_rows(spark, "apm_pod", "cart-0", "rrt", [1.0] * 5, [9.0] * 5).withColumn(
            "service", F.lit("cart")),
        long_rows(spark, "node", "n1", "cpu", [1.0] * 5, [3.0] * 5),
        long_rows(spark, "pod", "cart-0", "pod_cpu_usage", [1.0] * 5, [2.0] * 5, instance="n1"),
        long_rows(spark, "pod", "quiet-0", "pod_cpu_usage", [1.0] * 5, [1.0] * 5, instance="n1"),
        long_rows(spark, "db_component", "tidb-pd", "cpu_usage", [], [2.0] * 5),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    incidents = spark.createDataFrame(
        [(0, "p", -1000, -700, "d"), (1, "u", 1000, 1999, "d")],
        "ord long, uuid string, start_ns long, end_ns long, date string")
    found = metric_evidence(table, incidents, ["n1", "n2"], ["cart-0", "quiet-0"],
                            [("tidb-pd", "cpu_usage")], margin_ns=0).where("uuid = 'u'")
    assert rows(found, "section", "service", "node", "entity", "metric", "status") == [
        ("db_component", "", "", "tidb-pd", "cpu_usage", "missing"),
        ("microservice", "cart", "", "cart-0", "rrt", "ok"),
        ("node", "", "n1", "", "cpu", "ok"),
        ("pod", "", "n1", "cart-0", "pod_cpu_usage", "ok"),
        ("pod", "", "n1", "quiet-0", "", "empty"),
    ]
    service = found.where("section = 'microservice'")
    report = json.loads(metric_report_json(service, ["service", "entity"]).first()["report"])
    assert report["cart"]["cart-0"]["rrt"]["故障期间中位数"] == 9.0
    missing = found.where("section = 'db_component'")
    report = json.loads(metric_report_json(missing, ["entity"]).first()["report"])
    assert report == {"tidb-pd": {"cpu_usage": "缺失数据"}}


def test_totals(spark):
    pods = spark.createDataFrame([("u", "s", "s-0"), ("u", "s", "s-1"), ("u", "t", "t-0")],
                                 "uuid string, service string, entity string")
    rolled = metrics.service_rollup(pods)
    assert rows(rolled) == [("u", "s", 2, "s-0,s-1"), ("u", "t", 1, "t-0")]
    db = spark.createDataFrame([("u", "tidb-pd")], "uuid string, entity string")
    assert rows(metrics.system_totals(rolled, db)) == [("u", 2, 3, 1)]


def test_overlapping_windows_write_no_fact_twice(spark, monkeypatch):
    data = [(t, "d", "pod", f"p{t % 3}", None, "m", float(t % 5), None, None) for t in range(3000)]
    table = spark.createDataFrame(data, LONG)
    windows = spark.createDataFrame(
        [(f"u{i}", "normal_before" if i % 2 else "fault", 10 * i, 2000 + 10 * i) for i in range(40)],
        "uuid string, kind string, w_start_ns long, w_end_ns long")
    written = {}

    def cut(df, label="table"):
        done = cut_lineage(df, label)
        written[label] = done.count()
        return done

    monkeypatch.setattr(metrics, "cut_lineage", cut)
    stats = metrics.describe_in_windows(table, windows, ["entity"]).collect()
    # 15 kinds of rows (entity and value) in fewer than 80 intervals, whatever the overlap
    assert written["counts"] <= 15 * 80 < len(data)
    for r in stats:
        i = int(r.uuid[1:])
        values = sorted(t % 5 for t in range(10 * i, min(3000, 2001 + 10 * i)) if r.entity == f"p{t % 3}")
        values = values[2:-2] if i % 2 else values
        assert (r.n, r.min, r.max) == (len(values), values[0], values[-1])
        assert abs(r["mean"] - sum(values) / len(values)) < 1e-9
    assert len(stats) == 120
