import random
import re

import numpy as np
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from triagelake.operators import detect, logs, traces
from triagelake.plans import evidence
from triagelake.schemas import RAW_SPAN

BIN = 30


def raw(span, start=1, duration=5, process=None, references=(), tags=(), service="svc"):
    tag_rows = [(k, "string", v) for k, v in tags]
    process_rows = [(k, "string", v) for k, v in (process or [("podName", "p")])]
    return (span, start, duration, "op", (service, process_rows),
            [("CHILD_OF", r, "t") for r in references], tag_rows)


def test_span_fields(spark):
    df = spark.createDataFrame([
        raw("a", 7, process=[("podName", "p1"), ("name", "p2"), ("nodeName", "n1")]),
        raw("b", 8, process=[("name", "p2"), ("node_name", "n2")], references=["a"]),
        raw("c", 9, process=[("x", "y")], references=["a", "b"]),
    ], RAW_SPAN)
    found = traces.span_fields(df)
    assert rows(found, "span_id", "parent_span_id", "timestamp_ns", "pod", "node_name") == [
        ("a", None, 7000, "p1", "n1"), ("b", "a", 8000, "p2", "n2"), ("c", None, 9000, None, None)]


def test_status_needs_both_tags_and_a_bad_code(spark):
    df = spark.createDataFrame([
        raw("ok", tags=[("status.code", "0"), ("status.message", "")]),
        raw("bad", tags=[("status.code", "0"), ("status.code", "13"), ("status.message", "it's")]),
        raw("half", tags=[("status.code", "2")]),
        raw("none", tags=[("http.method", "GET")]),
        raw("value", tags=[("http.method", "STATUS")]),
    ], RAW_SPAN)
    spans = traces.span_fields(df)
    assert rows(traces.status_tags(spans), "span_id") == [("bad",), ("half",), ("ok",), ("value",)]
    assert rows(traces.abnormal_status(spans), "span_id", "status_code", "status_message") == [
        ("bad", "13", "it's")]


def flat(spark, data):
    return spark.createDataFrame(data, "uuid string, span_id string, parent_span_id string, "
                                       "timestamp_ns long, row_id long, pod string")


def test_parent_lookup(spark):
    df = flat(spark, [
        ("u", "a", None, 1, 1, "old"), ("u", "a", None, 2, 2, "new"),
        ("u", "b", "a", 3, 3, "child"), ("u", "c", "gone", 4, 4, "child"),
        ("v", "d", "a", 5, 5, "elsewhere"), ("v", None, None, 6, 6, "x"), ("v", None, None, 7, 7, "y"),
    ])
    found = traces.call_path_spans(df, ["uuid"], ["timestamp_ns", "row_id"])
    assert found.count() == 7
    assert rows(found.where("parent_pod IS NOT NULL"), "span_id", "parent_pod", "child_pod") == [
        ("b", "new", "child")]
    wide = traces.with_parent(df, [], {"pod": "parent_pod"}, ["timestamp_ns", "row_id"])
    assert rows(wide.where("parent_pod IS NOT NULL"), "uuid", "span_id") == [("u", "b"), ("v", "d")]
    assert "NestedLoop" not in plan_of(found)


def binned(points, width):
    """Bins as a plain loop over one group."""
    first, last = min(t for t, _ in points), max(t for t, _ in points)
    out, start = [], first
    while start < last:
        inside = [v for t, v in points if start <= t <= start + width]
        if inside:
            out.append((start, pytest.approx(sum(inside) / len(inside)), len(inside)))
        start += width
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bins_equal_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    points = [(rng.randrange(0, 400), float(rng.randrange(100))) for _ in range(40)]
    points += [(min(t for t, _ in points) + 30 * k, 1.0) for k in range(5)]
    df = spark.createDataFrame([("g", t, v) for t, v in points],
                               "g string, timestamp_ns long, duration double")
    found = traces.window_mean_duration(df, ["g"], BIN).orderBy("bin_start_ns").collect()
    assert [(r["bin_start_ns"], r["mean_duration"], r["spans"]) for r in found] == binned(points, BIN)


def test_bin_borders_and_single_instants(spark):
    df = spark.createDataFrame(
        [("edge", 0, 1.0), ("edge", 30, 3.0), ("edge", 60, 5.0), ("one", 9, 4.0), ("one", 9, 6.0)],
        "g string, timestamp_ns long, duration double")
    found = traces.window_mean_duration(df, ["g"], BIN)
    assert rows(found) == [("edge", 0, 2.0, 2), ("edge", 30, 4.0, 2)]


def test_status_combinations_alias_and_top(spark):
    data = [("u", "redis", None, "op", 3), ("u", "cart", "f", "op", 5), ("u", "cart", "f", "op2", 5)]
    spans = []
    for uuid, service, parent, op, n in data:
        spans += [(uuid, "n", service, parent, "c", op, [("status.code", "s", "1"),
                                                          ("status.message", "s", "m")])] * n
    df = spark.createDataFrame(spans, "uuid string, node_name string, service_name string, "
                               "parent_pod string, child_pod string, operation string, "
                               "tags array<struct<key:string,type:string,value:string>>")
    found = traces.status_combinations(df, ["uuid"], k=2)
    assert rows(found, "rank_no", "operation", "service_name", "parent_pod", "occurrence_count") == [
        (1, "op", "cart", "f", 5), (2, "op2", "cart", "f", 5)]
    third = traces.status_combinations(df, ["uuid"]).where("rank_no = 3")
    assert rows(third, "service_name", "parent_pod") == [("redis-cart", "N/A")]


def bins_frame(spark, values, path="p"):
    return spark.createDataFrame([(path, "c", "op", float(v)) for v in values],
                                 "parent_pod string, child_pod string, operation string, "
                                 "mean_duration double")


def test_forest_flags_a_spike_and_is_seeded(spark):
    values = np.random.default_rng(1).normal(100, 5, 400)
    train = bins_frame(spark, values)
    model = detect.train_forest(train, contamination=0.05)
    again = detect.train_forest(train.repartition(3), contamination=0.05)
    assert model.collect() == again.collect()
    probe = bins_frame(spark, [100.0, 1000.0, 1.0])
    assert rows(detect.forest_events(probe, model), "mean_duration") == [(1.0,), (1000.0,)]
    share = detect.forest_events(train, model).count() / len(values)
    assert 0.01 <= share <= 0.08
    unknown = bins_frame(spark, [1000.0], path="other")
    assert detect.forest_events(unknown, model).count() == 0


def test_forest_nodes_are_a_partition_of_their_samples(spark):
    values = np.round(np.random.default_rng(7).gamma(2, 30, 90), 3)
    train = bins_frame(spark, [*values, float("nan")]).withColumn(
        "mean_duration", F.nanvl("mean_duration", F.lit(None).cast("double"))).withColumn("uuid", F.lit("u")).withColumn(
        "bin_start_ns", F.monotonically_increasing_id())
    train = train.unionByName(bins_frame(spark, [4.0, 4.0], path="flat").withColumn(
        "uuid", F.lit("u")).withColumn("bin_start_ns", F.lit(0).cast("long")))
    nodes = detect.grow_forest(train, trees=5, max_samples=32).collect()
    by_tree = {}
    for r in nodes:
        by_tree.setdefault((r.parent_pod, r.tree), {})[r.node] = r
    assert set(by_tree) == {(p, t) for p in ("p", "flat") for t in range(5)}
    for (path, _), tree in by_tree.items():
        assert tree[1].n == tree[1].samples == (32 if path == "p" else 2)
        for number, r in tree.items():
            low, high = tree.get(2 * number), tree.get(2 * number + 1)
            assert (r.threshold is None) == (low is None) == (high is None)
            assert r.depth == number.bit_length() - 1 <= 5
            if low is not None:
                assert low.n + high.n == r.n and low.n and high.n
                assert (low.low, low.high, high.low, high.high) == (
                    r.low, r.threshold, r.threshold, r.high)
    assert len({tree[1].threshold for (p, _), tree in by_tree.items() if p == "p"}) == 5


def plain_scores(nodes, values, trees):
    """Depths summed by walking each tree from its root."""
    def c(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else (
            2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)

    by_tree = {}
    for r in nodes:
        by_tree.setdefault(r.tree, {})[r.node] = r
    out = []
    for v in values:
        total = 0.0
        for tree in by_tree.values():
            r = tree[1]
            while r.threshold is not None:
                r = tree[2 * r.node + (v > r.threshold)]
            total += r.depth + c(r.n)
        out.append(round(-2 ** (-total / trees / c(min(r.samples, 256))), 9))
    return out


def test_forest_ranges_equal_a_walk_down_every_tree(spark):
    values = np.round(np.random.default_rng(3).normal(50, 9, 60), 2)
    train = bins_frame(spark, values)
    nodes = detect.grow_forest(train, trees=20)
    scores = plain_scores(nodes.collect(), values, 20)
    model = detect.forest_ranges(nodes, train, 20, 0.1)
    cutoff = model.first()["cutoff"]
    assert cutoff == pytest.approx(np.quantile(scores, 0.1), abs=2e-9)
    probes = [*values, *np.linspace(0, 120, 97)]
    want = sorted(v for v, s in zip(probes, plain_scores(nodes.collect(), probes, 20)) if s < cutoff)
    found = detect.forest_events(bins_frame(spark, probes), model)
    assert [r[0] for r in rows(found, "mean_duration")] == want and want


def test_forest_on_constant_values_flags_nothing(spark):
    train = bins_frame(spark, [5.0] * 10)
    assert detect.forest_events(train, detect.train_forest(train)).count() == 0


def test_quantile_band(spark):
    model = detect.quantile_model(bins_frame(spark, range(101)), 0.10)
    found = detect.quantile_events(bins_frame(spark, [4, 5, 50, 95, 96]), model)
    assert rows(found, "mean_duration") == [(4.0,), (96.0,)]


def test_unknown_paths_get_a_zero_baseline(spark):
    events = spark.createDataFrame([("u", "p", "c", "op", 7.0), ("u", "p", "c", "op", 9.0)],
                                   "uuid string, parent_pod string, child_pod string, "
                                   "operation string, mean_duration double")
    callers = spark.createDataFrame([("u", "p", "c", "op", "n", "s")],
                                    "uuid string, parent_pod string, child_pod string, "
                                    "operation string, node_name string, service_name string")
    stats = traces.baseline_stats(bins_frame(spark, [1.0], path="other"))
    row = detect.anomaly_combinations(events, callers, stats, ["uuid"]).first()
    assert (row["normal_avg_duration"], row["anomaly_avg_duration"], row["anomaly_count"]) == (
        0.0, 8.0, 2)


def test_trace_evidence_end_to_end(spark):
    second = 1_000_000_000
    data = []
    for i in range(200):
        slow = 100 <= i < 120
        data.append((f"p{i}", None, i * second, 2 * i, "front", "op", 1.0, "n1", "front"))
        data.append((f"c{i}", f"p{i}", i * second, 2 * i + 1, "cart", "op",
                     50.0 if slow else 1.0 + (i * i * 7 % 23) / 9, "n2", "cart"))
    spans = spark.createDataFrame(
        data, "span_id string, parent_span_id string, timestamp_ns long, row_id long, pod string, "
              "operation string, duration double, node_name string, service_name string")
    incidents = spark.createDataFrame(
        [("old", 0, 5 * second), ("new", 100 * second, 119 * second)],
        "uuid string, start_ns long, end_ns long")
    order = ["timestamp_ns", "row_id"]
    base = evidence.training_bins(spans, incidents.where("uuid = 'old'"), order,
                                  80 * second, 5 * second)
    paths = evidence.fault_call_paths(spans, incidents, order)
    found = evidence.trace_evidence(
        paths, detect.quantile_model(base, 0.1), traces.baseline_stats(base), order, 5 * second)
    new = found.where("uuid = 'new'").first()
    assert (new["service_name"], new["node_name"], new["parent_pod"], new["anomaly_count"]) == (
        "cart", "n2", "front", 4)
    assert new["anomaly_avg_duration"] == 50.0 and new["normal_avg_duration"] < 4
    forest = detect.train_forest(base, contamination=0.25)
    again = evidence.trace_evidence(paths, forest, traces.baseline_stats(base), order, 5 * second,
                                    find=detect.forest_events)
    assert again.where("uuid = 'new'").first()["anomaly_count"] == 4


def nested_spans(spark):
    hour = 3_600_000_000
    data = [raw("root", 1 * hour, process=[("podName", "front")]),
            raw("far", 1 * hour, process=[("podName", "never")])]
    data += [raw(f"s{i}", 2 * hour + i, process=[("podName", "cart")], references=["root"],
                 tags=[("status.code", str(i % 2)), ("status.message", "m" * 50)])
             for i in range(50)]
    data += [raw(f"noise{i}", hour + i, process=[("podName", "noise")]) for i in range(3000)]
    flat_spans = traces.span_fields(spark.createDataFrame(data, RAW_SPAN))
    incidents = spark.createDataFrame(
        [("u", 2 * hour * 1000, 2 * hour * 1000 + hour * 500)],
        "uuid string, start_ns long, end_ns long")
    return flat_spans.withColumn("row_id", F.monotonically_increasing_id()), incidents, hour * 1000


def test_parents_before_the_window_are_found_with_a_pad(spark, monkeypatch):
    table, incidents, hour_ns = nested_spans(spark)
    order = ["timestamp_ns", "row_id"]
    plain = evidence.fault_call_paths(table, incidents, order)
    assert plain.where("parent_pod IS NOT NULL").count() == 0
    read = {}
    joined = evidence.windows.interval_join

    def watched(facts, window, **options):
        done = joined(facts, window, **options)
        read[len(facts.columns)] = (facts.columns, done.count())
        return done

    monkeypatch.setattr(evidence.windows, "interval_join", watched)
    padded = evidence.fault_call_paths(table, incidents, order, pad_ns=hour_ns)
    assert padded.where("parent_pod = 'front'").count() == 50 == padded.count()
    columns, parents = min(read.values(), key=lambda x: len(x[0]))
    assert sorted(columns) == ["pod", "row_id", "span_id", "timestamp_ns"]
    assert 1 <= parents < 150  # of 3,000 spans in the padded hour few pass the filter
    for found in (plain, padded):
        text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", text)
        assert moved and not any("tags#" in line for line in moved)


def test_a_bloom_filter_loses_no_name(spark, monkeypatch):
    names = spark.range(0, 5000).select(F.concat(F.lit("n"), "id").alias("name"))
    wanted = names.where("name LIKE '%7'").unionByName(spark.createDataFrame([(None,)], "name string"))
    bloom = traces.bloom_words(wanted, "name")
    kept = {r.name for r in traces.maybe_named(names, "name", bloom).collect()}
    assert {f"n{i}" for i in range(7, 5000, 10)} <= kept and len(kept) < 1500
    monkeypatch.setattr(traces, "MAX_BLOOM_WORDS", 10)
    assert traces.bloom_words(wanted, "name") is None
    assert traces.maybe_named(names, "name", None).count() == 5000


def test_bins_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    data = spark.createDataFrame([("g", t, 1.0) for t in range(100)],
                                 "g string, timestamp_ns long, duration double")
    rows_ = data.mapInArrow(count, data.schema)
    assert traces.window_mean_duration(rows_, ["g"], BIN).count() == 4
    assert seen.value == 100


def test_first_in_group(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a")], "g string, t long, x string")
    assert rows(logs.first_in_group(df, ["g"], ["t"], ["x"])) == [("g", "a")]
    assert rows(df.agg(F.count("x"))) == [(2,)]
