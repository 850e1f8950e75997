import random

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from triagelake.fixed_values import HOUR_NS, MINUTE_NS
from triagelake.operators import windows

H = HOUR_NS


def incident_rows(spark, spans, ords=None):
    ords = ords or range(len(spans))
    data = [(f"u{i}", o, s, e) for i, (o, (s, e)) in enumerate(zip(ords, spans))]
    return spark.createDataFrame(data, "uuid string, ord long, start_ns long, end_ns long")


def test_interval_join_equals_brute_force_on_both_paths(spark):
    rng = random.Random(5)
    facts = [(i, rng.randrange(0, 40 * H)) for i in range(400)] + [(1000, 3 * H), (1001, 5 * H)]
    spans = [(s, s + rng.randrange(0, 9 * H)) for s in (rng.randrange(0, 40 * H) for _ in range(30))]
    spans += [(3 * H, 5 * H), (9 * H, 8 * H)]
    fact_df = spark.createDataFrame(facts, "id long, timestamp_ns long")
    window_df = spark.createDataFrame(
        [(f"u{i}", "fault", s, e) for i, (s, e) in enumerate(spans)],
        "uuid string, kind string, w_start_ns long, w_end_ns long")
    want = sorted((f"u{i}", f) for i, (s, e) in enumerate(spans) for f, t in facts if s <= t <= e)
    for limit in (windows.BROADCAST_ROWS, 0):
        found = windows.interval_join(fact_df, window_df, broadcast_rows=limit)
        plan = plan_of(found)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert ("BroadcastHashJoin" in plan) == (limit > 0)
        assert sorted((r.uuid, r.id) for r in found.collect()) == want


def test_dyadic_blocks_tile_each_run_exactly(spark):
    rng = random.Random(2)
    runs = [(a, a + rng.randrange(0, 5000)) for a in (rng.randrange(-3000, 3000) for _ in range(60))]
    table = spark.createDataFrame([*runs, (5, 5), (0, 1023), (-8, -1)], "a long, b long")
    for row in table.select("a", "b", windows.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect():
        parts = sorted((x.block << x.level, (x.block + 1) << x.level) for x in row.c)
        assert parts[0][0] == row.a and parts[-1][1] == row.b + 1
        assert all(left[1] == right[0] for left, right in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (row.b - row.a + 1).bit_length()


def test_a_hot_hour_is_split_and_long_windows_cost_few_rows(spark):
    day = 24 * H
    data = [(i, 7 * H + i) for i in range(6000)] + [(10_000 + i, i * H) for i in range(-40, 800)]
    facts = spark.createDataFrame(data, "id long, timestamp_ns long").repartition(4)
    spans = [(f"s{i}", 7 * H + i, 7 * H + i + 30) for i in range(20)]
    spans += [(f"d{i}", i * day, i * day + 3 * day) for i in range(5)] + [("m", -5 * day, 25 * day)]
    window = spark.createDataFrame(
        [(u, "fault", a, b) for u, a, b in spans],
        "uuid string, kind string, w_start_ns long, w_end_ns long")
    cover = window.select(F.explode(windows.dyadic_cover(
        windows.block_of(F.col("w_start_ns"), H), windows.block_of(F.col("w_end_ns"), H))))
    assert cover.count() < 120  # one row per hour would be over a thousand
    want = sorted((u, i) for u, a, b in spans for i, t in data if a <= t <= b)
    settings = {"spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = windows.interval_join(facts, window, broadcast_rows=0, salt_rows=300)
        placed = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.uuid, r.id) for r in placed) == want
    month = [r.task for r in placed if r.uuid == "m"]
    assert max(month.count(t) for t in set(month)) < 0.3 * len(month)


def test_elementary_intervals_hold_each_instant_once(spark):
    rng = random.Random(8)
    spans = [(a, a + rng.randrange(-5, 90 * H)) for a in (rng.randrange(-9 * H, 300 * H) for _ in range(25))]
    spans += [(5, 5), (5, 5), (6, 5)]
    window = spark.createDataFrame(
        [(f"u{i}", "fault", a, b) for i, (a, b) in enumerate(spans)],
        "uuid string, kind string, w_start_ns long, w_end_ns long")
    found = windows.elementary_intervals(window).collect()
    pieces = sorted({(r.i_start_ns, r.i_end_ns) for r in found})
    assert all(left[1] < right[0] for left, right in zip(pieces, pieces[1:]))
    for i, (a, b) in enumerate(spans):
        own = sorted((r.i_start_ns, r.i_end_ns) for r in found if r.uuid == f"u{i}")
        if a > b:
            assert own == []
            continue
        assert own[0][0] == a and own[-1][1] == b
        assert all(left[1] + 1 == right[0] for left, right in zip(own, own[1:]))


def test_interval_join_without_windows_is_empty(spark):
    facts = spark.createDataFrame([(1, 5)], "id long, timestamp_ns long")
    none = spark.createDataFrame([], "uuid string, kind string, w_start_ns long, w_end_ns long")
    assert windows.interval_join(facts, none).count() == 0


def test_interval_join_pushes_bounds_and_prunes_partitions(spark, tmp_path):
    hours = spark.range(0, 96).select(
        (F.col("id") * H).alias("timestamp_ns"), F.col("id").alias("row"))
    from triagelake.functions.times import local_hour_key
    path = str(tmp_path / "facts")
    hours.withColumn("hour_key", local_hour_key(F.col("timestamp_ns"))).write.partitionBy(
        "hour_key").parquet(path)
    window = spark.createDataFrame([("u", "fault", 5 * H, 7 * H), ("v", "fault", 50 * H, 50 * H)],
                                   "uuid string, kind string, w_start_ns long, w_end_ns long")
    found = windows.interval_join(spark.read.parquet(path), window, partition_by="hour_key")
    plan = plan_of(found)
    assert f"GreaterThanOrEqual(timestamp_ns,{5 * H})" in plan
    assert "dynamicpruning" in plan
    assert rows(found, "uuid", "row") == [("u", 5), ("u", 6), ("u", 7), ("v", 50)]


def test_normal_windows_follow_list_order_across_chunks(spark):
    spans = [(i * 10 * H, i * 10 * H + H) for i in range(40)]
    spans[7], spans[21] = spans[21], spans[7]  # the list need not be in time order
    ords = [3 * i for i in range(40)]  # nor need its numbers be dense
    table = incident_rows(spark, spans, ords)
    want = set()
    for i, (start, end) in enumerate(spans):
        if i > 0:
            want.add((f"u{i}", "normal_before", spans[i - 1][1] + 10 * MINUTE_NS, start))
        if i < 39:
            want.add((f"u{i}", "normal_after", end + 10 * MINUTE_NS, spans[i + 1][0]))
    assert set(rows(windows.normal_windows(table))) == want
    small = windows.neighbours(table, chunk=8).select("uuid", "prev_end_ns", "next_start_ns")
    big = windows.neighbours(table, chunk=4096).select("uuid", "prev_end_ns", "next_start_ns")
    assert rows(small) == rows(big)


def test_single_incident_has_no_normal_window(spark):
    assert windows.normal_windows(incident_rows(spark, [(0, H)])).count() == 0


@pytest.mark.parametrize("scope, low, high", [
    ("full", 10 * H + 5, 40 * H), ("hour", 10 * H + 5, 11 * H - 1), ("day", 10 * H + 5, 16 * H - 1)])
def test_clip_to_start(spark, scope, low, high):
    table = incident_rows(spark, [(10 * H + 5, 40 * H)])
    clipped = windows.clip_to_start(windows.fault_windows(table), table, scope)
    assert rows(clipped) == [("u0", "fault", low, high)]


def test_recovery_window(spark):
    table = incident_rows(spark, [(0, 5)])
    assert rows(windows.recovery_windows(table, 7)) == [("u0", "recovery", 5, 12)]


def test_facts_have_one_key_if_the_shortest_blocks_can_be_broadcast(spark):
    hour = 3_600_000_000_000
    facts = spark.createDataFrame([(h * hour + d,) for h in range(-40, 40) for d in (0, 1)],
                                  "timestamp_ns long")
    spans = spark.createDataFrame(
        [("a", -30 * hour, 26 * hour + 1), ("b", 5, 5), ("c", hour, 0), ("d", None, hour)],
        "uuid string, w_start_ns long, w_end_ns long")
    one = windows.interval_join(facts, spans)
    assert "shiftright(_unit" not in one._jdf.queryExecution().optimizedPlan().toString()
    several = windows.interval_join(facts, spans, broadcast_rows=40)
    assert "shiftright(_unit" in several._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted((r.uuid, r.timestamp_ns) for r in df.collect())
    assert key(one) == key(several) and len(key(one)) == 114
