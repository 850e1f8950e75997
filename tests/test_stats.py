import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagelake.operators.stats import STAT_COLUMNS, describe, describe_counts

NAMES = {"n": "count", "p25": "25%", "p50": "50%", "p75": "75%", "p95": "95%", "p99": "99%"}


def sample():
    rng = random.Random(3)
    data = [("g", round(rng.expovariate(0.1), 2)) for _ in range(700)]
    data += [("zero", 0.0)] * 300 + [("zero", 1.0)] * 3
    data += [("few", float(v)) for v in (3, 1, 2, 9)]
    data += [("five", float(v)) for v in (3, 1, 2, 9, 100)]
    data += [("gap", None), ("gap", 2.0), ("one", 7.0)]
    data += [("ties", float(i % 4)) for i in range(401)]
    return data


def expected(values, trim):
    s = pd.Series(values, dtype=float).dropna().sort_values()
    if trim and len(s) > 4:
        s = s.iloc[2:-2]
    d = s.describe(percentiles=[.25, .5, .75, .95, .99])
    d["non_zero_ratio"] = (s != 0).mean()
    return d


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("hot_rows", [None, 10_000, 200, 0])
def test_describe_equals_pandas(spark, trim, hot_rows):
    data = sample()
    df = spark.createDataFrame(data, "g string, value double").repartition(5)
    got = describe(df, ["g"], trim=F.lit(True) if trim else None, hot_rows=hot_rows)
    found = {r["g"]: r for r in got.collect()}
    for name in {g for g, _ in data}:
        want = expected([v for g, v in data if g == name], trim)
        for column in STAT_COLUMNS:
            a, b = found[name][column], want[NAMES.get(column, column)]
            if pd.isna(b):
                assert a is None
            else:
                assert a == pytest.approx(b, abs=1e-9), (name, column)


def test_empty_group_has_count_zero(spark):
    df = spark.createDataFrame([("g", None)], "g string, value double")
    row = describe(df, ["g"]).first()
    assert row["n"] == 0 and row["mean"] is None and row["p50"] is None


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_result_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(sample(), "g string, value double").repartition(partitions)
        got = describe(df, ["g"], hot_rows=300).select(
            "g", "n", *[F.round(c, 9).alias(c) for c in STAT_COLUMNS[1:]])
        assert {tuple(r) for r in got.collect()} == {
            tuple(r) for r in describe(df.coalesce(1), ["g"], hot_rows=None).select(
                "g", "n", *[F.round(c, 9).alias(c) for c in STAT_COLUMNS[1:]]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_split_groups_without_values_keep_their_row(spark):
    from triagelake.operators.stats import describe

    rows = [("none", None)] * 8 + [("one", 3.0)] + [("one", None)] * 7 + [("same", 2.0)] * 8
    table = spark.createDataFrame(rows, "k string, value double")
    small = sorted(describe(table, ["k"], hot_rows=None).collect())
    split = sorted(describe(table, ["k"], hot_rows=5).collect())
    assert small == split and [r.n for r in split] == [0, 1, 8]


@pytest.mark.parametrize("hot", [None, 5])
def test_counted_values_are_described_like_their_rows(spark, hot):
    rng = random.Random(4)
    data = [(f"g{rng.randrange(4)}", float(rng.randrange(-3, 9))) for _ in range(300)]
    data += [("tiny", 1.5), ("none", None), ("none", None), ("g0", None), ("big", 1e9), ("big", 1e9 + 1)]
    rows_ = spark.createDataFrame(data, "g string, value double")
    counts = rows_.repartition(3).withColumn("part", F.spark_partition_id()).groupBy(
        "part", "g", "value").agg(F.count(F.lit(1)).alias("count"))
    for trim in (F.lit(False), F.col("g") != "g1"):
        want = sorted(describe(rows_, ["g"], trim=trim, hot_rows=None).collect())
        got = sorted(describe_counts(counts, ["g"], trim=trim, hot_rows=hot).collect())
        assert [r.g for r in got] == [r.g for r in want]
        for a, b in zip(got, want):
            assert [x is None for x in a] == [x is None for x in b]
            assert all(x == y if isinstance(x, str) else x == pytest.approx(y, abs=1e-9)
                       for x, y in zip(a, b) if x is not None)
