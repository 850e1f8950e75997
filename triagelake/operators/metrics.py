"""Metric statistics inside and outside the fault, per entity and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.fixed_values import (
    APM_METRICS, METRIC_LABELS, REPORT_LABELS, SKIPPED_DEVICE, STABLE_RATIO, TRIM_EACH_SIDE,
)
from triagelake.functions.numbers import nan_to_null, round_even, symmetric_ratio
from triagelake.operators.stats import HOT_GROUP_ROWS, STAT_COLUMNS, describe_counts
from triagelake.operators.windows import elementary_intervals, interval_join
from triagelake.session import cut_lineage

SIDES = ("normal", "fault")


def unpivot_wide(wide: DataFrame, ids: list[str], metrics: list[str] | None = None) -> DataFrame:
    """One row per metric column that the table has; missing measurements become NULL."""
    wanted = APM_METRICS if metrics is None else metrics
    present = [c for c in wanted if c in wide.columns]
    long = wide.unpivot(ids, present, "metric", "value")
    return long.withColumn("value", nan_to_null(F.col("value")))


def keep_entities(metrics: DataFrame, names: list[str], column: str = "entity") -> DataFrame:
    """Only the listed entities; a list filter, so it reaches the Parquet scan."""
    return metrics.where(F.col(column).isin(names))


def drop_device(metrics: DataFrame, device: str = SKIPPED_DEVICE) -> DataFrame:
    """Drops the rows of one device; rows without a device stay."""
    if "device" not in metrics.columns:
        return metrics
    return metrics.where(~F.col("device").eqNullSafe(F.lit(device)))


def describe_in_windows(
    metrics: DataFrame,
    windows: DataFrame,
    entity: list[str],
    hot_rows: int | None = HOT_GROUP_ROWS,
    side: int = TRIM_EACH_SIDE,
    keep_empty: bool = False,
    **join_options,
) -> DataFrame:
    """Statistics per incident, entity and side; both normal windows are pooled and trimmed.

    A sweep over all window borders cuts the time line into intervals. Every measurement lies in
    one of them at most, and equal values are counted per interval: these counts are all that is
    shuffled and written, however many windows overlap. An incident adds up the intervals of its
    windows, and exact ranks come from the added counts. The metric table is scanned once.
    """
    cover = cut_lineage(elementary_intervals(windows), "cover")
    intervals = cover.select(
        F.col("i_start_ns").alias("w_start_ns"), F.col("i_end_ns").alias("w_end_ns")).distinct()
    inside = interval_join(metrics, intervals, **join_options)
    counts = cut_lineage(inside.groupBy(
        F.col("w_start_ns").alias("i_start_ns"), *entity, "value"
    ).agg(F.count(F.lit(1)).alias("count")), "counts")
    if hot_rows is not None and counts.count() <= hot_rows:
        hot_rows = None  # no group can have more values than the table
    normal = F.startswith(F.col("kind"), F.lit("normal"))
    side_of = F.when(normal, F.lit("normal")).otherwise(F.lit("fault"))
    added = counts.join(cover.select("uuid", side_of.alias("kind"), "i_start_ns"), "i_start_ns")
    stats = describe_counts(
        added, ["uuid", *entity, "kind"], trim=F.col("kind") == F.lit("normal"), side=side,
        hot_rows=hot_rows,
    )
    return stats if keep_empty else stats.where(F.col("n") > F.lit(0))


def pair_sides(stats: DataFrame, entity: list[str]) -> DataFrame:
    """Normal and fault statistics side by side; a full outer pairing without a join."""
    columns = [
        F.max(F.when(F.col("kind") == F.lit(side), F.col(c))).alias(f"{side}_{c}")
        for side in SIDES for c in STAT_COLUMNS
    ]
    return stats.groupBy("uuid", *entity).agg(*columns)


def fault_vs_normal(metrics, windows, entity: list[str], **options) -> DataFrame:
    return pair_sides(describe_in_windows(metrics, windows, entity, **options), entity)


def with_deviation(paired: DataFrame) -> DataFrame:
    """Interquartile ranges and symmetric ratios of median and 99th percentile."""
    def gap(side):
        return F.col(f"{side}_p75") - F.col(f"{side}_p25")

    return (
        paired.withColumn("normal_iqr", gap("normal")).withColumn("fault_iqr", gap("fault"))
        .withColumn("p50_ratio", symmetric_ratio(F.col("fault_p50"), F.col("normal_p50")))
        .withColumn("p99_ratio", symmetric_ratio(F.col("fault_p99"), F.col("normal_p99")))
    )


def is_stable(threshold: float = STABLE_RATIO) -> Column:
    """Both ratios below the threshold; an unknown ratio does not count as stable."""
    low = (F.col("p50_ratio") < F.lit(threshold)) & (F.col("p99_ratio") < F.lit(threshold))
    return F.coalesce(low, F.lit(False))


def presence_grid(metrics: DataFrame, incidents: DataFrame, entity: list[str]) -> DataFrame:
    """Which entity and metric have any row on the start date of each incident."""
    days = metrics.select("date", *entity).distinct()
    return days.join(incidents.select("uuid", "date"), "date").select("uuid", *entity)


def _shown(value: Column) -> Column:
    """Two decimals; noise below six decimals must not decide how a tie is rounded."""
    return round_even(round_even(value, 6), 2)


def report_rows(
    paired: DataFrame,
    entity: list[str],
    grid: DataFrame | None = None,
    threshold: float = STABLE_RATIO,
) -> DataFrame:
    """The six reported numbers of every metric that moved.

    Without a grid, metrics that lack a side are left out. With a grid, every combination
    in it appears, marked ``missing`` when a side is absent.
    """
    rows = paired if grid is None else grid.join(paired, ["uuid", *entity], "left")
    rows = with_deviation(rows)
    both = F.col("normal_n").isNotNull() & F.col("fault_n").isNotNull()
    rows = rows.where(~(both & is_stable(threshold)))
    if grid is None:
        rows = rows.where(both)
    numbers = [F.when(both, _shown(F.col(c))).alias(c) for c in REPORT_LABELS]
    status = F.when(both, F.lit("ok")).otherwise(F.lit("missing")).alias("status")
    return rows.select("uuid", *entity, status, *numbers)


def node_pod_map(
    pod_metrics: DataFrame, nodes: list[str], preferred: str = "pod_cpu_usage"
) -> DataFrame:
    """Pods seen on each node per date, from one metric of that date; NULL where none was."""
    places = pod_metrics.select("date", "metric", "instance", "entity").distinct()
    choice = F.min(F.struct((F.col("metric") != F.lit(preferred)).alias("other"), "metric"))
    chosen = places.groupBy("date").agg(choice.alias("_c")).select("date", "_c.metric")
    seen = (
        places.join(chosen, ["date", "metric"])
        .select("date", F.col("instance").alias("node"), F.col("entity").alias("pod"))
    )
    names = F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node")
    return chosen.select("date", names).join(seen, ["date", "node"], "left")


def node_pod_rows(
    node_rows: DataFrame, pod_rows: DataFrame, placement: DataFrame, incidents: DataFrame
) -> DataFrame:
    """Node metrics and, below each node, the metrics of its pods; a pod without any stays."""
    own = node_rows.select(
        "uuid", F.col("entity").alias("node"), F.lit(None).cast("string").alias("pod"),
        "metric", "status", *REPORT_LABELS,
    )
    hosts = (
        placement.where(F.col("pod").isNotNull())
        .join(incidents.select("uuid", "date"), "date").select("uuid", "node", "pod")
    )
    pods = pod_rows.withColumnRenamed("entity", "pod")
    below = hosts.join(pods, ["uuid", "pod"], "left").select(
        "uuid", "node", "pod", "metric",
        F.coalesce("status", F.lit("empty")).alias("status"), *REPORT_LABELS,
    )
    return own.unionByName(below)


def service_rollup(paired: DataFrame) -> DataFrame:
    """Pods per service and incident."""
    return (
        paired.select("uuid", "service", F.col("entity").alias("pod")).distinct()
        .groupBy("uuid", "service").agg(
            F.count("pod").alias("pod_count"),
            F.array_join(F.array_sort(F.collect_list("pod")), ",").alias("pod_list"),
        )
    )


def system_totals(service_pods: DataFrame, db_components: DataFrame | None = None) -> DataFrame:
    """Number of services, database components and pods per incident."""
    totals = service_pods.groupBy("uuid").agg(
        F.count("service").alias("microservices"), F.sum("pod_count").alias("pods")
    )
    if db_components is None:
        return totals.withColumn("components", F.lit(0).cast("long"))
    count = db_components.groupBy("uuid").agg(F.count_distinct("entity").alias("components"))
    return totals.join(count, "uuid", "full").select(
        "uuid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("microservices", "pods", "components")]
    )


def metric_coverage(paired: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Distinct metric names per incident, with their display labels."""
    names = METRIC_LABELS if labels is None else labels
    shown = metric_label(F.col("metric"), names)
    return (
        paired.select("uuid", "metric").distinct()
        .groupBy("uuid").agg(
            F.count("metric").alias("metric_count"),
            F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metric_list"),
            F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("label_list"),
        )
    )


def metric_label(metric: Column, labels: dict[str, str] | None = None) -> Column:
    names = METRIC_LABELS if labels is None else labels
    if not names:
        return metric
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[metric], metric)
