"""Line numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage

#: Rows of a group up to which one task numbers it.
GROUP_ROWS = 1_000_000


def numbered(
    rows: DataFrame, group: list[str], order: list[Column | str], name: str = "line_no",
    group_rows: int = GROUP_ROWS, ranges: int | None = None,
) -> DataFrame:
    """Adds the place, from 1, of each row inside its group.

    The rows are written once and the groups counted. Groups of normal size are numbered by a
    window. If a larger one exists, rows are dealt by ranges of (group, order), so that a group
    is spread over as many tasks as it needs: each range numbers its rows, and what earlier ranges
    hold of the group is added. Both give the same numbers where ``order`` tells all rows apart;
    NULL groups are a group. An empty table stays empty.
    """
    rows = cut_lineage(rows, "numbered")
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    count = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    largest = count.agg(F.max("_n")).first()[0] or 0
    if largest <= group_rows:
        place = Window.partitionBy(*group).orderBy(*by)
        return rows.withColumn(name, F.row_number().over(place).cast("long"))
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that every later branch sees the same ranges
    dealt = cut_lineage(
        rows.repartitionByRange(n, *group, *by).withColumn("_range", F.spark_partition_id()),
        "ranges")
    # at most one row per range and group that meets it
    held = dealt.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    held = held.select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_range", *group).orderBy(*by)
    placed = dealt.withColumn("_place", F.row_number().over(inside)).join(held, same)
    return placed.select(
        *rows.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))
