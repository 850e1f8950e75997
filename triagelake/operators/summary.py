"""What a run found per incident, and the totals over all incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def run_outcomes(
    incidents: DataFrame, telemetry_hours: DataFrame, evidence: DataFrame
) -> DataFrame:
    """``no_file`` without telemetry in the start hour, else ``empty`` or ``found``."""
    present = telemetry_hours.select("hour_key").distinct().withColumn("_has", F.lit(True))
    sizes = evidence.groupBy("uuid").agg(F.count(F.lit(1)).alias("_rows"))
    joined = incidents.select("uuid", "hour_key").join(present, "hour_key", "left").join(
        sizes, "uuid", "left"
    )
    rows = F.coalesce("_rows", F.lit(0))
    status = (
        F.when(rows > F.lit(0), F.lit("found")).when(F.col("_has"), F.lit("empty"))
        .otherwise(F.lit("no_file"))
    )
    return joined.select("uuid", status.alias("status"), rows.alias("rows_found"))


def _totals() -> list[Column]:
    def of(status):
        return F.count(F.when(F.col("status") == F.lit(status), F.lit(1))).alias(f"{status}_count")

    return [
        F.count(F.lit(1)).alias("total_count"), of("no_file"), of("empty"), of("found"),
        F.sum("rows_found").alias("rows_total"), F.max("rows_found").alias("rows_max"),
    ]


def run_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*_totals())


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """Stores the outcomes; the totals of ``run_summary`` are observed while they are written.

    No second scan counts anything. Of an empty table the counts are 0 and the others None.
    """
    seen = Observation()
    outcomes.observe(seen, *_totals()).write.mode(mode).parquet(path)
    return seen.get
