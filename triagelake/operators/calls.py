"""Records of model calls: statistics and the merged report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_stats(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.count_distinct("uuid").alias("total_uuids"), F.count(F.lit(1)).alias("total_calls")
    )


def call_report(calls: DataFrame, order: list[str]) -> DataFrame:
    """One report entry per call, sorted by incident and order.

    The entries stay rows: written in this order they form the merged report, and an
    incident with very many calls is spread over several sorted parts.
    """
    entry = F.concat(
        F.lit("["), F.col("call_type"), F.lit("]\nprompt: "), F.col("prompt"),
        F.lit("\nresponse: "), F.col("response"),
    )
    return calls.select("uuid", *order, entry.alias("entry")).orderBy("uuid", *order)
