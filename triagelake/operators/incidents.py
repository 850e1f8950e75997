"""From incident descriptions to the incident table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.fixed_values import LOCAL_ZONE, SAMPLE_INCIDENTS, SAMPLE_SEED, SECOND_NS
from triagelake.functions.times import iso_to_ns, local_date, local_hour_key, ns_to_local

#: Positions that one list may use; a single file stays far below.
LIST_STEP = 1 << 48
#: Fixed value: the form of an instant in a report.
INSTANT = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)"


def incident_times(reports: DataFrame, text: str = "description") -> DataFrame:
    """First two instants of a free-text report; reports with fewer are dropped."""
    found = F.regexp_extract_all(F.col(text), F.lit(INSTANT), F.lit(1))
    return (
        reports.withColumn("_instants", found)
        .where(F.size("_instants") >= F.lit(2))
        .withColumn("start_text", F.col("_instants")[0])
        .withColumn("end_text", F.col("_instants")[1])
        .drop("_instants")
    )


def incident_keys(timed: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Nanoseconds, local date and hour keys and durations of timed incidents."""
    start, end = F.col("start_ns"), F.col("end_ns")
    stamp = "yyyy-MM-dd_HH-mm-ss"
    seconds = (end - start) / F.lit(float(SECOND_NS))
    return (
        timed.withColumn("start_ns", iso_to_ns(F.col("start_text")))
        .withColumn("end_ns", iso_to_ns(F.col("end_text")))
        .withColumn("start_local", F.date_format(ns_to_local(start, zone), stamp))
        .withColumn("end_local", F.date_format(ns_to_local(end, zone), stamp))
        .withColumn("date", local_date(start, zone))
        .withColumn("hour", F.date_format(ns_to_local(start, zone), "HH-00-00"))
        .withColumn("hour_key", local_hour_key(start, zone))
        .withColumn("duration_s", seconds)
        .withColumn("duration_min", seconds / F.lit(60.0))
        .drop("start_text", "end_text")
    )


def union_lists(*lists: DataFrame) -> DataFrame:
    """Bag union in list order.

    Each list brings its own ``ord``; the result has one that runs on from list to list, so
    neighbours in it are neighbours in the joined list. ``list_no`` names the list.
    """
    if not lists:
        raise ValueError("no incident list given")
    tagged = [
        df.withColumn("list_no", F.lit(i)).withColumn("ord", F.col("ord") + F.lit(i * LIST_STEP))
        for i, df in enumerate(lists)
    ]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result


def sample_incidents(
    incidents: DataFrame, n: int = SAMPLE_INCIDENTS, seed: int = SAMPLE_SEED
) -> DataFrame:
    """``n`` incidents in a seeded random order; all of them when there are not more."""
    place = F.md5(F.concat_ws("|", F.col("uuid"), F.lit(str(seed))))
    return incidents.orderBy(place, "uuid").limit(n)


def pending_incidents(incidents: DataFrame, results: DataFrame) -> DataFrame:
    """Incidents without a result that names both a component and a reason."""
    answered = F.coalesce(F.col("component"), F.lit("")) != F.lit("")
    reasoned = F.coalesce(F.col("reason"), F.lit("")) != F.lit("")
    done = results.where(answered & reasoned).select("uuid")
    return incidents.join(done, "uuid", "left_anti")
