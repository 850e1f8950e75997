"""Error-log filters, deduplication by template, ordering and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.texts import contains_error, is_injected, service_of_log_pod
from triagelake.operators.ranks import numbered


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("none of the wanted columns exists")
    return df.select(*present)


def error_logs(logs: DataFrame, column: str = "message") -> DataFrame:
    return logs.where(contains_error(F.col(column)))


def drop_injected(logs: DataFrame, column: str = "message") -> DataFrame:
    return logs.where(~is_injected(F.col(column)))


def template_counts(logs: DataFrame, keys: list[str]) -> DataFrame:
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"))


def dedup_first(
    logs: DataFrame,
    keys: list[str],
    order: list[str],
    payload: list[str],
) -> DataFrame:
    """First row of every key with the size of its group.

    An aggregate with a combine step rather than a ranking window, so a key that owns a
    large share of the rows is reduced before the shuffle. NULL keys form a group.
    """
    first = F.min_by(F.struct(*payload), F.struct(*order))
    return (
        logs.groupBy(*keys)
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("occurrence_count"))
        .select(*keys, "_first.*", "occurrence_count")
    )


def distinct_messages(
    logs: DataFrame, keys: list[str], order: list[str], payload: list[str]
) -> DataFrame:
    """Rows of equal key and message merged into the first one and a count.

    Logs repeat themselves; merging them first keeps repeated messages out of later joins.
    """
    place = F.struct(*order)
    return logs.groupBy(*keys, "message").agg(
        F.min(place).alias("_place"), F.min_by(F.struct(*payload), place).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )


def dedup_merged(
    merged: DataFrame, keys: list[str], payload: list[str]
) -> DataFrame:
    """``dedup_first`` on rows from ``distinct_messages`` that got a template since."""
    first = F.min_by(F.struct("_first.*", "message"), F.struct("_place", "message"))
    return (
        merged.groupBy(*keys)
        .agg(first.alias("_row"), F.sum("_n").alias("occurrence_count"))
        .select(*keys, *[F.col(f"_row.{c}") for c in [*payload, "message"]], "occurrence_count")
    )


def with_service(logs: DataFrame, pod: str = "pod_name") -> DataFrame:
    return logs.withColumn("service_name", service_of_log_pod(F.col(pod)))


def order_by_count(deduped: DataFrame, partition: list[str], ties: list[str]) -> DataFrame:
    """Adds the line number by falling count inside each incident; counts compare as numbers."""
    return numbered(deduped, partition, [F.col("occurrence_count").desc(), *ties])


def sample_per_group(
    logs: DataFrame, group: list[str], key: list[str], k: int = 3, seed: int = 42
) -> DataFrame:
    """At most ``k`` rows per group in a seeded random order."""
    place = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    ranked = logs.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group).orderBy(place, *key))
    )
    return ranked.where(F.col("_rank") <= F.lit(k)).drop("_rank")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record per key, by the given order."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def first_in_group(
    rows: DataFrame, keys: list[str], order: list[str], payload: list[str]
) -> DataFrame:
    first = F.min_by(F.struct(*payload), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def entity_names(evidence: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Distinct names per incident and kind; a kind may draw on several columns."""
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("name"))
        for kind, columns in kinds.items() for column in columns
    ]
    return (
        evidence.select("uuid", F.explode(F.array(*pairs)).alias("e"))
        .select("uuid", "e.kind", "e.name").where(F.col("name").isNotNull()).distinct()
    )
