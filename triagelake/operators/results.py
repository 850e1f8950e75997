"""Answers: parsing, upsert, checks against the component list and filling of gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import NODES, PODS, SERVICES
from triagelake.functions.replies import answer_of, braced_part, is_json_object
from triagelake.operators.logs import last_wins

RESULT_COLUMNS = ["component", "uuid", "reason", "reasoning_trace"]


def with_defaults(results: DataFrame) -> DataFrame:
    """The four result columns in their order, missing ones as empty text or empty list.

    Further columns follow as they are.
    """
    steps = F.coalesce("reasoning_trace", F.array().cast(results.schema["reasoning_trace"].dataType))
    return results.select(
        F.coalesce("component", F.lit("")).alias("component"), "uuid",
        F.coalesce("reason", F.lit("")).alias("reason"), steps.alias("reasoning_trace"),
        *[c for c in results.columns if c not in RESULT_COLUMNS],
    )


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Results from free-text replies; a reply without a JSON object gives no row."""
    kept = [c for c in replies.columns if c != reply]
    # a variable of the list functions holds the braced text, so it is cut out once per reply
    texts = F.filter(F.array(braced_part(F.col(reply))), is_json_object)
    parsed = replies.select(*kept, F.explode(F.transform(texts, answer_of)).alias("_a"))
    return with_defaults(parsed.select(*kept, "_a.component", "_a.reason", "_a.reasoning_trace"))


def upsert_results(existing: DataFrame, fresh: DataFrame, order: str = "seq") -> DataFrame:
    """One result per incident: a fresh one wins, and of several the last in ``order``."""
    old = existing.withColumn("_gen", F.lit(0))
    new = fresh.withColumn("_gen", F.lit(1))
    both = old.unionByName(new)
    return with_defaults(last_wins(both, ["uuid"], ["_gen", order])).drop("_gen", order)


def component_check(
    results: DataFrame,
    nodes: list[str] | None = None,
    services: list[str] | None = None,
    pods: list[str] | None = None,
) -> DataFrame:
    """Level of the named component and whether it is in the closed list."""
    c = F.col("component")
    level = (
        F.when(c.isin(NODES if nodes is None else nodes), F.lit("node"))
        .when(c.isin(SERVICES if services is None else services), F.lit("service"))
        .when(c.isin(PODS if pods is None else pods), F.lit("pod"))
    )
    return results.withColumn("level", F.coalesce(level, F.lit("unknown"))).withColumn(
        "valid", level.isNotNull()
    )


def hot_deck_fill(results: DataFrame, seed: int = 0) -> DataFrame:
    """Incomplete results take the answer of a pseudo-random complete one.

    All complete rows are numbered from 0 in the order of their digests, and an incomplete row
    takes the one whose number is its own digest modulo their count. Numbers are counted inside
    65,536 prefixes of the digest, so no task orders all rows. Without complete rows nothing
    is borrowed.
    """
    filled = (F.coalesce("component", F.lit("")) != F.lit("")) & (
        F.coalesce("reason", F.lit("")) != F.lit("")
    )
    digest = F.md5(F.concat_ws("|", F.col("uuid"), F.lit(str(seed))))
    rows = results.withColumn("_filled", filled).withColumn("_digest", digest)
    donors = rows.where("_filled").select(
        F.substring("_digest", 1, 4).alias("_prefix"), "_digest", F.col("uuid").alias("_donor"),
        F.col("component").alias("d_component"), F.col("reason").alias("d_reason"),
        F.col("reasoning_trace").alias("d_trace"),
    )
    sizes = donors.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_prefix")
    offsets = sizes.select("_prefix", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    place = Window.partitionBy("_prefix").orderBy("_digest", "_donor", "d_component", "d_reason")
    numbered = donors.join(offsets, "_prefix").select(
        (F.col("_before") + F.row_number().over(place) - F.lit(1)).alias("_no"),
        "d_component", "d_reason", "d_trace",
    )
    number = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    count = sizes.agg(F.sum("_n").alias("n")).scalar()
    wanted = F.when(~F.col("_filled"), F.pmod(number, count))
    joined = rows.withColumn("_no", wanted).join(numbered, "_no", "left")
    keep = F.col("_filled") | F.col("d_component").isNull()

    def pick(column, field):
        return F.when(keep, F.col(column)).otherwise(F.col(field)).alias(column)

    return joined.select(
        pick("component", "d_component"), "uuid", pick("reason", "d_reason"),
        pick("reasoning_trace", "d_trace"), (~keep).alias("borrowed"),
    )
