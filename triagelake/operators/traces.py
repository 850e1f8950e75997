"""Call paths from spans, abnormal status codes and binned durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import BIN_NS, TOP_K
from triagelake.functions import spans as span
from triagelake.functions.texts import service_alias, text_or_na
from triagelake.session import cut_lineage

#: Words of a Bloom filter that may be broadcast: 16 bytes each.
MAX_BLOOM_WORDS = 1 << 20
PATH = ["parent_pod", "child_pod", "operation"]
STATUS_KEYS = [
    "node_name", "service_name", "parent_pod", "child_pod", "operation",
    "status_code", "status_message",
]


def span_fields(raw: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Flat columns of nested span records, with some further columns as they are."""
    process = F.col("process")
    return raw.select(
        F.col("spanID").alias("span_id"),
        span.parent_span_id(F.col("references")).alias("parent_span_id"),
        (F.col("startTime") * F.lit(1000)).alias("timestamp_ns"),
        F.col("duration"),
        F.col("operationName").alias("operation"),
        span.pod_name(process).alias("pod"),
        span.service_name(process).alias("service_name"),
        span.node_name(process).alias("node_name"),
        F.col("tags"),
        *(extra or []),
    )


def status_tags(spans: DataFrame) -> DataFrame:
    """Spans that speak of a status, with the code and message of their tags."""
    tags = F.col("tags")
    return (
        spans.where(span.mentions_status(tags))
        .withColumn("status_code", span.last_tag(tags, "status.code"))
        .withColumn("status_message", span.last_tag(tags, "status.message"))
    )


def status_fields(spans: DataFrame) -> DataFrame:
    """All spans with the code and message of their tags in place of the tags themselves.

    Done before any join, so that tag lists never cross a shuffle.
    """
    if "tags" not in spans.columns:
        return spans
    tags = F.col("tags")
    speaks = span.mentions_status(tags)
    return spans.withColumns({
        "status_code": F.when(speaks, span.last_tag(tags, "status.code")),
        "status_message": F.when(speaks, span.last_tag(tags, "status.message")),
    }).drop("tags")


def abnormal_status(spans: DataFrame) -> DataFrame:
    """Both status tags present and a code other than 0; takes ``status_fields`` or raw tags."""
    tagged = status_tags(spans) if "tags" in spans.columns else spans
    return tagged.where(
        F.col("status_message").isNotNull() & (F.col("status_code") != F.lit("0"))
    )


def with_parent(
    spans: DataFrame,
    scope: list[str],
    columns: dict[str, str],
    order: list[str],
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Left self-join on the parent span id inside each scope (for instance an incident).

    ``columns`` maps a column of the parent to its new name. Of a repeated span id the last
    row in ``order`` counts. Root spans are spread by their own id, so that the many rows
    without a parent do not meet in one task. ``lookup`` may name a wider set of parents.
    """
    source = spans if lookup is None else lookup
    last = F.max_by(F.struct(*[F.col(c).alias(new) for c, new in columns.items()]),
                    F.struct(*order))
    parents = source.where(F.col("span_id").isNotNull()).groupBy(
        *scope, F.concat(F.lit("p"), "span_id").alias("_key")
    ).agg(last.alias("_parent"))
    lonely = F.coalesce("span_id", F.col(order[0]).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("p"), "parent_span_id"), F.concat(F.lit("-"), lonely))
    joined = spans.withColumn("_key", key).join(parents, [*scope, "_key"], "left")
    kept = [F.col(c) for c in spans.columns]
    return joined.select(*kept, *[F.col("_parent")[new].alias(new) for new in columns.values()])


def call_path_spans(
    spans: DataFrame, scope: list[str], order: list[str], lookup: DataFrame | None = None
) -> DataFrame:
    """Spans with the pod of their parent; the span's own pod becomes the child."""
    joined = with_parent(spans, scope, {"pod": "parent_pod"}, order, lookup)
    return joined.withColumnRenamed("pod", "child_pod")


def _word_and_mask(name: Column, words: int) -> tuple[Column, Column]:
    """The word of a blocked Bloom filter that a name belongs to, and its three bits in it."""
    spread = F.xxhash64(name)
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftright(spread, n), F.lit(64)).cast("int"))
            for n in (40, 46, 52)]
    return F.pmod(spread, F.lit(words)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def bloom_words(names: DataFrame, column: str, per_word: int = 6) -> tuple[DataFrame, int] | None:
    """A Bloom filter of the names as a table of 64-bit words, and the number of its words.

    It has a word for ``per_word`` names, combined before the shuffle. More than MAX_BLOOM_WORDS
    words are not broadcast: then there is no filter, and the join does all the work.
    """
    wanted = names.where(F.col(column).isNotNull()).select(column)
    count = wanted.agg(F.approx_count_distinct(column)).first()[0]
    words = max(1024, count // per_word)
    if words > MAX_BLOOM_WORDS:
        return None
    word, mask = _word_and_mask(F.col(column), words)
    table = wanted.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(
        F.bit_or("_mask").alias("_bits"))
    return table, words


def maybe_named(table: DataFrame, column: str, bloom: tuple[DataFrame, int] | None) -> DataFrame:
    """Rows whose ``column`` may be one of the filter's names; no such row is lost."""
    if bloom is None:
        return table
    filter_, words = bloom
    word, mask = _word_and_mask(F.col(column), words)
    held = table.where(F.col(column).isNotNull()).withColumn("_word", word).join(
        F.broadcast(filter_), "_word")
    return held.where(F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_bits")


def status_combinations(
    spans: DataFrame, scope: list[str], k: int = TOP_K, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Most frequent abnormal status combinations per scope, ties broken by all key columns."""
    bad = abnormal_status(spans).withColumn(
        "service_name", service_alias(F.col("service_name"), aliases)
    )
    named = bad.select(*scope, *[text_or_na(F.col(c)).alias(c) for c in STATUS_KEYS])
    counted = named.groupBy(*scope, *STATUS_KEYS).agg(
        F.count(F.lit(1)).alias("occurrence_count")
    )
    return top_k(counted, scope, "occurrence_count", STATUS_KEYS, k)


def top_k(
    counted: DataFrame, scope: list[str], count: str, ties: list[str], k: int
) -> DataFrame:
    """The ``k`` largest rows of each scope with their rank."""
    place = Window.partitionBy(*scope).orderBy(F.col(count).desc(), *ties)
    ranked = counted.withColumn("rank_no", F.row_number().over(place))
    return ranked.where(F.col("rank_no") <= F.lit(k))


def window_mean_duration(
    spans: DataFrame, keys: list[str], bin_ns: int = BIN_NS, value: str = "duration"
) -> DataFrame:
    """Mean duration per bin, bins counted from the first span of each group.

    A bin is closed at both ends: a span exactly on a border counts in the bin that ends
    there and in the one that starts there. A bin must start before the last span of its
    group, so a group with a single instant has no bin.

    The input is computed once: only the columns in use are written. First and last instants
    come from a small combine over them, then sums and counts are combined per bin before the
    only shuffle of spans, so no task holds a group, however large.
    """
    ts = F.col("timestamp_ns")
    spans = cut_lineage(spans.select(*keys, "timestamp_ns", value), "durations")
    bounds = spans.groupBy(*keys).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last")
    ).where(F.col("_first") < F.col("_last"))
    placed = spans.join(bounds, keys)
    step = F.lit(bin_ns)
    offset = ts - F.col("_first")
    own = F.expr(f"(timestamp_ns - _first) div {bin_ns}")
    on_border = (offset % step == F.lit(0)) & (offset > F.lit(0))
    bins = F.when(on_border, F.array(own - F.lit(1), own)).otherwise(F.array(own))
    start = F.col("_first") + F.col("_bin") * step
    return (
        placed.select(*keys, value, "_first", "_last", F.explode(bins).alias("_bin"))
        .withColumn("bin_start_ns", start)
        .where(F.col("bin_start_ns") < F.col("_last"))
        .groupBy(*keys, "bin_start_ns")
        .agg(F.avg(value).alias("mean_duration"), F.count(F.lit(1)).alias("spans"))
    )


def known_path() -> Column:
    """All three parts of the call path are known; detection looks at these only."""
    return F.col("parent_pod").isNotNull() & F.col("child_pod").isNotNull() & F.col(
        "operation"
    ).isNotNull()


def normal_trace_groups(spans: DataFrame, scope: list[str]) -> DataFrame:
    """Sizes and time spans of the call-path groups of every recovery window."""
    return spans.where(known_path()).groupBy(*scope, *PATH).agg(
        F.count(F.lit(1)).alias("spans"),
        F.min("timestamp_ns").alias("first_ns"),
        F.max("timestamp_ns").alias("last_ns"),
    )


def baseline_stats(bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, median, extremes and count of bin means per call path."""
    v = F.col("mean_duration")
    return bins.groupBy(*(PATH if keys is None else keys)).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.percentile(v, 0.5).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"),
    )


def span_profile(spans: DataFrame) -> DataFrame:
    """Row count, distinct names and time range of a span table."""
    return spans.agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_distinct("pod").alias("pods"),
        F.count_distinct("service_name").alias("services"),
        F.count_distinct("node_name").alias("nodes"),
        F.count_distinct("span_id").alias("span_ids"),
        F.min("timestamp_ns").alias("first_ns"),
        F.max("timestamp_ns").alias("last_ns"),
    )
