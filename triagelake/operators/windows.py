"""Incident windows and the interval join that attaches telemetry to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import HOUR_NS, LOCAL_ZONE, NORMAL_MARGIN_NS, RECOVERY_NS
from triagelake.functions.times import local_date, local_hour_key, ns_to_local
from triagelake.session import cut_lineage

CHUNK = 4096
BROADCAST_ROWS = 500_000
#: Facts of a block that one task joins; blocks with more are split.
SALT_ROWS = 1_000_000
SALTED_BLOCKS = 10_000
LEVELS = 40


def fault_windows(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "uuid", F.lit("fault").alias("kind"),
        F.col("start_ns").alias("w_start_ns"), F.col("end_ns").alias("w_end_ns"),
    )


def neighbours(incidents: DataFrame, order_by: str = "ord", chunk: int = CHUNK) -> DataFrame:
    """Adds the end of the previous and the start of the next incident in list order.

    The list is cut into chunks of the order column, so no task sorts the whole list;
    only one edge row per chunk meets in a second, much smaller window.
    """
    chunk_id = F.floor(F.col(order_by) / F.lit(chunk))
    rows = incidents.withColumn("_chunk", chunk_id)
    inner = Window.partitionBy("_chunk").orderBy(order_by, "uuid")
    rows = rows.withColumn("_prev", F.lag("end_ns").over(inner)).withColumn(
        "_next", F.lead("start_ns").over(inner)
    )
    place = F.struct(order_by, "uuid")
    edges = rows.groupBy("_chunk").agg(
        F.min_by("start_ns", place).alias("_first_start"),
        F.max_by("end_ns", place).alias("_last_end"),
    )
    outer = Window.orderBy("_chunk")
    edges = edges.select(
        "_chunk",
        F.lag("_last_end").over(outer).alias("_edge_prev"),
        F.lead("_first_start").over(outer).alias("_edge_next"),
    )
    return (
        rows.join(edges, "_chunk")
        .withColumn("prev_end_ns", F.coalesce("_prev", "_edge_prev"))
        .withColumn("next_start_ns", F.coalesce("_next", "_edge_next"))
        .drop("_chunk", "_prev", "_next", "_edge_prev", "_edge_next")
    )


def normal_windows(
    incidents: DataFrame, margin_ns: int = NORMAL_MARGIN_NS, order_by: str = "ord"
) -> DataFrame:
    """Quiet time before and after each incident; a missing neighbour gives no window."""
    around = neighbours(incidents, order_by)
    before = F.struct(
        F.lit("normal_before").alias("kind"),
        (F.col("prev_end_ns") + F.lit(margin_ns)).alias("w_start_ns"),
        F.col("start_ns").alias("w_end_ns"),
    )
    after = F.struct(
        F.lit("normal_after").alias("kind"),
        (F.col("end_ns") + F.lit(margin_ns)).alias("w_start_ns"),
        F.col("next_start_ns").alias("w_end_ns"),
    )
    return (
        around.select("uuid", F.explode(F.array(before, after)).alias("w"))
        .select("uuid", "w.*")
        .where(F.col("w_start_ns").isNotNull() & F.col("w_end_ns").isNotNull())
    )


def recovery_windows(incidents: DataFrame, length_ns: int = RECOVERY_NS) -> DataFrame:
    return incidents.select(
        "uuid", F.lit("recovery").alias("kind"),
        F.col("end_ns").alias("w_start_ns"),
        (F.col("end_ns") + F.lit(length_ns)).alias("w_end_ns"),
    )


def all_windows(
    incidents: DataFrame, margin_ns: int = NORMAL_MARGIN_NS, order_by: str = "ord"
) -> DataFrame:
    return fault_windows(incidents).unionByName(normal_windows(incidents, margin_ns, order_by))


def clip_to_start(
    windows: DataFrame, incidents: DataFrame, scope: str = "full", zone: str = LOCAL_ZONE
) -> DataFrame:
    """Restricts windows to the local hour or day in which their incident starts.

    ``full`` leaves them whole. ``hour`` and ``day`` give what a reader sees who opens
    only the one file of the start hour (logs, spans) or of the start day (metrics).
    """
    if scope == "full":
        return windows
    step = {"hour": HOUR_NS, "day": 24 * HOUR_NS}[scope]
    local = F.date_trunc(scope, ns_to_local(F.col("start_ns"), zone))
    low = F.unix_micros(F.to_utc_timestamp(local, zone)) * F.lit(1000)
    bounds = incidents.select("uuid", low.alias("_low"), (low + F.lit(step - 1)).alias("_high"))
    return windows.join(bounds, "uuid").select(
        "uuid", "kind",
        F.greatest("w_start_ns", "_low").alias("w_start_ns"),
        F.least("w_end_ns", "_high").alias("w_end_ns"),
    )


def block_of(ts: Column, width: int) -> Column:
    """Number of the ``width`` long block of time that an instant lies in."""
    at, unit = ts.cast("long"), F.lit(width).cast("long")
    return F.call_function("div", at - F.pmod(at, unit), unit)


def dyadic_cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The blocks ``first`` to ``last`` as few blocks of doubling length.

    A struct (level, block) stands for the blocks ``block << level`` and the ``2^level - 1`` after
    it. At most two blocks of each level are needed, so a run of n blocks takes 2 log n of them.
    """
    def of_level(level: Column) -> Column:
        # what is left between ``low`` and ``high`` when all shorter blocks are taken
        low = -F.call_function("shiftright", -first, level)
        high = F.call_function("shiftright", last + F.lit(1), level)
        odd_low = (low < high) & (F.abs(low % F.lit(2)) == F.lit(1))
        inner = F.when(odd_low, low + F.lit(1)).otherwise(low)
        odd_high = (inner < high) & (F.abs(high % F.lit(2)) == F.lit(1))
        left = F.when(odd_low, F.struct(level.alias("level"), low.alias("block")))
        right = F.when(odd_high, F.struct(level.alias("level"), (high - F.lit(1)).alias("block")))
        return F.array(left, right)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))
    return F.filter(every, lambda b: b.isNotNull())


def _salts(keyed: DataFrame, levels: list[int], salt_rows: int) -> DataFrame:
    """(_level, _block, _salts) of the blocks with more than ``salt_rows`` facts.

    Found by a count per shortest block, combined before its shuffle. There are at most
    SALTED_BLOCKS of them, since the bound rises with the table, so they can be broadcast.
    """
    counted = cut_lineage(keyed.groupBy("_unit").agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    bound = max(salt_rows, -(-total * len(levels) // SALTED_BLOCKS))
    rolled = counted.select("_n", F.explode(_keys(levels)).alias("_key")).groupBy(
        F.col("_key.level").alias("_level"), F.col("_key.block").alias("_block")
    ).agg(F.sum("_n").alias("_n"))
    return rolled.where(F.col("_n") > F.lit(bound)).select(
        "_level", "_block", F.ceil(F.col("_n") / F.lit(bound)).cast("int").alias("_salts"))


def _keys(levels: list[int]) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("level"), F.shiftright("_unit", n).alias("block")) for n in levels
    ])


def _cover(windows: DataFrame, bucket_ns: int) -> DataFrame:
    """Windows with one row per dyadic block (_level, _block) that they need."""
    start, end = F.col("w_start_ns"), F.col("w_end_ns")
    blocks = F.explode(dyadic_cover(block_of(start, bucket_ns), block_of(end, bucket_ns)))
    return windows.where(start <= end).withColumn("_key", blocks).withColumn(
        "_level", F.col("_key.level")).withColumn("_block", F.col("_key.block")).drop("_key")


def used_keys(windows: DataFrame, partition_by: str) -> DataFrame:
    """The local dates ("date") or hours ("hour_key") that some window touches.

    Equal blocks of different windows are merged before they are taken apart into hours.
    """
    blocks = _cover(windows, HOUR_NS).select("_level", "_block").distinct().withColumn(
        "_size", F.expr("shiftleft(1L, _level)"))
    first = F.col("_block") * F.col("_size")
    hours = blocks.select(F.explode(F.sequence(first, first + F.col("_size") - F.lit(1)))
                          .alias("_hour"))
    derive = {"date": local_date, "hour_key": local_hour_key}[partition_by]
    names = hours.select(derive(F.col("_hour") * F.lit(HOUR_NS)).alias(partition_by))
    return names.where(F.col(partition_by).isNotNull()).distinct()


def interval_join(
    facts: DataFrame,
    windows: DataFrame,
    ts: str = "timestamp_ns",
    bucket_ns: int = HOUR_NS,
    partition_by: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """One row per (fact, window) with ``w_start_ns <= ts <= w_end_ns``.

    Every window is covered by dyadic blocks, the shortest ``bucket_ns`` long: a window of a
    month costs some twenty rows, not one per hour. A fact has one key per level in use, so the
    range condition becomes an equality on (level, block) with a residual range check. If the
    shortest blocks of all windows can be broadcast, they are used alone: one key per fact. One look
    at the (small) window table gives the outer bounds, which become a pushed filter on the
    facts, the levels, and the number of blocks. Up to ``broadcast_rows`` of them are broadcast,
    so the facts are not shuffled; beyond that both sides are shuffled on the block, and blocks
    with more than ``salt_rows`` facts are split by a salt, which repeats only their windows.
    ``partition_by`` names a partition column of the facts ("date" or "hour_key"); partitions
    no window touches are then never read.
    """
    start, end = F.col("w_start_ns"), F.col("w_end_ns")
    cover = _cover(windows, bucket_ns)
    size = F.expr("shiftleft(1L, _level)")
    low, high, count, units, levels = cover.agg(
        F.min(start), F.max(end), F.count(F.lit(1)), F.sum(size.cast("double")),
        F.collect_set("_level")).first()
    if low is not None and units <= broadcast_rows:  # then a fact needs a single key
        first = F.col("_block") * size
        cover = cover.withColumn(
            "_block", F.explode(F.sequence(first, first + size - F.lit(1)))).withColumn(
            "_level", F.lit(0))
        levels = [0]
    within = F.lit(False) if low is None else F.col(ts).between(F.lit(low), F.lit(high))
    levels = sorted(levels) or [0]
    inside = facts.where(within)
    if partition_by is not None and low is not None:
        used = used_keys(windows, partition_by)  # at most one for each hour between the bounds
        used = F.broadcast(used) if (high - low) // HOUR_NS + 2 <= broadcast_rows else used
        inside = inside.join(used, partition_by, "left_semi")
    keyed = inside.withColumn("_unit", block_of(F.col(ts), bucket_ns))
    if len(levels) == 1:
        shifted = F.shiftright("_unit", levels[0])
        bucketed = keyed.withColumn("_level", F.lit(levels[0])).withColumn("_block", shifted)
    else:
        bucketed = keyed.withColumn("_key", F.explode(_keys(levels))).withColumn(
            "_level", F.col("_key.level")).withColumn("_block", F.col("_key.block")).drop("_key")
    keys = ["_level", "_block"]
    if count <= broadcast_rows:
        cover = F.broadcast(cover)
    else:
        hot = cut_lineage(_salts(keyed, levels, salt_rows), "salts")
        if not hot.isEmpty():
            hot = F.broadcast(hot)
            plain = [f.name for f in facts.schema if f.dataType.typeName() not in ("map", "variant")]
            spread = F.pmod(F.xxhash64(*plain), F.col("_salts")).cast("int")
            bucketed = bucketed.join(hot, keys, "left").withColumn(
                "_salt", F.coalesce(spread, F.lit(0))).drop("_salts")
            copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - F.lit(1))
            cover = cover.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop(
                "_salts")
            keys.append("_salt")
        cover = cover.hint("merge")
    hit = F.col(ts).between(start, end)
    return bucketed.join(cover, keys).where(hit).drop(*keys, "_unit")


def elementary_intervals(windows: DataFrame) -> DataFrame:
    """The time line cut at every window border: (uuid, kind, i_start_ns, i_end_ns).

    Intervals are closed and do not overlap, so an instant lies in one of them at most; each
    window is listed with the intervals it consists of. Windows that end before they start have
    none. Equal windows are listed as often as they are given.
    """
    valid = windows.where(F.col("w_start_ns") <= F.col("w_end_ns"))
    borders = valid.select(
        F.explode(F.array("w_start_ns", F.col("w_end_ns") + F.lit(1))).alias("i_start_ns")
    ).distinct()
    rows = borders.withColumn("_chunk", block_of(F.col("i_start_ns"), 24 * HOUR_NS))
    inner = Window.partitionBy("_chunk").orderBy("i_start_ns")
    rows = rows.withColumn("_next", F.lead("i_start_ns").over(inner))
    # one row per day with a border meets in this window
    edges = borders.groupBy(block_of(F.col("i_start_ns"), 24 * HOUR_NS).alias("_chunk")).agg(
        F.min("i_start_ns").alias("_first"))
    edges = edges.select("_chunk", F.lead("_first").over(Window.orderBy("_chunk")).alias("_edge"))
    until = F.coalesce("_next", "_edge") - F.lit(1)
    pieces = rows.join(edges, "_chunk").select("i_start_ns", until.alias("i_end_ns"))
    pieces = cut_lineage(pieces.where(F.col("i_end_ns").isNotNull()), "intervals")
    found = interval_join(pieces, valid, ts="i_start_ns")
    return found.select("uuid", "kind", "i_start_ns", "i_end_ns")


def in_windows(
    facts: DataFrame, windows: DataFrame, columns: list[str | Column], **options
) -> DataFrame:
    """The interval join, projected to the incident, the window kind and some fact columns."""
    return interval_join(facts, windows, **options).select("uuid", "kind", *columns)
