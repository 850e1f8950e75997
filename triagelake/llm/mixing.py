"""Mixing sources to target weights by pivotal rounding of copy counts.

Every document starts with a fractional number of copies, the share of its source. Within a
chunk, two documents at a time trade words at random, without bias and without changing the
words of the pair, until one of them has a whole number of copies. One fractional document per
chunk is left; these residuals meet in the next level of a tree, chunk by chunk, down to one
per source. The last one is rounded, and documents of the root chunk whose rounding can be
turned round bring the source closer to its target.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CHUNK = 4096
FAN_IN = 64
#: Sources, one narrow row each, up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
STATE = pa.schema([
    ("_id", pa.int64()), ("_key", pa.int64()), ("_source", pa.int64()), ("_bucket", pa.int64()),
    ("size", pa.int64()), ("part", pa.float64()), ("_open", pa.bool_()),
])
#: Equal rows that travel to a chunk as one.
TOGETHER = 64
STATE_DDL = "_id long, _key long, _source long, _bucket long, size long, part double, _open boolean"
EPS = 1e-9


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, _source, source_size, target) from the size of each source.

    Sources by code point, NULL last, take the weights in turn. Targets stop at ``cap`` times
    the size; what is cut goes to the others by weight, which is the level at which the targets
    sum up to ``share`` of all sizes. One row per source is all that meets in one task.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_source", F.row_number().over(ordered).cast("long") - 1)
    rows = rows.withColumn("w", F.element_at(turn, (F.col("_source") % len(weights)).cast("int") + 1))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn(
        "ratio", F.col("most") / F.col("w")
    )
    by_ratio = Window.orderBy("ratio", "_source")
    every = Window.partitionBy()
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) * F.lit(float(share))
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("w").over(rest)
    rows = rows.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("ratio"), F.struct("ratio", "_source", "_level"))
    rows = rows.withColumn("_level", F.min(fits).over(every)["_level"])
    target = F.coalesce(F.least("most", F.col("_level") * F.col("w")), F.col("most"))
    return rows.select("source", "_source", "source_size", target.alias("target"))


def _trade(part: list[float], size: list[int], rng: np.random.Generator) -> int:
    """Rounds all parts but one, which is returned (-1 if none is left)."""
    left = -1
    for j in range(len(part)):
        if not EPS < part[j] < 1 - EPS:
            part[j] = float(round(part[j]))
            continue
        if left < 0:
            left = j
            continue
        i = left
        to_i = min((1 - part[i]) * size[i], part[j] * size[j])
        to_j = min(part[i] * size[i], (1 - part[j]) * size[j])
        moved = to_i if rng.random() * (to_i + to_j) < to_j else -to_j
        part[i] += moved / size[i]
        part[j] -= moved / size[j]
        open_now = [x for x in (i, j) if EPS < part[x] < 1 - EPS]
        for x in (i, j):
            if x not in open_now:
                part[x] = float(round(part[x]))
        left = open_now[0] if open_now else -1
    return left


def _settle(part: np.ndarray, size: np.ndarray, excess: float) -> None:
    """Turns roundings round, the best fitting document first, while that helps."""
    while True:
        after = np.abs(excess + np.where(part > 0.5, -size, size))
        best = int(np.argmin(after)) if len(after) else -1
        if best < 0 or after[best] >= abs(excess) - 0.5:
            return
        excess += -size[best] if part[best] > 0.5 else size[best]
        part[best] = 1.0 - part[best]


def _round_chunk(seed: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        times = table["_times"].to_numpy()
        table = table.take(pa.array(np.repeat(np.arange(len(times)), times)))
        table = table.sort_by([("size", "descending"), ("_id", "ascending"),
                               ("_key", "ascending"), ("part", "ascending")])
        size = table["size"].to_numpy().astype(np.int64)
        part = table["part"].to_numpy().astype(float).copy()
        source, bucket = table["_source"][0].as_py(), table["_bucket"][0].as_py()
        rng = np.random.Generator(np.random.PCG64([seed, level, source, bucket]))
        root = not table["_more"][0].as_py()
        start = part.copy()
        values = part.tolist()
        left = _trade(values, size.tolist(), rng)
        part = np.array(values)
        if root:
            if left >= 0:
                part[left] = float(rng.random() < part[left])
            free = (start > EPS) & (start < 1 - EPS)
            settled = part[free]
            _settle(settled, size[free], float(((part - start) * size).sum()))
            part[free] = settled
            left = -1
        still = np.zeros(len(part), dtype=bool)
        if left >= 0:
            still[left] = True
        columns = {f.name: table[f.name] for f in STATE if f.name not in ("part", "_open")}
        columns |= {"part": pa.array(part), "_open": pa.array(still)}
        return pa.table(columns, schema=STATE)

    return run


def mixed_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7,
) -> DataFrame:
    """(id, source, _key, size, source_size, target, copies, taken) of every row of ``docs``.

    ``size`` counts words, NULL text has none. ``copies`` is the whole number of times the mix
    holds the document, at most ``ceil(cap)``; ``taken`` are the words of these copies. Empty
    documents never change a sum; they get the whole copies of their source's share. Random
    numbers come from the seed, the source and the chunk, and rows are ordered by their values,
    so reruns agree. Repeated rows and ids are rounded each for itself; equal rows are counted
    first and dealt to the chunks in small packs. An empty table gives an empty one. Other columns
    are not read.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("_key"),
    )
    rows = cut_lineage(
        rows.groupBy("_id", "source", "size", "_key").agg(F.count("*").alias("_times")), "sizes")
    sums = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("_times")).alias("source_size"),
        F.ceil(F.sum("_times") / CHUNK).alias("_buckets"),
    )
    targets = source_targets(sums.select("source", "source_size"), weights, share, cap)
    per_source = cut_lineage(
        targets.join(sums.select(F.col("source").alias("_s"), "_buckets"),
                     F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "sources"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    small = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    spread = F.broadcast if small else lambda table: table
    all_rows = rows.join(
        spread(per_source.withColumnRenamed("source", "_s")),
        F.col("source").eqNullSafe(F.col("_s")),
    ).drop("_s").withColumn("_whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    # one row per pack of equal rows; a pack of each row is all there is without repeats
    packs = F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / TOGETHER).cast("long")))
    all_rows = all_rows.withColumn("_pack", packs).withColumn(
        "_times", F.least(F.lit(TOGETHER), F.col("_times") - F.col("_pack") * TOGETHER))
    state = all_rows.where("size > 0").select(
        "_id", "_key", "_source", "size", "part", F.lit(True).alias("_open"), "_buckets",
        F.pmod(F.xxhash64("_id", "_key", "_pack"), F.col("_buckets")).alias("_bucket"), "_times",
    )
    most = per_source.agg(F.max("_buckets")).first()[0] or 1
    levels = 1 + (math.ceil(math.log(most, FAN_IN)) if most > 1 else 0)
    done = None
    for level in range(levels):
        grouped = state.withColumn("_more", F.col("_buckets") > 1)
        out = grouped.groupBy("_source", "_bucket").applyInArrow(
            _round_chunk(seed, level), STATE_DDL
        )
        out = cut_lineage(out, "rounded")
        closed = out.where("not _open").select("_id", "_key", "_source", "size", "part")
        done = closed if done is None else done.unionByName(closed)
        span = FAN_IN ** (level + 1)
        state = out.where("_open").join(
            per_source.select("_source", F.col("_buckets").alias("_first")), "_source"
        ).select(
            "_id", "_key", "_source", "size", "part", "_open",
            F.ceil(F.col("_first") / span).alias("_buckets"),
            F.floor(F.col("_bucket") / FAN_IN).alias("_bucket"), F.lit(1).cast("long").alias("_times"),
        )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    empty = all_rows.where("size = 0").withColumn("_each", each).select(
        "_id", "_key", "_source", "size", F.lit(0.0).alias("part")
    )
    named = per_source.select(
        "_source", "source", "source_size", "target", F.floor(rate).alias("_whole")
    )
    joined = done.unionByName(empty).join(spread(named), "_source")
    copies = F.col("_whole") + F.round("part").cast("long")
    return joined.select(
        F.col("_id").alias(id_col), F.col("source").alias(source_col), "_key", "size",
        "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Rows equal in id, source and text count as one row with the copies of all of them.
    """
    copies = mixed_copies(docs, id_col, text_col, source_col, **options)
    times = copies.groupBy(
        F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.col("_key").alias("_k")
    ).agg(F.sum("copies").alias("_times")).where("_times > 0")
    # the caller's columns travel in one struct, so no name can clash
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("origin"),
        F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    same = (F.col("id").eqNullSafe(F.col("_i")) & F.col("origin").eqNullSafe(F.col("_s"))
            & (F.col("hash") == F.col("_k")))
    repeated = keyed.dropDuplicates(["id", "origin", "hash"]).join(times, same)
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
