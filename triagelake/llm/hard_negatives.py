"""Hard negatives by threshold joins over an index with suffix-norm bounds.

Rows are dealt to shards by a hash of their id. A shard orders the dimensions by their weight and
indexes, per block of dimensions, only the rows that need it: the end of a row whose norm alone
lifts no product over the threshold is left out and only used to verify. A search
accumulates partial products block after block and drops a row as soon as its partial product plus
the product of the remaining norms stays below the threshold; what a dropped row can still reach
is remembered. Thresholds start high and are lowered until the windows of an anchor are full, and
then only rows whose remembered reach is high enough are taken up again.

Every shard fills its own windows, so no row that belongs to the result is missed. One home shard
is searched first; the k-th scores found there are where the other shards stop to lower theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm import packed
from triagelake.session import cut_lineage

SHARD_ROWS = 8192
BLOCK = 8
#: The first step by which a threshold comes down, as a part of its range; later steps double.
STEPS = 8
EXACT = float(1 << 53)
MOST, LEAST = (1 << 63) - 1, -(1 << 63)

HITS_DDL = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
HITS = pa.schema([(n, pa.int64()) for n in (
    "anchor_id", "positive_id", "positive_score", "vec_id", "score")])


def whole_products(vecs: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact 64-bit products of whole-number vectors; beyond 64 bits the nearest 64-bit number."""
    if not len(vecs):
        return np.zeros(0, dtype=np.int64)
    peak = np.abs(vecs).max() * np.abs(query).max() * vecs.shape[1]
    if peak < EXACT:
        return (vecs @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(LEAST, min(MOST, sum(int(a) * b for a, b in zip(v, q, strict=True))))
                     for v in vecs], dtype=np.int64)


class SuffixIndex:
    """Rows of a shard, and per block of dimensions the rows that have it in the index.

    ``left[i]`` is the norm of what a row has from block ``i`` on. While no threshold is below
    ``ratio`` times the norm of its anchor, blocks whose ``left`` is below ``ratio`` need not be
    indexed: alone they lift no product over a threshold. A lower threshold extends the index.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vecs = ids[by_id], labels[by_id], vecs[by_id]
        # dividing by the largest component keeps squares of any length finite
        self.scale = max(np.abs(vecs).max(initial=0.0), 1.0)
        small = self.vecs / self.scale
        self.order = np.argsort(-(small ** 2).sum(axis=0), kind="stable")
        ordered = small[:, self.order]
        dim = vecs.shape[1]
        self.edges = [*range(0, dim, BLOCK), dim]
        self.blocks = [np.ascontiguousarray(ordered[:, a:b])
                       for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        left = np.zeros((len(self.edges), len(ids)))
        for i in range(len(self.blocks) - 1, -1, -1):
            left[i] = left[i + 1] + (self.blocks[i] ** 2).sum(axis=1)
        self.left = np.sqrt(left)
        self.ratio = math.inf
        self.indexed = np.zeros(len(ids), dtype=np.int64)

    def extend(self, ratio: float) -> None:
        if ratio < self.ratio:
            self.ratio = ratio
            self.indexed = np.count_nonzero(self.left[:-1] >= ratio, axis=0)


class Search:
    """One anchor against the rows of an index; ``reach`` bounds the product of every open row."""

    def __init__(self, index: SuffixIndex, query: np.ndarray, allowed: np.ndarray):
        self.index, self.query = index, query
        scale = max(np.abs(query).max(initial=0.0), 1.0)
        self.unit = min(scale * index.scale, 1.7e308)
        small = (query / scale)[index.order]
        self.parts = [small[a:b] for a, b in zip(index.edges[:-1], index.edges[1:], strict=True)]
        self.left = np.sqrt([float((small[a:] ** 2).sum()) for a in index.edges])
        self.open = allowed
        self.reach = self.left[0] * index.left[0][allowed] * (1 + 1e-9) + 1e-12
        self.found = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)

    def top(self) -> float:
        return float(self.reach.max(initial=0.0)) * self.unit

    def lower(self, threshold: float) -> None:
        """Finds every open row whose product reaches the threshold."""
        index = self.index
        floor = threshold / self.unit
        floor -= 1e-9 * (abs(floor) + 1e-3)
        index.extend(floor / max(self.left[0], 1e-300) * (1 - 1e-9) if floor > 0 else -1.0)
        wanted = self.reach >= floor
        rows = self.open[wanted]
        dropped, dropped_reach = [self.open[~wanted]], [self.reach[~wanted]]
        total = np.zeros(len(rows))
        for i, part in enumerate(self.parts):
            listed = index.indexed[rows] > i
            if listed.all():
                total = total + index.blocks[i][rows] @ part
            elif listed.any():
                total[listed] += index.blocks[i][rows[listed]] @ part
            else:
                break
            ends = np.minimum(index.indexed[rows], i + 1)
            rest = self.left[ends] * index.left[ends, rows]
            bound = total + rest + 1e-9 * (np.abs(total) + rest + 1e-3)
            alive = bound >= floor
            if not alive.all():
                dropped.append(rows[~alive])
                dropped_reach.append(bound[~alive])
                rows, total = rows[alive], total[alive]
            if not len(rows):
                break
        exact = whole_products(index.vecs[rows], self.query)
        self.found = np.concatenate([self.found, rows])
        self.score = np.concatenate([self.score, exact])
        self.open = np.concatenate(dropped)
        self.reach = np.concatenate(dropped_reach)


def _windows_of(index: SuffixIndex, query: np.ndarray, allowed: np.ndarray,
                windows: list[tuple[int, int]], k: int, steps: int) -> list[tuple]:
    """Ids and scores of the k best rows inside each (high, low).

    The threshold falls in growing steps, the first one a ``steps``-th of the range.
    """
    search = Search(index, query, allowed)
    top = search.top()
    bottom = max(float(min(low for _, low in windows)), -1.01 * top - 1.0)
    threshold = max(min(top, float(max(high for high, _ in windows))), bottom)
    step = (threshold - bottom) / steps
    while True:
        threshold = max(threshold - step, bottom)
        step *= 2
        search.lower(threshold)
        if threshold <= bottom or not len(search.open) or all(
            threshold <= low or k <= np.count_nonzero(
                (search.score <= high) & (search.score >= max(low, threshold)))
            for high, low in windows
        ):
            break
    out = []
    for high, low in windows:
        inside = np.flatnonzero((search.score <= high) & (search.score >= low))
        ids, score = index.ids[search.found[inside]], search.score[inside]
        best = np.lexsort((ids, ~score))[:k]
        out.append((ids[best], score[best]))
    return out


def _search(dim: int, k: int, same_label: bool, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        for b in packed.slices(batches):
            shards = b.column(0).to_numpy()
            kinds = b.column(1).to_numpy()
            ids, labels = b.column(2).to_numpy(), b.column(3).to_numpy()
            vecs = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            windows = b.column(5).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            edge = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip(np.r_[0, edge], np.r_[edge, len(shards)], strict=True):
                if low == high:
                    continue
                if shards[low] != shard:
                    shard, held, index = shards[low], [], None
                if kinds[low] == 0:
                    held.append((ids[low:high], labels[low:high], vecs[low:high]))
                    continue
                if not held:
                    continue
                if index is None:
                    index = SuffixIndex(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for i in range(low, high):
                    allowed = np.flatnonzero(
                        ((index.labels == labels[i]) == same_label) & (index.ids != ids[i]))
                    asked = windows[i]
                    found = _windows_of(index, vecs[i], allowed,
                                        [(w["high"], w["low"]) for w in asked], k, steps)
                    for w, (hit, score) in zip(asked, found, strict=True):
                        out[0] += [ids[i]] * len(hit)
                        out[1] += [w["positive"]] * len(hit)
                        out[2] += [w["high"]] * len(hit)
                        out[3] += hit.tolist()
                        out[4] += score.tolist()
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out], schema=HITS)

    return run


def prepared(
    table: DataFrame, label: F.Column, scale: float, id_col: str, vec_col: str
) -> tuple[DataFrame, int]:
    """Rows (_id, _label, _vec) that take part, components as whole numbers, and the dimension."""
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(
        F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"),
        vec.alias("_vec"),
    )
    bad = F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(
        F.col("_id").isNotNull() & F.col("_label").isNotNull() & (F.size("_vec") > 0) & ~bad)
    found = rows.groupBy(F.size("_vec").alias("n")).count()
    best = found.orderBy(F.desc("count"), "n").limit(1).collect()
    dim = best[0][0] if best else 0
    rows = rows.where(F.size("_vec") == dim).groupBy("_id").agg(
        F.min(F.struct("_label", "_vec")).alias("_row")).select("_id", "_row._label", "_row._vec")

    def floor(x):
        scaled = x * F.lit(scale)
        small = F.abs(scaled) < F.lit(EXACT)
        return F.when(small, F.floor(scaled).cast("double")).otherwise(scaled)

    return rows.withColumn("_vec", F.transform("_vec", floor)), dim


def _threshold_join(
    rows: DataFrame, asked: DataFrame, dim: int, k: int, shards: int, same_label: bool,
) -> DataFrame:
    """Per anchor and window the k best rows of each shard, none that belongs to the result lost.

    ``asked`` has (_id, _label, _vec, _windows). The home shard of an anchor comes first; a window
    that is full there need not go below its k-th score elsewhere.
    """
    home = F.pmod(F.xxhash64("_id"), F.lit(shards))
    none = F.lit(None).cast("array<struct<positive:long, high:long, low:long>>")
    stored = rows.select(
        home.alias("_shard"), F.lit(0).alias("_kind"), "_id", "_label", "_vec",
        none.alias("_windows"))
    tasks = min(shards, packed.partitions(rows.sparkSession, 4))

    def hits(wanted: DataFrame, steps: int) -> DataFrame:
        both = stored.unionByName(wanted.select(
            "_shard", F.lit(1).alias("_kind"), "_id", "_label", "_vec", "_windows"))
        dealt = both.repartition(tasks, "_shard").sortWithinPartitions("_shard", "_kind", "_id")
        return dealt.mapInArrow(_search(dim, k, same_label, steps), HITS_DDL)

    at_home = cut_lineage(hits(asked.withColumn("_shard", home), STEPS), "hits")
    full = at_home.groupBy("anchor_id", "positive_id").agg(
        F.min("score").alias("_kth"), F.count("*").alias("_n")).where(F.col("_n") == k)
    full = full.groupBy(F.col("anchor_id").alias("_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("positive_id", "_kth"))).alias("_floors"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    raised = F.transform("_windows", lambda w: F.struct(
        w["positive"].alias("positive"), w["high"].alias("high"),
        F.greatest(w["low"], F.coalesce(F.try_element_at("_floors", w["positive"]), w["low"])
                   ).alias("low")))
    elsewhere = asked.join(full, "_id", "left").withColumn("_windows", raised).withColumn(
        "_shard", others).where(F.col("_shard") != home)
    return at_home.unionByName(hits(elsewhere, 1))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
    ratio: tuple[int, int] = (80, 100), scale: float = 256.0, id_col: str = "vec_id",
    vec_col: str = "embedding", label: F.Column | str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; a score is the whole-number inner product with the
    anchor, higher first, ties by smaller id. Positives are the first rows of the anchor's label
    but itself; negatives the first rows of other labels whose score lies between ``ratio`` of the
    positive's score and that score. ``anchors`` names the anchors by id.

    Rows with a NULL id, label or vector, an empty vector, a NULL or non-finite component, or a
    length other than the most frequent one (the smaller of two) take no part, also not as
    anchors. Of rows with equal ids the one with the least (label, vector) counts. An anchor without
    positives, or a positive without negatives, has no rows; a positive with a negative score has
    none, since its window is empty. Scores beyond 64 bits count as the nearest 64-bit number.
    """
    spark = packed.bounded_batches(table.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    rows, dim = prepared(table, label, scale, id_col, vec_col)
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")
    if dim == 0:
        return spark.createDataFrame([], schema)
    rows = cut_lineage(rows, "vectors")
    named = anchors.select(F.col(id_col).cast("long").alias("_id")).distinct()
    asked = cut_lineage(rows.join(named, "_id", "left_semi"), "anchors")
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    whole = F.array(F.struct(
        F.lit(0).cast("long").alias("positive"), F.lit(MOST).alias("high"),
        F.lit(LEAST).cast("long").alias("low")))
    near = _best(_threshold_join(
        rows, asked.withColumn("_windows", whole), dim, positives, shards, True), positives)
    near = cut_lineage(near.select(
        "anchor_id", F.col("vec_id").alias("positive_id"), "score"), "positives")
    below, above = ratio
    lowest = F.lit(below).cast("decimal(38,0)") * F.col("score")
    low = F.ceil(lowest / F.lit(above).cast("decimal(10,0)")).cast("long")
    windows = near.withColumn("_low", low).where(F.col("_low") <= F.col("score")).groupBy(
        F.col("anchor_id").alias("_id")
    ).agg(F.array_sort(F.collect_list(F.struct(  # at most ``positives`` of them
        F.col("positive_id").alias("positive"), F.col("score").alias("high"),
        F.col("_low").alias("low")))).alias("_windows"))
    hits = _threshold_join(
        rows, asked.join(windows, "_id"), dim, negatives, shards, False)
    return _best(hits, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
