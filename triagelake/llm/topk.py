"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Every shard is a block of rows by hash of their id. Its task builds a ball tree and serves its
leaves to each query in the order of their upper bound, centre product plus norm times radius;
a query stops when the bound of its next leaf falls below its k-th score so far. The k-th score
is shared: first every query searches one shard, and what it finds there is where all the other
shards begin to cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm import packed, vectors
from triagelake.session import cut_lineage

SHARD_ROWS = 8192
QUERY_BLOCK = 65536
LEAF = 64
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS_DDL = "query_id long, vec_id long, score long"
EXACT = float(1 << 53)
MOST = (1 << 63) - 1
#: Below every score.
NONE = -MOST - 1


def inner_products(queries: np.ndarray, vecs: np.ndarray, peak: float | None = None) -> np.ndarray:
    """Exact 64-bit products of whole-number vectors that come as doubles.

    ``peak`` is a known bound of the product of a component of each side. Products that doubles
    may not hold are summed in whole numbers of any length. What 64 bits do not hold is cut to
    the largest or smallest score, plus or minus 2^63 - 1.
    """
    if not len(queries) or not len(vecs):
        return np.zeros((len(queries), len(vecs)), dtype=np.int64)
    if peak is None:
        peak = float(np.abs(queries).max()) * float(np.abs(vecs).max())
    if peak * vecs.shape[1] < EXACT:
        return (queries @ vecs.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries) @ whole(vecs).T, -MOST, MOST).astype(np.int64)


class BallTree:
    """Leaves of at most ``LEAF`` rows with centre and radius, from halving along the widest axis."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [np.argsort(ids, kind="stable")]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append((ids[rows], vecs[rows]))
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                axis = int(np.argmax(vecs[rows].var(axis=0)))
            order = rows[np.argsort(vecs[rows, axis], kind="stable")]
            todo += [order[len(order) // 2:], order[:len(order) // 2]]
        self.peak = np.abs(vecs).max(initial=0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = np.array([v.mean(axis=0) for _, v in self.leaves])
            self.radius = np.array([
                np.sqrt(((v - c) ** 2).sum(axis=1).max())
                for (_, v), c in zip(self.leaves, self.centre, strict=True)
            ])
            self.reach = np.sqrt((self.centre ** 2).sum(axis=1)) + self.radius

    def search(self, query_id: np.ndarray, query: np.ndarray, floor: np.ndarray, k: int):
        """The k best of this tree per query that are not below its floor.

        Each query takes its leaves in the order of their bounds, in rounds of 1, 1, 2, 4 and so
        on leaves, and ends with the first bound below its k-th score. Within a round the queries
        that want the same leaf are multiplied with it together.
        """
        n = len(query)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((query ** 2).sum(axis=1))
            bound = query @ self.centre.T + norm[:, None] * self.radius[None, :]
            bound += 1e-9 * (1 + norm[:, None] * self.reach[None, :])
            peak = float(np.abs(query).max(initial=0) * self.peak)
        bound[np.isnan(bound)] = np.inf
        # a score beyond 2^53 may have been rounded up on its way here
        floor = np.where(np.abs(floor) < EXACT, floor, np.nextafter(floor, -np.inf))
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        score = np.full((n, k), NONE, dtype=np.int64)
        found = np.full((n, k), np.iinfo(np.int64).max)
        low, high = 0, 1
        while low < len(self.leaves):
            kth = score[:, k - 1].copy()
            least = np.maximum(floor, np.nextafter(kth.astype(float), -np.inf))
            who, at = np.nonzero(bound[:, low:high] >= least[:, None])
            if not len(who):
                break
            leaf = order[who, low + at]
            by_leaf = np.argsort(leaf, kind="stable")
            who, leaf = who[by_leaf], leaf[by_leaf]
            new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, m in zip(*packed.runs(leaf), strict=True):
                asking = who[a:a + m]
                ids, vecs = self.leaves[leaf[a]]
                got = inner_products(query[asking], vecs, peak)
                row, column = np.nonzero(
                    (got >= kth[asking][:, None]) & (got >= floor[asking][:, None]))
                row, column = _other(query_id[asking], ids, row, column)
                new.append((asking[row], got[row, column], ids[column]))
            self._merge(score, found, [np.concatenate(x) for x in zip(*new, strict=True)], k)
            low, high = high, 2 * high
        hit = (score != NONE) & (score >= floor[:, None])
        return np.repeat(query_id, hit.sum(axis=1)), found[hit], score[hit]

    @staticmethod
    def _merge(score: np.ndarray, found: np.ndarray, new: list[np.ndarray], k: int) -> None:
        """Puts new (query, score, id) rows among the k best of their queries."""
        touched = np.unique(new[0])
        who = np.concatenate([np.repeat(touched, k), new[0]])
        value = np.concatenate([score[touched].ravel(), new[1]])
        names = np.concatenate([found[touched].ravel(), new[2]])
        best = np.lexsort((names, ~value, who))  # ~: largest first, without overflow
        start, _ = packed.runs(who[best])
        best = best[(start[:, None] + np.arange(k)).ravel()]
        score[touched] = value[best].reshape(-1, k)
        found[touched] = names[best].reshape(-1, k)


def _other(query_id: np.ndarray, ids: np.ndarray, row: np.ndarray, column: np.ndarray):
    """Without the places where a query meets itself."""
    keep = query_id[row] != ids[column]
    return row[keep], column[keep]


def _search(dim: int, k: int):
    def run(batches):
        return vectors.by_block(
            packed.slices(batches), dim, BallTree,
            lambda tree, ids, vecs, floor: tree.search(ids, vecs, floor, k), HITS,
        )

    return run


def exact_top_k(
    table: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of every query.

    Components become ``floor(scale * x)``; scores are exact whole numbers, as far as 64 bits
    hold them (beyond, see ``inner_products``: they are cut, and so may tie). Ties go to the
    smaller id; a query never finds its own id; with fewer candidates there are fewer rows.
    Which rows take part, also among the queries, is told in ``vectors.usable``.
    """
    spark = packed.bounded_batches(table.sparkSession)
    rows, dim = vectors.usable(table, id_col, vec_col, nonzero=False)
    scaled = F.transform("_vec", lambda x: _floor(x * F.lit(scale)))
    rows = cut_lineage(rows.select("_id", scaled.alias("_vec")), "vectors")
    if dim == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = queries.select(F.col(id_col).cast("long").alias("_id")).distinct()
    asked = cut_lineage(rows.join(asked, "_id", "left_semi"), "queries")
    n, m = rows.count(), asked.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    blocks = max(1, math.ceil(m / QUERY_BLOCK))
    none = F.lit(None).cast("double")

    def block(shard, part):
        return shard * F.lit(blocks) + part

    home = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(shards))
    part = F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(blocks))
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    stored = rows.withColumn("_part", every_part).select(
        block(home, F.col("_part")).alias("_block"), F.lit(0).alias("_kind"), "_id", "_vec",
        none.alias("_bound"),
    )
    low = F.lit(float("-inf"))

    def hits(wanted: DataFrame) -> DataFrame:
        both = stored.unionByName(wanted.withColumn("_kind", F.lit(1)))
        tasks = min(shards * blocks, packed.partitions(spark, 4))
        return vectors.stream(both, tasks).mapInArrow(_search(dim, k), HITS_DDL)

    at_home = cut_lineage(hits(asked.select(
        block(home, part).alias("_block"), "_id", "_vec", low.alias("_bound")
    )), "hits")
    kth = at_home.groupBy("query_id").agg(
        F.min("score").cast("double").alias("_kth"), F.count("*").alias("_n")
    ).where(F.col("_n") == k).select(F.col("query_id").alias("_id"), "_kth")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    elsewhere = asked.join(kth, "_id", "left").withColumn("_shard", others).where(
        F.col("_shard") != home
    ).select(block(F.col("_shard"), part).alias("_block"), "_id", "_vec",
             F.coalesce("_kth", low).alias("_bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        at_home.unionByName(hits(elsewhere)).withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _floor(x):
    """Floor as a double, also beyond 64 bits, where every double is whole."""
    return F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x)
