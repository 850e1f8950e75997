"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is halved again and again into equal parts, whose means are the centroids of
the posting lists. Every vector goes to its nearest list and, if it lies near a boundary, to
further ones; of two lists in the same direction only the nearer takes it. Centroids are found
by best-first search on an in-memory neighbour graph, for rows and queries alike. A query reads,
of a given share of all lists, those whose centroid is at most a given ratio farther than its
nearest one, and ranks what it finds there by exact cosine. The share keeps recall from falling as
lists grow in number.

Lists longer than a block are cut into blocks by hash, and each block serves its queries alone,
so a vector that is copied very often makes more blocks, not a longer task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm import packed, vectors
from triagelake.session import cut_lineage


#: Centroids that a vector opens in one step of the graph search.
OPEN_AT_ONCE = 4


@dataclass(frozen=True)
class Settings:
    """``sample`` and ``max_lists`` bound what the driver holds and broadcasts.

    A query reads at most ``probe_share`` of all lists, but never fewer than ``probes``.
    """

    sample: int = 16384
    list_rows: int = 128
    max_lists: int = 8192
    degree: int = 24
    replicas: int = 6
    boundary_ratio: float = 1.25
    probes: int = 96
    probe_share: float = 0.25
    probe_ratio: float = 1.6
    beam: int = 128
    block_rows: int = 2048


def balanced_centroids(vecs: np.ndarray, lists: int) -> np.ndarray:
    """Unit means of parts of equal size, each cut across its longest direction."""
    todo, done = [(vecs, lists)], []
    while todo:
        rows, k = todo.pop()
        if k <= 1 or len(rows) < 2:
            done.append(rows.mean(axis=0))
            continue
        centred = rows - rows.mean(axis=0)
        axis = centred[int(np.argmax((centred ** 2).sum(axis=1)))]
        for _ in range(8):
            axis = centred.T @ (centred @ axis)
            axis /= max(np.sqrt((axis ** 2).sum()), 1e-300)
        order = np.argsort(centred @ axis, kind="stable")
        left = k // 2
        cut = max(1, min(len(rows) - 1, round(len(rows) * left / k)))
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], k - left)]
    centre = np.array(done)
    return centre / np.maximum(np.sqrt((centre ** 2).sum(axis=1, keepdims=True)), 1e-300)


def neighbour_graph(centre: np.ndarray, degree: int) -> np.ndarray:
    """The nearest other centroids of each, and a few far ones by number, as a matrix."""
    n = len(centre)
    near = min(degree, n - 1)
    out = np.zeros((n, near + 4), dtype=np.int64)
    for low in range(0, n, 512):
        dot = centre[low:low + 512] @ centre.T
        dot[np.arange(len(dot)), np.arange(low, low + len(dot))] = -np.inf
        if near:
            out[low:low + 512, :near] = np.argpartition(-dot, near - 1, axis=1)[:, :near]
    for j in range(4):
        out[:, near + j] = (np.arange(n) * 2 + j * (n // 4 + 1) + 1) % n
    return out


class CentroidGraph:
    """Best-first search of many vectors at once over the neighbour graph.

    Each vector has a beam of the nearest centroids it has met, and a mark for every one it has
    met at all. A step opens its nearest unopened ones, ``OPEN_AT_ONCE`` together, and merges their
    new neighbours into the beam; a vector is done when its whole beam is open.
    """

    def __init__(self, centre: np.ndarray, graph: np.ndarray):
        self.centre, self.graph = centre, graph
        self.entries = np.unique(np.linspace(0, len(centre) - 1, 8).astype(np.int64))

    def nearest(self, vecs: np.ndarray, want: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and squared distances of unit vectors, nearest first (unreached: infinite)."""
        n, lists = len(vecs), len(self.centre)
        beam, want = min(max(beam, want), lists), min(want, lists)
        name = np.zeros((n, beam), dtype=np.int64)
        dist = np.full((n, beam), np.inf)
        opened = np.ones((n, beam), dtype=bool)
        met = np.zeros((n, lists), dtype=bool)
        row = np.arange(n)
        near = np.broadcast_to(self.entries, (n, len(self.entries)))
        while len(row):
            near = np.sort(near, axis=1)
            new = ~met[row[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            met[row[:, None], near] = True
            at, column = np.nonzero(new)
            far = np.full(near.shape, np.inf)
            far[at, column] = 2 - 2 * np.einsum(
                "ik,ik->i", self.centre[near[at, column]], vecs[row[at]])
            names = np.concatenate([name[row], near], axis=1)
            every = np.concatenate([dist[row], far], axis=1)
            done = np.concatenate([opened[row], ~new], axis=1)
            best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            names, every, done = (np.take_along_axis(x, best, axis=1)
                                  for x in (names, every, done))
            go = ~done.all(axis=1)
            name[row], dist[row], opened[row] = names, every, done
            row, names, every, done = row[go], names[go], every[go], done[go]
            if not len(row):
                break
            width = min(OPEN_AT_ONCE, beam)
            pick = np.argpartition(np.where(done, np.inf, every), width - 1, axis=1)[:, :width]
            opened[row[:, None], pick] = True
            near = self.graph[np.take_along_axis(names, pick, axis=1)].reshape(len(row), -1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(name, order, axis=1), np.take_along_axis(dist, order, axis=1)


def boundary_lists(graph: CentroidGraph, vecs: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The lists each vector belongs to: the nearest, and near ones in other directions."""
    found, dist = graph.nearest(vecs, s.replicas * 3, s.beam)
    # what was not reached is infinitely far and never kept
    distance = np.sqrt(np.maximum(dist, 0))
    out = []
    for lists, d in zip(found, distance, strict=True):
        kept = [int(lists[0])]
        for j in range(1, len(lists)):
            if len(kept) == s.replicas or not d[j] <= s.boundary_ratio * d[0] + 1e-12:
                break
            apart = np.sqrt(np.maximum(
                2 - 2 * graph.centre[kept] @ graph.centre[lists[j]], 0))
            if (apart >= 0.5 * d[j]).all():
                kept.append(int(lists[j]))
        out.append(np.array(kept, dtype=np.int64))
    return out


def probed_lists(graph: CentroidGraph, vecs: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The lists each query reads: those within the distance ratio of its nearest one."""
    total = len(graph.centre)
    want = min(total, max(s.probes, math.ceil(s.probe_share * total)))
    found, dist = graph.nearest(vecs, want, s.beam)
    distance = np.sqrt(np.maximum(dist, 0))
    return [lists[(d <= s.probe_ratio * d[0] + 1e-12) & np.isfinite(d)]
            for lists, d in zip(found, distance, strict=True)]


ROUTED = pa.schema([("_list", pa.int64()), ("_id", pa.int64()),
                    ("_vec", pa.list_(pa.float64()))])
ROUTED_DDL = "_list long, _id long, _vec array<double>"
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
HITS_DDL = "query_id long, vec_id long, score double"


def _route(shared, choose, dim: int, s: Settings):
    def run(batches):
        centre, edges = shared.value
        graph = CentroidGraph(centre, edges)
        for b in packed.slices(batches, 256):
            if not b.num_rows:
                continue
            vecs = vectors.matrix(b.column(1), dim)
            unit = _unit(vecs)
            lists = choose(graph, unit, s)
            count = np.array([len(x) for x in lists])
            row = np.repeat(np.arange(len(vecs)), count)
            at = np.arange(0, (len(row) + 1) * dim, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(lists)), pa.array(b.column(0).to_numpy()[row]),
                pa.ListArray.from_arrays(pa.array(at), pa.array(vecs[row].ravel())),
            ], schema=ROUTED)

    return run


def _scaled(vecs: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component lies in 0.5 to 1.

    Cosines stay the same to the last bit, and squares neither overflow nor vanish.
    """
    _, exponent = np.frexp(np.abs(vecs).max(axis=1, initial=0.0))
    return np.ldexp(vecs, -exponent[:, None])


def _unit(vecs: np.ndarray) -> np.ndarray:
    vecs = _scaled(vecs)
    return vecs / np.sqrt((vecs ** 2).sum(axis=1, keepdims=True))


def _block(ids: np.ndarray, vecs: np.ndarray) -> tuple:
    vecs = _scaled(vecs)
    norm = np.sqrt((vecs * vecs).sum(axis=1))
    return ids, vecs, norm, vecs / norm[:, None]


def _nearest_in_block(k: int):
    def search(block, query_id, query, _):
        ids, vecs, norm, unit = block
        query = _scaled(query)
        size = np.sqrt((query * query).sum(axis=1))
        rough = (query / size[:, None]) @ unit.T
        rough[query_id[:, None] == ids[None, :]] = -np.inf
        kth = np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        row, col = np.nonzero((rough >= kth[:, None] - 1e-9) & np.isfinite(rough))
        score = (query[row] * vecs[col]).sum(axis=1) / (size[row] * norm[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        start, length = packed.runs(row)
        keep = np.arange(len(row)) - np.repeat(start, length) < k
        return query_id[row[keep]], ids[col[keep]], score[keep]

    return search


def nearest_neighbours(
    table: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(),
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found vectors of every query by cosine.

    All rows of ``table`` are indexed; only the centroids come from a sample. Scores are exact
    cosines in double precision, ties go to the smaller id, a query never finds its own id.
    Which rows take part is told in ``vectors.usable``; zero vectors do not. Recall is measured
    in the tests.
    """
    spark = packed.bounded_batches(table.sparkSession)
    rows, dim = vectors.usable(table, id_col, vec_col, nonzero=True)
    rows = cut_lineage(rows, "vectors")
    if dim == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, s = rows.count(), settings
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(s.sample).toArrow()
    sample = vectors.matrix(picked["_vec"], dim)
    sample = _unit(sample)
    lists = max(1, min(s.max_lists, round(n / s.list_rows), len(sample)))
    centre = balanced_centroids(sample, lists)
    shared = spark.sparkContext.broadcast((centre, neighbour_graph(centre, s.degree)))

    tasks = packed.partitions(spark)
    stored = cut_lineage(
        rows.repartition(tasks, "_id").mapInArrow(
            _route(shared, boundary_lists, dim, s), ROUTED_DDL), "lists"
    )
    asked = queries.select(F.col(id_col).cast("long").alias("_id")).distinct()
    asked = rows.join(asked, "_id", "left_semi")
    probing = asked.repartition(tasks, "_id").mapInArrow(
        _route(shared, probed_lists, dim, s), ROUTED_DDL
    )
    # at most ``max_lists`` rows
    sizes = F.broadcast(stored.groupBy("_list").agg(
        F.ceil(F.count("*") / s.block_rows).cast("long").alias("_blocks")
    ))
    name = F.col("_list") * F.lit(1 << 32)
    none = F.lit(None).cast("double").alias("_bound")
    held = stored.join(sizes, "_list").select(
        (name + F.pmod(F.xxhash64("_id"), F.col("_blocks"))).alias("_block"),
        F.lit(0).alias("_kind"), "_id", "_vec", none,
    )
    reading = probing.join(sizes, "_list").withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    ).select((name + F.col("_b")).alias("_block"), F.lit(1).alias("_kind"), "_id", "_vec", none)

    def run(batches):
        return vectors.by_block(
            packed.slices(batches), dim, _block, _nearest_in_block(k), HITS
        )

    hits = vectors.stream(held.unionByName(reading), tasks).mapInArrow(run, HITS_DDL)
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
