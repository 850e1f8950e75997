"""Vector tables: which rows take part, and matrices from sorted Arrow streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM_DDL = "_block long, _kind int, _id long, _vec array<double>, _bound double"


def usable(
    table: DataFrame, id_col: str, vec_col: str, nonzero: bool
) -> tuple[DataFrame, int]:
    """Rows (_id, _vec) that take part, and their dimension (0 for an empty table).

    NULL ids, NULL or empty vectors, vectors with a NULL or non-finite component and, if asked,
    zero vectors take no part; nor do vectors whose length is not the most frequent one (the
    smaller of two equally frequent ones). Of rows with equal ids the least vector counts.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_vec"))
    bad = F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("_id").isNotNull() & (F.size("_vec") > 0) & ~bad)
    if nonzero:
        rows = rows.where(F.exists("_vec", lambda x: x != 0))
    found = rows.groupBy(F.size("_vec").alias("n")).count()
    best = found.orderBy(F.desc("count"), "n").limit(1).collect()
    dim = best[0][0] if best else 0
    rows = rows.where(F.size("_vec") == dim).groupBy("_id").agg(F.min("_vec").alias("_vec"))
    return rows, dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def by_block(
    batches: Iterator[pa.RecordBatch], dim: int,
    build: Callable[[np.ndarray, np.ndarray], object],
    search: Callable[[object, np.ndarray, np.ndarray, np.ndarray], tuple],
    schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    """Runs over rows sorted by (_block, _kind): vectors of a block first, then its queries.

    ``build`` gets the ids and vectors of a block once, ``search`` a batch of its queries at a
    time, so memory holds one block and one batch.
    """
    block, ids, vecs, built = None, [], [], None
    for b in batches:
        key = b.column(0).to_numpy()
        kind = b.column(1).to_numpy()
        row_id, bound = b.column(2).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
        vec = matrix(b.column(3), dim) if b.num_rows else np.zeros((0, dim))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
        for low, high in zip(np.r_[0, edge], np.r_[edge, len(key)], strict=True):
            if low == high:
                continue
            if key[low] != block:
                block, ids, vecs, built = key[low], [], [], None
            if kind[low] == 0:
                ids.append(row_id[low:high])
                vecs.append(vec[low:high])
                continue
            if not ids:
                continue
            if built is None:
                built = build(np.concatenate(ids), np.concatenate(vecs))
            columns = search(built, row_id[low:high], vec[low:high], bound[low:high])
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema)


def stream(rows: DataFrame, partitions: int) -> DataFrame:
    ordered = rows.select("_block", "_kind", "_id", "_vec", "_bound")
    return ordered.repartition(partitions, "_block").sortWithinPartitions("_block", "_kind", "_id")
