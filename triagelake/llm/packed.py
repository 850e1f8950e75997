"""Packed number columns: one Spark row carries the numbers of a whole batch for one key.

Spark still shuffles, groups and spills these rows; packing only saves the cost of a row object
for every single number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that reach a Python function at once; bounds its memory on long texts.
BATCH_ROWS = 512
#: Bytes of text that are encoded together.
GATHER_BYTES = 8 << 20
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def bounded_batches(spark: SparkSession) -> SparkSession:
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def partitions(spark: SparkSession, factor: int = 1) -> int:
    """A number of groups that follows the session's shuffle partitions."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def place(numbers: np.ndarray, n: int) -> np.ndarray:
    """Maps 64-bit numbers to 0..n-1; larger numbers never come earlier."""
    return (((numbers >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def read(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """All numbers of a packed column, row after row."""
    if isinstance(column, pa.Array):
        column = pa.chunked_array([column])
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for c in column.chunks for x in c]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by place: all lowest bytes first, so that small numbers compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def read_planes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """All numbers of a column of ``planes``, row after row."""
    if isinstance(column, pa.Array):
        column = pa.chunked_array([column])
    parts = [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T)
             .view("<u4").ravel() for c in column.chunks for x in c]
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def lengths(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """How many numbers of ``width`` bytes each row of a packed column has."""
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy().astype(np.int64) // width


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal neighbours."""
    if len(values) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return start, np.diff(np.r_[start, len(values)])


def batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The same rows in tables of about ``size`` bytes, or of one batch if that is larger."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def spliced(
    parts: list[bytes], codes: np.ndarray, edges: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``parts[code]`` one after the other, and where each row of codes ends.

    ``edges`` are the places in ``codes`` at which rows begin, and the end of the last one.
    """
    ends = np.cumsum([0, *map(len, parts)]) // width
    numbers = np.frombuffer(b"".join(parts), f"<u{width}")
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(numbers))
    found = lists.take(pa.array(codes))
    return found.values.to_numpy(), found.offsets.to_numpy()[edges]


def cut(data: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The bytes between neighbouring edges."""
    whole = memoryview(data).cast("B")
    places = (edges * data.itemsize).tolist()
    return [bytes(whole[low:high]) for low, high in pairwise(places)]
