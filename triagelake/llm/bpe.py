"""Byte-level BPE encoding and decoding.

The merges of one piece of text run on a segment tree: its leaves are byte positions, each with
the rank of the pair that begins there, and every node keeps the leftmost least rank below it.
A merge reads the root, joins two live neighbours and updates the few leaves it touches, each
in logarithmic time, so a piece of any length costs n log n.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import packed
from triagelake.llm.memo import Memo

NEVER = 1 << 62
#: Pieces kept per Python worker and generation. Bounds memory, not results.
CACHE_PIECES = 400_000
CACHED_LENGTH = 64


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece; equal ranks merge from the left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    token: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1
    while width < n - 1:
        width *= 2
    tree = [NEVER] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    find = ranks.get
    while tree[1] != NEVER:
        i = tree[1] % width
        j = after[i]
        k = after[j]
        joined = token[i] + token[j]
        token[i], token[j], after[i] = joined, None, k
        changes = []
        if j < n - 1:
            changes.append((j, NEVER))
        if k < n:
            before[k] = i
            rank = find(joined + token[k])
            changes.append((i, NEVER if rank is None else rank * width + i))
        elif i < n - 1:
            changes.append((i, NEVER))
        h = before[i]
        if h >= 0:
            rank = find(token[h] + joined)
            changes.append((h, NEVER if rank is None else rank * width + h))
        for leaf, value in changes:
            node = width + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < value:
                    value = other
                if tree[node] == value:
                    break
                tree[node] = value
    return [ranks[t] for t in token if t is not None]


class Encoder(Memo):
    """Maps a piece of text to its ids as little-endian 32-bit numbers, and remembers it."""

    def __init__(self, path: str, pattern: str):
        super().__init__(CACHE_PIECES)
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())

    def make(self, piece: str) -> bytes:
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.pattern.findall(text) for text in texts]
        here = {p: self[p] if len(p) <= CACHED_LENGTH else self.make(p)
                for p in set().union(*pieces)}
        return [b"".join(map(here.__getitem__, found)) for found in pieces]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes that the ids of each row stand for."""
        ids = np.frombuffer(b"".join(rows), "<u4")
        if not len(ids):
            return [b""] * len(rows)
        _, places, data = self.tokens.take(pa.array(ids)).buffers()
        edges = np.cumsum([0, *map(len, rows)]) // 4
        return packed.cut(np.frombuffer(data or b"", np.uint8), np.frombuffer(places, "<i8")[edges])


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encode(path: str, pattern: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for b in packed.slices(batches, 256):
            ids = coder.encode([text or "" for text in b.column(1).to_pylist()])
            decoded = coder.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                schema=schema,
            )

    return run


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, ids, decoded): ids as little-endian 32-bit numbers, and the bytes they stand for.

    Every match of ``pattern`` is encoded for itself, without special tokens; the whole text is
    covered. NULL text counts as empty and has no ids. Rows are independent of each other, so
    there is no shuffle; repeated rows come out repeated, an empty table gives an empty one.
    ``ranks_path`` must exist on every executor.
    """
    packed.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
    return rows.mapInArrow(
        _encode(ranks_path, pattern, schema), "_id long, ids binary, decoded binary"
    ).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``text`` to rows with ids; ids that do not form a text become replacement signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)
        for b in packed.slices(batches, 256):
            at = b.schema.get_field_index(ids_col)
            rows = b.column(at).to_pylist()
            plain = coder.decode([x or b"" for x in rows])
            found = [None if x is None else text.decode("utf-8", "replace")
                     for x, text in zip(rows, plain, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "text"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, text string")
