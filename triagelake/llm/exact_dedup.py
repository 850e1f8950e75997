"""Exact duplicates of normalised texts by cuckoo filters over live digests.

A text without its blanks is a content, named by its SHA-256. Contents are dealt to parts by
their digest. A part has a cuckoo filter of 16-bit fingerprints and, beside it, the stored keys
with their contents. A key that the filter does not know is new and is inserted; one that it
knows is verified against the contents stored under that key, so a false hit costs a comparison
and never a wrong group. When the filter overflows it is rebuilt twice as large from the stored
keys. A live content has a number of copies: deleting the last one takes its fingerprint out.

Copies are merged within a task before the shuffle, so a group that holds a third of all rows
sends about one row per task to its part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import packed
from triagelake.session import cut_lineage

#: Deleted from a text before it is compared.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
SLOTS = 4
MAX_KICKS = 200
#: Rows and bytes of text that a part holds on average; the number of parts follows the data.
PART_ROWS = 4096
PART_BYTES = 16 << 20
#: Bytes of contents that a task keeps to merge copies before the shuffle.
MERGE_BYTES = 32 << 20


class CuckooFilter:
    """A set of 64-bit keys by 16-bit fingerprints, each in one of two buckets of four slots."""

    def __init__(self, buckets: int = 64, table: bytes | None = None):
        self.buckets = buckets
        self.slots = list(memoryview(table).cast("H")) if table else [0] * (buckets * SLOTS)
        self.turn = 0

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key & 0xFFFF) or 1
        first = (key >> 16) & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) & (self.buckets - 1)

    def _at(self, bucket: int, mark: int) -> int:
        low = bucket * SLOTS
        for i in range(low, low + SLOTS):
            if self.slots[i] == mark:
                return i
        return -1

    def __contains__(self, key: int) -> bool:
        mark, first, second = self._places(key)
        return self._at(first, mark) >= 0 or self._at(second, mark) >= 0

    def insert(self, key: int) -> bool:
        """False if no free slot was found; the filter must then be rebuilt larger."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            free = self._at(bucket, 0)
            if free >= 0:
                self.slots[free] = mark
                return True
        bucket = second
        for _ in range(MAX_KICKS):
            self.turn += 1
            i = bucket * SLOTS + self.turn % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            bucket = self._other(bucket, mark)
            free = self._at(bucket, 0)
            if free >= 0:
                self.slots[free] = mark
                return True
        return False

    def delete(self, key: int) -> None:
        """Takes out one fingerprint of a key that was inserted."""
        mark, first, second = self._places(key)
        i = self._at(first, mark)
        if i < 0:
            i = self._at(second, mark)
        if i >= 0:
            self.slots[i] = 0

    def table(self) -> bytes:
        return pa.array(self.slots, pa.uint16()).buffers()[1].to_pybytes()[:2 * len(self.slots)]


class Part:
    """The live contents of one part: a filter, and per key the contents stored under it.

    ``copies`` counts the live rows of a content, ``best`` is the least rank among them and
    ``ties`` the number of rows with that rank.
    """

    def __init__(self, key_bits: int = 64):
        self.filter = CuckooFilter()
        self.key_bits = key_bits
        self.stored: dict[int, list[list]] = {}
        self.resized = 0

    def key(self, digest: bytes) -> int:
        return int.from_bytes(digest[-8:], "little") & ((1 << self.key_bits) - 1)

    def find(self, digest: bytes, content: bytes) -> list | None:
        key = self.key(digest)
        if key not in self.filter:
            return None
        return next((e for e in self.stored.get(key, ()) if e[1] == content), None)

    def insert(self, digest: bytes, content: bytes, copies: int, best: tuple, ties: int) -> None:
        entry = self.find(digest, content)
        if entry is not None:
            entry[2] += copies
            if best == entry[3]:
                entry[4] += ties
            elif best < entry[3]:
                entry[3:] = [best, ties]
            return
        key = self.key(digest)
        self.stored.setdefault(key, []).append([digest, content, copies, best, ties])
        # one fingerprint per key: contents under an equal key are told apart by themselves
        if len(self.stored[key]) == 1 and not self.filter.insert(key):
            self.resize()

    def delete(self, digest: bytes, content: bytes, copies: int = 1) -> int:
        """Copies that were deleted; a content without live copies leaves the index."""
        entry = self.find(digest, content)
        if entry is None:
            return 0
        gone = min(copies, entry[2])
        entry[2] -= gone
        if not entry[2]:
            key = self.key(digest)
            self.stored[key].remove(entry)
            if not self.stored[key]:
                del self.stored[key]
                self.filter.delete(key)
        return gone

    def resize(self) -> None:
        """A larger filter, filled from the stored keys."""
        size = self.filter.buckets
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            self.resized += 1
            if all(self.filter.insert(key) for key in self.stored):
                return

    def entries(self) -> Iterator[list]:
        for same in self.stored.values():
            yield from same


def _contents(column: pa.Array) -> list[bytes]:
    """Texts without blanks; null is empty."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    return [x.translate(None, BLANKS) for x in values.to_pylist()]


def _lengths(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.utf8_length(column), 0).to_pylist()


NO_ID = (1 << 63) - 1
LEADS_DDL = "_digest binary, _content binary, _copies long, _chars long, _id long, _ties long"
LEADS = pa.schema([
    ("_digest", pa.binary()), ("_content", pa.binary()), ("_copies", pa.int64()),
    ("_chars", pa.int64()), ("_id", pa.int64()), ("_ties", pa.int64()),
])
ROWS_DDL = "_row long, _id long, _chars long, _digest binary"
ROWS = pa.schema([("_row", pa.int64()), ("_id", pa.int64()), ("_chars", pa.int64()),
                  ("_digest", pa.binary())])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per different content of a task, with its copies and the best of them.

    Of the rank (code points, id) the larger, then the smaller is better; no id comes last. When
    the kept contents reach MERGE_BYTES, those seen once go out and repeated ones stay.
    """
    kept: dict[bytes, list] = {}
    size = 0

    def out(leave):
        rows = {c: e for c, e in kept.items() if not leave(e)}
        for c in rows:
            del kept[c]
        return packed.batch({
            "_digest": [hashlib.sha256(c).digest() for c in rows], "_content": list(rows),
            "_copies": [e[0] for e in rows.values()], "_chars": [-e[1][0] for e in rows.values()],
            "_id": [e[1][1] for e in rows.values()], "_ties": [e[2] for e in rows.values()],
        }, LEADS)

    for b in batches:
        ids = pc.fill_null(b.column(0), NO_ID).to_pylist()
        for i, n, content in zip(ids, _lengths(b.column(1)), _contents(b.column(1)), strict=True):
            best = (-n, i)
            entry = kept.get(content)
            if entry is None:
                kept[content] = [1, best, 1]
                size += len(content)
                continue
            entry[0] += 1
            if best == entry[1]:
                entry[2] += 1
            elif best < entry[1]:
                entry[1:] = [best, 1]
        if size > MERGE_BYTES:
            yield out(lambda e: e[0] > 1)
            size = sum(map(len, kept))
            if size > MERGE_BYTES // 2:
                yield out(lambda e: False)
                size = 0
    if kept:
        yield out(lambda e: False)


def _row_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256(c).digest() for c in _contents(b.column(2))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(_lengths(b.column(2)), pa.int64()),
             pa.array(digests, pa.binary())], schema=ROWS)


GROUPS_DDL = "_digest binary, _copies long, _best_chars long, _best_id long, _ties long"
GROUPS = pa.schema([("_digest", pa.binary()), ("_copies", pa.int64()),
                    ("_best_chars", pa.int64()), ("_best_id", pa.int64()), ("_ties", pa.int64())])


def _group(key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, Part(key_bits)

        def done():
            rows = list(part.entries())
            names = [e[0] for e in rows]
            if len(set(names)) != len(names):
                raise ValueError("two different contents have one SHA-256")
            return packed.batch({
                "_digest": names, "_copies": [e[2] for e in rows],
                "_best_chars": [-e[3][0] for e in rows], "_best_id": [e[3][1] for e in rows],
                "_ties": [e[4] for e in rows]}, GROUPS)

        for b in batches:
            for p, digest, content, copies, chars, i, ties in zip(
                    *(b.column(k).to_pylist() for k in range(7)), strict=True):
                if p != at:
                    if at is not None:
                        yield done()
                    at, part = p, Part(key_bits)
                part.insert(digest, content, copies, (-chars, i), ties)
        if at is not None:
            yield done()

    return run


def _parts(docs: DataFrame, text_col: str) -> int:
    """Parts by rows and bytes of the table, so that each stays small at any size."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return max(1, math.ceil(n / PART_ROWS), math.ceil(size / PART_BYTES))


def _part_of(digest, parts: int):
    return F.pmod(F.xxhash64(digest), F.lit(parts)).cast("int")


def _by_part(rows: DataFrame, parts: int, *order) -> DataFrame:
    """Rows of a part one after the other; a task may have many parts and holds one at a time."""
    tasks = min(parts, packed.partitions(rows.sparkSession, 4))
    return rows.repartition(tasks, "_part").sortWithinPartitions("_part", *order)


def live_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64,
) -> DataFrame:
    """One row per different content: digest, copies, and the best row's length and id."""
    packed.bounded_batches(docs.sparkSession)
    parts = _parts(docs, text_col)
    leads = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    leads = leads.mapInArrow(_leads, LEADS_DDL).withColumn("_part", _part_of("_digest", parts))
    dealt = _by_part(leads.select("_part", *LEADS.names), parts)
    return dealt.mapInArrow(_group(key_bits), GROUPS_DDL)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64,
) -> DataFrame:
    """Every row with the row of its group that stays.

    Texts are equal if they are identical without blanks (space and 09 to 0D); NULL counts as
    empty, so empty, blank and missing texts are one group. The row with most code points stays,
    then the smallest id; rows without an id come last, and of rows equal in both one stays.
    Returns (id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``, ids as
    64-bit numbers; other columns are not looked at. An empty table gives an empty one.

    ``key_bits`` narrows the keys of the index; results do not depend on it, since hits are
    verified against contents. Contents are named by their whole SHA-256 in the last join; two
    different ones with one name, which nobody has seen, would end the job.
    """
    packed.bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
    )
    rows = cut_lineage(rows.mapInArrow(_row_digests, ROWS_DDL), "digests")
    groups = cut_lineage(live_groups(docs, id_col, text_col, key_bits), "groups")
    # a content with one copy needs no partner; adaptive execution splits a hot digest here
    copied = groups.where(F.col("_copies") > 1).hint("merge")
    both = rows.join(copied, "_digest", "left")
    rank = F.coalesce(F.col("_id"), F.lit(NO_ID))
    best = (F.col("_chars") == F.col("_best_chars")) & (rank == F.col("_best_id"))
    # repeated rows: where several have the best rank, the first of them stays
    tied = groups.where(F.col("_ties") > 1)
    if tied.isEmpty():
        both = both.withColumn("_first", F.lit(None).cast("long"))
    else:
        first = rows.join(tied.hint("merge"), "_digest").where(best).groupBy("_digest").agg(
            F.min("_row").alias("_first"))
        both = both.join(first.hint("merge"), "_digest", "left")
    single = F.col("_copies").isNull()
    kept = single | (best & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True)))
    keep_id = F.when(single, F.col("_id")).otherwise(
        F.when(F.col("_best_id") != NO_ID, F.col("_best_id")))
    return both.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce("_copies", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


INDEX_DDL = "_part int, _digest binary, _content binary, _copies long, _filter binary"
INDEX = pa.schema([
    ("_part", pa.int32()), ("_digest", pa.binary()), ("_content", pa.binary()),
    ("_copies", pa.int64()), ("_filter", pa.binary()),
])


def _change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows of a part first, then insertions, then deletions; out comes the part."""
    at, part = None, Part()

    def done():
        rows = list(part.entries())
        yield packed.batch({
            "_part": [at] * (len(rows) + 1), "_digest": [None, *(e[0] for e in rows)],
            "_content": [None, *(e[1] for e in rows)], "_copies": [0, *(e[2] for e in rows)],
            "_filter": [part.filter.table(), *[None] * len(rows)]}, INDEX)

    for b in batches:
        for p, step, digest, content, copies, table in zip(
                *(b.column(k).to_pylist() for k in range(6)), strict=True):
            if p != at:
                if at is not None:
                    yield from done()
                at, part = p, Part()
            if table is not None:  # the filter as it was stored; its keys follow
                part.filter = CuckooFilter(len(table) // (2 * SLOTS), table)
            elif step == 0:
                part.stored.setdefault(part.key(digest), []).append(
                    [digest, content, copies, (0, 0), 0])
            elif step == 1:
                part.insert(digest, content, copies, (0, 0), 0)
            else:
                part.delete(digest, content, copies)
    if at is not None:
        yield from done()


def change_index(
    index: DataFrame | None, inserts: DataFrame | None, deletes: DataFrame | None,
    parts: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The index of live contents after insertions and then deletions.

    Per part one row holds the filter, the others its contents with their live copies. ``index``
    is what an earlier call returned with the same ``parts``, or None. Deleting a text that is
    not in the index changes nothing. The result is written to the shared folder.
    """
    pieces = []
    given = [d for d in (index, inserts, deletes) if d is not None]
    packed.bounded_batches(given[0].sparkSession)
    if index is not None:
        pieces.append(index.select(
            "_part", F.lit(0).alias("_step"), "_digest", "_content", "_copies", "_filter"))
    for step, docs in ((1, inserts), (2, deletes)):
        if docs is None:
            continue
        leads = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
            _leads, LEADS_DDL)
        pieces.append(leads.select(
            _part_of("_digest", parts).alias("_part"), F.lit(step).alias("_step"), "_digest",
            "_content", "_copies", F.lit(None).cast("binary").alias("_filter")))
    rows = pieces[0]
    for more in pieces[1:]:
        rows = rows.unionByName(more)
    first = F.when(F.col("_filter").isNull(), F.lit(1)).otherwise(F.lit(0))
    dealt = _by_part(rows, parts, "_step", first)
    return cut_lineage(dealt.mapInArrow(_change, INDEX_DDL), "index")


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, part = None, Part()
    schema = pa.schema([("_id", pa.int64()), ("copies", pa.int64())])
    for b in batches:
        ids, copies = [], []
        for p, step, digest, content, n, table, i in zip(
                *(b.column(k).to_pylist() for k in range(7)), strict=True):
            if p != at:
                at, part = p, Part()
            if table is not None:
                part.filter = CuckooFilter(len(table) // (2 * SLOTS), table)
            elif step == 0:
                part.stored.setdefault(part.key(digest), []).append(
                    [digest, content, n, (0, 0), 0])
            else:
                entry = part.find(digest, content)
                ids.append(i)
                copies.append(entry[2] if entry else 0)
        if ids:
            yield packed.batch({"_id": ids, "copies": copies}, schema)


def look_up(
    index: DataFrame, docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, copies): the live copies of every text, 0 where the index has none."""
    packed.bounded_batches(docs.sparkSession)

    def asked(batches):
        for b in batches:
            contents = _contents(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(c).digest() for c in contents], pa.binary()),
                 pa.array(contents, pa.binary()), b.column(0)],
                names=["_digest", "_content", "_id"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        asked, "_digest binary, _content binary, _id long")
    rows = rows.select(
        _part_of("_digest", parts).alias("_part"), F.lit(1).alias("_step"), "_digest", "_content",
        F.lit(0).cast("long").alias("_copies"), F.lit(None).cast("binary").alias("_filter"), "_id")
    stored = index.select(
        "_part", F.lit(0).alias("_step"), "_digest", "_content", "_copies", "_filter",
        F.lit(None).cast("long").alias("_id"))
    first = F.when(F.col("_filter").isNull(), F.lit(1)).otherwise(F.lit(0))
    dealt = _by_part(stored.unionByName(rows), parts, "_step", first)
    return dealt.mapInArrow(_look, "_id long, copies long").withColumnRenamed("_id", id_col)
