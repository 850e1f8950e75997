"""Token ids as length-delimited binary records, with a separate offset index.

One file holds the documents of one range of ids in ascending order. A record is

    length of the body (8 bytes) | masked checksum of these 8 bytes (4) |
    body | masked checksum of the body (4) | end of record (1 byte, 0A)

all little-endian, where the body is a flag byte (1 if the id is missing), the document id
(8 bytes), the bytes per token (1 byte) and the token ids. The mask rotates a CRC-32 by 15 bits
and adds a constant, so that a checksum of data that holds checksums stays sound. Spark's own
committer writes the files, so a lost task leaves nothing half-written, on any file system.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm import packed
from triagelake.llm.memo import Memo

FILE_BYTES = 64 << 20
#: Runs kept per Python worker and generation, and their greatest length.
CACHE_RUNS = 300_000
CACHED_LENGTH = 64
#: Fixed values of the tokenizer: its splitting rule, for signs it does not otherwise change.
PLAIN_RUN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Fixed value of the record format.
MASK_DELTA = 0xA282EAD8
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<BqB")
RECORDS = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids", pa.binary()),
])
RECORDS_DDL = ("file string, offset long, length long, _id long, n_tokens long, before long, "
               "ids binary")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A record without its last byte, which the writer adds."""
    body = BODY.pack(doc_id is None, doc_id or 0, width) + ids
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(size)), body, struct.pack("<I", masked(body))))


def unframe(data: memoryview, at: int) -> tuple[int, int | None, bytes]:
    """Length of the record at ``at``, its document id, and its ids as 32-bit numbers."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at:at + 8])) != check:
        raise ValueError(f"broken record length at byte {at}")
    low = at + HEAD.size
    body = bytes(data[low:low + size])
    if len(body) != size or struct.unpack_from("<I", data, low + size)[0] != masked(body):
        raise ValueError(f"broken record at byte {at}")
    missing, doc_id, width = BODY.unpack_from(body)
    ids = np.frombuffer(body, f"<u{width}", offset=BODY.size).astype("<u4").tobytes()
    return HEAD.size + size + 5, None if missing else doc_id, ids


def byte_signs() -> dict[int, str]:
    """The printable sign that a byte-level vocabulary writes for every byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(others)}


class WordIds(Memo):
    """Ids of a run of characters without blank, encoded by the library and remembered.

    The tokenizer works on such runs one by one: neither its normalizer nor its splitting
    rule reaches over a blank or a line break. Runs of ASCII signs and Latin-1 letters, which
    its normalizer only lower-cases, are split here by its rule and their pieces go to the
    library's merges alone; all other runs go to the whole tokenizer. With ``added``, so do runs
    that hold an added token such as an end marker, which then gets its own id as in the library;
    without, it is text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        super().__init__(CACHE_RUNS)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        names = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, names))) if added and names else None
        self.merges = self.library.model.tokenize
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.signs = byte_signs()

    def make(self, run: str) -> bytes:
        if run.isascii() and run.isalpha():
            return self.piece(run.lower())
        if PLAIN_RUN.fullmatch(run) and not (self.added and self.added.search(run)):
            return b"".join(map(self.piece, PLAIN_PIECE.findall(run.lower())))
        return array(self.code, self.library.encode(run, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.signs)
        return array(self.code, [token.id for token in self.merges(piece)]).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text; the distinct runs of all texts are looked up once."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        runs = split.flatten().dictionary_encode()
        found = [self[run] if len(run) <= CACHED_LENGTH else self.make(run)
                 for run in runs.dictionary.to_pylist()]
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        return packed.cut(*packed.spliced(found, runs.indices.to_numpy(), edges, self.width))


@cache
def word_ids(path: str, added: bool = False) -> WordIds:
    return WordIds(path, added)


def _encode_frames(path: str, end_id: int):
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path, added=True)
        end = np.array([end_id], dtype=f"<u{coder.width}").tobytes()
        for rows in packed.gathered(batches, packed.GATHER_BYTES):
            ids = coder.encode(pc.fill_null(rows["text"].combine_chunks(), ""))
            frames = [frame(i, x + end, coder.width)
                      for i, x in zip(rows["_id"].to_pylist(), ids, strict=True)]
            for low in range(0, len(frames), packed.BATCH_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(frames[low:low + packed.BATCH_ROWS], pa.binary())], schema=schema)

    return run


def write_records(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES,
) -> None:
    """Writes ``path/records`` (one file per id range) and ``path/index`` (one row per record).

    NULL text counts as empty: a record with the end id only. A missing id comes first. Rows
    with equal ids follow each other by the checksum of their text, and may be split over two
    files. File names sort in the order of the ids.
    """
    spark = packed.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(packed.partitions(spark), math.ceil(size / file_bytes))
    order = ["_id", "tie"]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(
        files, *order).sortWithinPartitions(*order)
    records = ordered.select("_id", "text").mapInArrow(
        _encode_frames(tokenizer_path, end_id), "record binary"
    )
    records.select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\n").text(f"{path}/records")
    read_records(spark, path, with_ids=False).drop("ids").write.parquet(f"{path}/index")


def _parse(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, at, before = memoryview(content.as_buffer()), 0, 0
                rows: list[tuple] = []
                while at < len(data):
                    length, doc_id, ids = unframe(data, at)
                    n = len(ids) // 4
                    rows.append((file, at, length, doc_id, n, before, ids if with_ids else None))
                    at, before = at + length, before + n
                    if len(rows) == packed.BATCH_ROWS or at >= len(data):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS,
                                                                 strict=True)], schema=RECORDS)
                        rows = []

    return run


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(file, offset, length, _id, n_tokens, before, ids) of every record, checksums verified.

    ``before`` counts the ids of the records ahead in the same file; ``ids`` is NULL if not
    asked for.
    """
    packed.bounded_batches(spark)
    files = spark.read.format("binaryFile").load(f"{path}/records")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.col("length") > 0).select(name.alias("file"), "content").mapInArrow(
        _parse(with_ids), RECORDS_DDL
    )


def with_start(records: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records ahead, over all files."""
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select(
        "file", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base")
    )
    return records.join(files, "file").withColumn("start", F.col("_base") + F.col("before")).drop(
        "_base"
    )


def shuffled_records(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """(_id, n_tokens, ids) in a random order that the seed fixes, read by the offset index."""
    packed.bounded_batches(spark)
    index = spark.read.parquet(f"{path}/index")
    wanted = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    files = spark.read.format("binaryFile").load(f"{path}/records")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for offsets, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(content.as_buffer())
                for low in range(0, len(offsets), packed.BATCH_ROWS):
                    found = [unframe(data, at) for at in offsets[low:low + packed.BATCH_ROWS]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[1] for x in found], pa.int64()),
                         pa.array([len(x[2]) // 4 for x in found], pa.int64()),
                         pa.array([x[2] for x in found], pa.binary())], schema=schema)

    rows = files.join(wanted, "file").select("offsets", "content").mapInArrow(
        run, "_id long, n_tokens long, ids binary")
    return rows.orderBy(F.xxhash64("_id", F.lit(seed)))
