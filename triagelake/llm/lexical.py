"""Ranked lexical search: short lists term at a time, long lists document at a time.

Documents become packed postings of the terms that a block of queries asks for; counts of
documents, terms and lists come from all of them. A task takes its documents in shards and turns
each into lists by term. For a query, the short lists are summed into accumulators first (term at
a time); the accumulators then act as one more list, bounded by their largest sum, in a
document-at-a-time pass over the long lists: lists whose bounds together stay below the k-th score
so far give no candidates and are only looked up for the candidates of the others, and a candidate
is dropped as soon as what is left cannot lift it. The k-th scores of a task carry over from shard
to shard, so later shards skip more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm import packed, words
from triagelake.session import cut_lineage

#: Documents that a task searches at a time.
SHARD_DOCS = 8192
#: Documents of one step of the document-at-a-time pass.
STEP_DOCS = 2048
#: Lists up to this many postings in a shard are short, and so many postings are summed at most.
SHORT_LIST = 64
SUMMED = 2048
#: Terms of the queries that are searched together; they travel to every task.
BLOCK_TERMS = 1 << 18
NO_ID = np.iinfo(np.int64).max

POSTINGS = pa.schema([
    ("_id", pa.int64()), ("_n", pa.int64()), ("_codes", pa.binary()), ("_tfs", pa.binary()),
])
POSTINGS_DDL = "_id long, _n long, _codes binary, _tfs binary"
HITS = pa.schema([("_query", pa.int64()), ("_id", pa.int64()), ("score", pa.int64())])
HITS_DDL = "_query long, _id long, score long"
ASKED_DDL = "_query long, _terms binary"


def _term_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, its terms as packed numbers, with repeats)."""
    for b in batches:
        found = words.split(b.column(1), words.WORD_BYTES)
        numbers = found.numbers()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(packed.cut(numbers, found.first), pa.binary())],
            names=["_query", "_terms"])


def _postings(terms: np.ndarray):
    """Per document its length and how often it holds each of the sorted ``terms``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packed.slices(batches):
            found = words.split(b.column(1), words.WORD_BYTES)
            numbers, rows = found.numbers(), found.rows()
            code = np.searchsorted(terms, numbers)
            known = code < len(terms)
            known[known] = terms[code[known]] == numbers[known]
            pair = rows[known] * np.int64(len(terms) + 1) + code[known]
            pair, tf = np.unique(pair, return_counts=True)
            row = pair // (len(terms) + 1)
            edges = np.searchsorted(row, np.arange(b.num_rows + 1))
            codes = (pair % (len(terms) + 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(found.counts, pa.int64()),
                pa.array(packed.cut(codes, edges), pa.binary()),
                pa.array(packed.cut(tf.astype("<u4"), edges), pa.binary()),
            ], schema=POSTINGS)

    return run


def _frequencies(size: int):
    """How many documents of a task hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(packed.read(b.column(0), "<u4"), minlength=size)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], names=["code", "df"])

    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """The lists of some documents by term, documents in the order of their ids."""

    def __init__(self, ids, n, codes, tfs, doc, n_docs: int, n_terms: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        length = 25 + (75 * n[doc] * n_docs) // n_terms
        value = (1_000_000_000 * tfs) // (1000 * tfs + 8 * length)
        by_term = np.lexsort((place[doc], codes))
        self.docs, self.value = place[doc][by_term], value[by_term]
        start, size = packed.runs(codes[by_term])
        found = codes[by_term][start] if len(start) else np.zeros(0, np.int64)
        self.lists = {int(c): (int(a), int(a + m)) for c, a, m in zip(
            found, start, size, strict=True)}
        self.most = np.maximum.reduceat(self.value, start) if len(start) else np.zeros(0, np.int64)
        self.most = {int(c): int(x) for c, x in zip(found, self.most, strict=True)}

    def part(self, code: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and values of a list with ``low <= document < high``."""
        a, b = self.lists[code]
        if (low, high) != (0, len(self.ids)):
            a, b = a + np.searchsorted(self.docs[a:b], (low, high))
        return self.docs[a:b], self.value[a:b]

    def accumulators(self, lists: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores of the documents on some lists, in document order."""
        docs = [np.zeros(0, np.int64)]
        scores = [np.zeros(0, np.int64)]
        for code, weight in lists:
            a, b = self.lists[code]
            docs.append(self.docs[a:b])
            scores.append(self.value[a:b] * weight)
        found, where = np.unique(np.concatenate(docs), return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, where, np.concatenate(scores))
        return found, total

    def search(self, query: list[tuple[int, int]], best: Best) -> None:
        """Offers every document of the shard that may be among the k best of a query."""
        present = [(c, w) for c, w in query if c in self.lists and w > 0]
        present.sort(key=lambda t: self.lists[t[0]][1] - self.lists[t[0]][0])
        summed, used = 0, 0
        for code, _ in present:
            a, b = self.lists[code]
            if b - a > SHORT_LIST or used + b - a > SUMMED:
                break
            summed, used = summed + 1, used + b - a
        acc_docs, acc_score = self.accumulators(present[:summed])
        # one bounded list for the accumulators, then the long ones; the largest bounds first
        sources = [(int(acc_score.max()), None, 1)] if len(acc_docs) else []
        sources += [(w * self.most[c], c, w) for c, w in present[summed:]]
        sources.sort(key=lambda s: -s[0])
        rest = np.cumsum([0, *(s[0] for s in reversed(sources))])[::-1]

        def part(source, low, high):
            _, code, weight = source
            if code is None:
                a, b = np.searchsorted(acc_docs, (low, high))
                return acc_docs[a:b], acc_score[a:b]
            docs, value = self.part(code, low, high)
            return docs, value * weight

        size = len(self.ids)
        for low in range(0, size, STEP_DOCS):
            high = min(size, low + STEP_DOCS)
            floor = max(best.floor, 1)
            # candidates come from the first lists alone: the others together stay below the floor
            leading = int(np.count_nonzero(rest[:-1] >= floor))
            if not leading:
                break
            total = np.zeros(high - low, dtype=np.int64)
            for source in sources[:leading]:
                docs, score = part(source, low, high)
                total[docs - low] += score
            doc = np.flatnonzero(total + rest[leading] >= floor)
            total = total[doc]
            for at in range(leading, len(sources)):
                if not len(doc):
                    break
                docs, score = part(sources[at], low, high)
                if len(docs):
                    where = np.minimum(np.searchsorted(docs, doc + low), len(docs) - 1)
                    total = total + np.where(docs[where] == doc + low, score[where], 0)
                alive = total + rest[at + 1] >= floor
                doc, total = doc[alive], total[alive]
            alive = total >= floor
            if alive.any():
                best.offer(self.ids[doc[alive] + low], total[alive])


class Best:
    """The k highest scores of a query so far, ties by the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.ids = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def offer(self, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        top = np.lexsort((ids, -score))[:self.k]
        self.ids, self.score = ids[top], score[top]


def _search(queries: list[tuple[int, list[tuple[int, int]]]], k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]

        def shard(held):
            table = pa.Table.from_batches(held)
            ids = table.column(0).combine_chunks().fill_null(NO_ID).to_numpy()
            n = table.column(1).combine_chunks().to_numpy()
            doc = np.repeat(np.arange(len(ids)), packed.lengths(table.column(2), 4))
            codes = packed.read(table.column(2), "<u4").astype(np.int64)
            tfs = packed.read(table.column(3), "<u4").astype(np.int64)
            built = Shard(ids, n, codes, tfs, doc, n_docs, n_terms)
            for (_, query), found in zip(queries, best, strict=True):
                built.search(query, found)

        held, rows = [], 0
        for b in packed.slices(batches, SHARD_DOCS):
            if rows + b.num_rows > SHARD_DOCS:
                shard(held)
                held, rows = [], 0
            held.append(b)
            rows += b.num_rows
        if held:
            shard(held)
        names = np.repeat([q for q, _ in queries], [len(b.ids) for b in best]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])
        score = np.concatenate([np.zeros(0, np.int64), *(b.score for b in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(ids, mask=ids == NO_ID), pa.array(score)], schema=HITS)

    return run


def _block_hits(docs: DataFrame, asked: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Hits of a block of queries: postings of its terms, their counts, then the search."""
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in asked)]))
    postings = docs.mapInArrow(_postings(terms), POSTINGS_DDL).where(F.col("_n") > 0)
    postings = cut_lineage(postings, "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    counted = postings.select("_codes").mapInArrow(_frequencies(len(terms)), "code long, df long")
    df = dict(counted.groupBy("code").agg(F.sum("df")).collect())  # at most the block's terms
    queries = []
    for row, numbers in asked:
        found, repeats = np.unique(np.searchsorted(terms, numbers), return_counts=True)
        queries.append((row, [
            (int(c), int(r) * term_weight(n_docs, df[c]))
            for c, r in zip(found, repeats, strict=True) if c in df
        ]))
    held = postings.where(F.octet_length("_codes") > 0)
    return held.mapInArrow(_search(queries, k, n_docs, n_terms), HITS_DDL)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item.

    Terms are runs of ASCII letters and digits and of all characters outside ASCII, A-Z in lower
    case; they are compared by 64-bit numbers. Weights, lengths and scores are whole numbers as
    the module's formulas say; repeated terms of an item count again. Equal scores go by id,
    documents without an id last. Every row of ``docs`` is a document of its own, also under a
    repeated id, and every row of ``items`` a query; NULL texts, and items none of whose terms
    occurs, find nothing. Empty tables give an empty result; other columns are not looked at.

    Items are searched in blocks of about ``block_terms`` terms, which is what travels to the
    tasks; each block reads the documents once. The number of items is not limited.
    """
    spark = packed.bounded_batches(docs.sparkSession)
    rows = items.select(
        F.monotonically_increasing_id().alias("_query"), F.col(item_col),
        F.col(item_text_col).cast("string").alias("_text"),
    )
    rows = cut_lineage(rows, "items")
    asked = cut_lineage(
        rows.select("_query", "_text").mapInArrow(_term_numbers, ASKED_DDL), "asked")
    size = asked.agg(F.sum(F.octet_length("_terms"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 8 / block_terms))
    texts = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    hits = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("_query"), F.lit(blocks)) == block)
        found = [(r[0], np.frombuffer(r[1], "<u8")) for r in mine.toLocalIterator() if r[1]]
        if found:
            part = _block_hits(texts, sorted(found, key=lambda q: q[0]), k)
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], HITS_DDL)
    order = Window.partitionBy("_query").orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select("_query", F.col(item_col).alias("_item")), "_query").select(
        F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
