"""N-gram Jaccard join by vertical partitioning.

The order of all n-grams (by their number) is cut into fragments. Every fragment holds
the part of each document's set that falls into it, and counts alone how many of these n-grams
any other set shares; the partial counts are summed per document. A document of size n whose
sum stays below ``threshold * n`` can have no partner and is out, whoever the others are.

Survivors run through the fragments once more among themselves, which leaves the exact document
frequency of every n-gram. With rarest n-grams first, two sets can only be linked if they meet
in their prefixes. Candidates are verified by partial overlaps: one row per pair and fragment,
summed per pair.

Links of all pairs come from ``jaccard_links``. Components need fewer of them, so for these large
groups cost no all-pairs step. Equal sets are one set from the start. Each survivor is
first checked against one set only, the least peculiar one it meets; what is linked that way is
already one component, and then only pairs between different components are looked at. No pair
that could join two components is skipped, so the components are exact. Two n-grams count as
equal when their 56-bit numbers are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm import packed, words
from triagelake.llm.components import components
from triagelake.session import cut_lineage

SEGMENTS = pa.schema([
    ("part", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()),
    ("counts", pa.binary()), ("base", pa.int64()), ("grams", pa.binary()), ("freqs", pa.binary()),
])
SEGMENTS_DDL = ("part int, ids binary, sizes binary, counts binary, base long, grams binary, "
                "freqs binary")
SETS = pa.schema([
    ("set_id", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()),
    ("grams", pa.list_(pa.int64())),
])
SETS_DDL = "set_id long, n int, shared int, grams array<long>"
#: N-gram numbers have 56 bits.
GRAM_BYTES = 7
PAIR_FRAGMENT_BITS = 3


def gram_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, set numbers and the sorted distinct n-grams of each row, end to end."""
    found = words.split(column)
    number, first, count = found.numbers(), found.first, found.counts
    grams = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(grams)), grams)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    at = first[:-1][row] + inner
    out = np.zeros(len(row), dtype=np.uint64)
    whole = count[row] >= k
    for j in range(k):
        step = words.mix(number + np.uint64(j + 1))
        use = whole | (inner + j < count[row])
        out[use] += step[at[use] + j]
    out = words.mix(out + np.where(whole, np.uint64(0), np.uint64(1)))
    out >>= np.uint64(64 - 8 * GRAM_BYTES)
    low = np.r_[0, np.cumsum(grams)]
    for a, b in zip(low[:-1], low[1:], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[fresh], row[fresh]
    size = np.bincount(row, minlength=len(grams)).astype(np.int64)
    total = np.zeros(len(grams), dtype=np.uint64)
    if len(out):
        held = size > 0
        total[held] = np.add.reduceat(words.mix(out), (np.cumsum(size) - size)[held])
    return size, words.mix(total + size.astype(np.uint64)), out


def _fragment(grams: np.ndarray, parts: int) -> np.ndarray:
    return packed.place(grams << np.uint64(64 - 8 * GRAM_BYTES), parts)


def _width(parts: int) -> int:
    """Bytes that hold any distance between two n-grams of one fragment."""
    # a fragment is a range of the upper 32 bits; the other bits are free
    free = 8 * GRAM_BYTES - 32
    return min(GRAM_BYTES, -(-(free + (-(-(1 << 32) // parts)).bit_length()) // 8))


def _pack(grams: np.ndarray, base: np.uint64, width: int) -> bytes:
    return (grams - base).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(table: pa.Table, width: int) -> np.ndarray:
    body = packed.read(table["grams"], "u1").reshape(-1, width)
    out = np.zeros((len(body), 8), dtype=np.uint8)
    out[:, :width] = body
    base = table["base"].to_numpy().astype(np.uint64)
    return out.view("<u8").ravel() + np.repeat(base, packed.lengths(table["grams"], width))


def _cut(part, owner, ids, sizes, grams, width, freqs=None) -> pa.RecordBatch:
    """One row per part; inputs are sorted by part, then by owner (an index into ids).

    The n-grams of a row lie in one fragment and are kept as distances from the least of them.
    """
    rows: dict[str, list] = {f.name: [] for f in SEGMENTS}
    start, length = packed.runs(part)
    for a, m in zip(start, length, strict=True):
        at, counts = packed.runs(owner[a:a + m])
        own = owner[a:a + m][at]
        rows["part"].append(int(part[a]))
        rows["ids"].append(ids[own].astype("<u8").tobytes())
        rows["sizes"].append(packed.planes(sizes[own]))
        rows["counts"].append(packed.planes(counts))
        base = grams[a:a + m].min()
        rows["base"].append(int(base))
        rows["grams"].append(_pack(grams[a:a + m], base, width))
        rows["freqs"].append(b"" if freqs is None else packed.planes(freqs[a:a + m]))
    return packed.batch(rows, SEGMENTS)


def _segments_of_texts(k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packed.slices(batches):
            size, set_id, grams = gram_sets(b.column(0), k)
            owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
            part = _fragment(grams, parts).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            yield _cut(part[order], owner[order], set_id, size, grams[order], _width(parts))

    return run


def _set_table(k: int):
    schema = pa.schema([("_row", pa.int64()), ("n", pa.int32()), ("set_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packed.slices(batches):
            size, set_id, _ = gram_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size.astype(np.int32)), pa.array(set_id.view(np.int64))],
                schema=schema,
            )

    return run


def _set_members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packed.slices(batches):
            size, set_id, _ = gram_sets(b.column(2), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size.astype(np.int32)),
                 pa.array(set_id.view(np.int64))], names=["id", "hash", "n", "set_id"])

    return run


def _shared_in_fragment(buckets: int, width: int, last: bool):
    """Within one fragment: the n-grams that at least two sets hold, with their frequency."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = packed.read(table["ids"], "<u8"), packed.read_planes(table["sizes"])
        counts, grams = packed.read_planes(table["counts"]), _unpack(table, width)
        known, first = np.unique(ids, return_index=True)
        chosen = np.zeros(len(ids), dtype=bool)
        chosen[first] = True  # of copies of one set, one part is enough
        owner = np.repeat(np.searchsorted(known, ids).astype(np.int32), counts)
        grams, owner = (x[np.repeat(chosen, counts)] for x in (grams, owner))
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        _, length = packed.runs(grams)
        freq = np.repeat(length, length)
        held = freq > 1
        grams, owner, freq = grams[held], owner[held], freq[held]
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        out = _cut(packed.place(known, buckets)[owner], owner, known, sizes[first], grams[order],
                   width, freq[order] if last else None)
        return pa.Table.from_batches([out], schema=SEGMENTS)

    return run


def _survivors(num: int, den: int, parts: int, last: bool):
    """Sums the shared parts of each set; keeps sets that can still reach the threshold."""
    width = _width(parts)

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = packed.read(table["ids"], "<u8"), packed.read_planes(table["sizes"])
        counts, grams = packed.read_planes(table["counts"]), _unpack(table, width)
        known, first, slot = np.unique(ids, return_index=True, return_inverse=True)
        size = sizes[first].astype(np.int64)
        shared = np.bincount(slot, weights=counts, minlength=len(known)).astype(np.int64)
        alive = den * shared >= num * size
        owner = np.repeat(slot, counts)
        keep = alive[owner]
        owner, grams = owner[keep], grams[keep]
        if not last:
            part = _fragment(grams, parts)
            order = np.lexsort((grams, owner, part))
            out = _cut(part[order], owner[order], known, size, grams[order], width)
            return pa.Table.from_batches([out], schema=SEGMENTS)
        order = np.lexsort((grams, packed.read_planes(table["freqs"])[keep], owner))
        at = np.r_[0, np.cumsum(shared[alive])].astype(np.int32)
        return pa.Table.from_arrays([
            pa.array(known[alive].view(np.int64)), pa.array(size[alive].astype(np.int32)),
            pa.array(shared[alive].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(at), pa.array(grams[order].view(np.int64))),
        ], schema=SETS)

    return run


def _reachable(num: int, den: int) -> Column:
    """Whether enough overlap is left from the n-gram on at which two sets meet.

    ``rest`` counts the shared n-grams from that position on. Where two sets meet first, none
    before is common, so a linked pair passes there, and one such row is enough.
    """
    bound = F.least("x.rest", "y.rest") * F.lit(num + den)
    return bound >= (F.col("x.n") + F.col("y.n")) * F.lit(num)


def _linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose partial overlaps, summed over the fragments, reach the threshold."""
    left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("grams").alias("of_a"),
                           F.col("n").alias("n_a"))
    right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("grams").alias("of_b"),
                            F.col("n").alias("n_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("part")
    )
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    enough = F.col("overlap") * F.lit(num + den) >= (F.col("n_a") + F.col("n_b")) * F.lit(num)
    return total.where(enough).select("a", "b", "overlap", "n_a", "n_b")


def _prepared(
    texts: DataFrame, text_col: str, k: int, num: int, den: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets that could have a partner, (set_id, n, shared, grams), their prefixes as rows
    (set_id, n, shared, gram, rest), and their n-grams by fragment for ``_linked``."""
    spark = packed.bounded_batches(texts.sparkSession)
    parts = packed.partitions(spark, 2)
    buckets = max(1, parts // 4)  # packed rows are fragments times buckets
    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_segments_of_texts(k, parts), SEGMENTS_DDL)
    for last in (False, True):
        shared = found.groupBy("part").applyInArrow(
            _shared_in_fragment(buckets, _width(parts), last), SEGMENTS_DDL
        )
        found = shared.groupBy("part").applyInArrow(
            _survivors(num, den, parts, last), SETS_DDL if last else SEGMENTS_DDL
        )
    sets = cut_lineage(found, "sets")

    prefix = F.col("shared") - F.expr(f"(n * {num} + {den - 1}) div {den}").cast("int") + 1
    posted = sets.select(
        "set_id", "n", "shared", F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("at", "gram")
    ).withColumn("rest", F.col("shared") - F.col("at")).drop("at")
    fragment = F.shiftrightunsigned("gram", 8 * GRAM_BYTES - PAIR_FRAGMENT_BITS)
    segments = cut_lineage(
        sets.select("set_id", "n", F.explode("grams").alias("gram"))
        .groupBy("set_id", "n", fragment.alias("fragment"))
        .agg(F.collect_list("gram").alias("grams")), "segments",
    )

    return sets, posted, segments


def jaccard_links(
    texts: DataFrame, text_col: str = "text", k: int = 3, num: int = 9, den: int = 10
) -> tuple[DataFrame, DataFrame]:
    """The join: every pair of distinct sets with Jaccard similarity at least ``num / den``.

    The first table has (a, b, overlap, n_a, n_b), one row per linked pair; the second
    (set_id, n, shared, grams) of every set that could have a partner. Sets meet by n-gram
    and band of size, so only those of similar size do. A group of sets that are all near each
    other has a link for each of its pairs.
    """
    sets, posted, segments = _prepared(texts, text_col, k, num, den)
    # a partner is at most one band larger; one more bears with rounding
    band = F.floor(F.log("n") / F.lit(math.log(den / num)) if num < den else F.col("n"))
    entry = F.struct("n", "set_id", "rest")
    posts = cut_lineage(posted.select("gram", band.alias("band"), entry.alias("x")), "posted")
    larger = posts.select("gram", "band", F.col("x").alias("y"))
    smaller = posts.withColumn("band", F.explode(F.sequence("band", F.col("band") + 2)))
    pairs = (
        smaller.join(larger, ["gram", "band"])
        .where((F.struct("x.n", "x.set_id") < F.struct("y.n", "y.set_id"))
               & (F.col("x.n") * F.lit(den) >= F.col("y.n") * F.lit(num)) & _reachable(num, den))
        .select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    )
    return _linked(pairs, segments, num, den), sets


def joining_links(
    texts: DataFrame, text_col: str = "text", k: int = 3, num: int = 9, den: int = 10
) -> DataFrame:
    """(a, b, overlap, n_a, n_b): links enough to join every component, not all of them."""
    _, posted, segments = _prepared(texts, text_col, k, num, den)
    rank = F.struct((F.col("n") - F.col("shared")).alias("odd"), (-F.col("n")).alias("short"),
                    "set_id", "n", "rest")
    heads = posted.groupBy("gram").agg(F.min(rank).alias("y"), F.count("*").alias("many")).where(
        "many > 1"
    )
    first = (
        posted.select("gram", F.struct("set_id", "n", "rest").alias("x")).join(heads, "gram")
        .where("x.set_id <> y.set_id").where(_reachable(num, den))
        .groupBy(F.col("x.set_id").alias("a")).agg(F.min("y").alias("y"))
        .select("a", F.col("y.set_id").alias("b"))
    )
    star = cut_lineage(_linked(first, segments, num, den), "links")
    groups = components(star)

    named = posted.join(
        groups.select(F.col("node").alias("set_id"), "component"), "set_id", "left"
    ).withColumn("component", F.coalesce("component", "set_id"))
    named = cut_lineage(named, "posted")
    mixed = named.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high").select("gram")
    entry = F.struct("set_id", "n", "rest", "component")
    open_posts = cut_lineage(named.join(mixed, "gram", "left_semi").select(
        "gram", entry.alias("x")), "open")
    across = (
        open_posts.join(open_posts.select("gram", F.col("x").alias("y")), "gram")
        .where((F.col("x.set_id") < F.col("y.set_id"))
               & (F.col("x.component") != F.col("y.component")) & _reachable(num, den))
        .select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    )
    return star.unionByName(_linked(across, segments, num, den))


def jaccard_link_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    k: int = 3, num: int = 9, den: int = 10,
) -> DataFrame:
    """(id, n_links) of every row of ``docs``: how many other rows its set is linked to.

    Rows with equal sets are linked; empty sets have no links.
    """
    packed.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_row"),
                       F.col(text_col).cast("string").alias("text"))
    table = cut_lineage(
        rows.mapInArrow(_set_table(k), "_row long, n int, set_id long"), "members"
    )
    classes = table.where("n > 0").groupBy("set_id").agg(F.count("*").alias("rows"))
    links, _ = jaccard_links(rows, "text", k, num, den)
    links = links.select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.withColumnRenamed("set_id", "b"), "b").groupBy(
        F.col("a").alias("set_id")).agg(F.sum("rows").alias("others"))
    count = classes.join(others, "set_id", "left").select(
        "set_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return table.join(count, "set_id", "left").select(
        F.col("_row").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    k: int = 3, num: int = 9, den: int = 10,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable through links of Jaccard similarity at least
    ``num / den`` on sets of distinct ``k``-word n-grams, itself included. A text with fewer
    than ``k`` words is one n-gram. NULL, empty and blank texts have an empty set and no links.
    Rows with equal sets are linked; repeated ids give one row each; a NULL id is kept as is
    and can be nobody's component. Other columns of ``docs`` are not read.
    """
    spark = packed.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_row"),
                       F.col(text_col).cast("string").alias("text"))
    table = cut_lineage(
        rows.mapInArrow(_set_table(k), "_row long, n int, set_id long"), "members"
    )
    reach = _least_ids(table.where("n > 0").select("set_id", "_row"),
                       joining_links(rows, "text", k, num, den))
    return table.join(reach.withColumn("n_ok", F.lit(True)), "set_id", "left").select(
        F.col("_row").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "_row")).otherwise(F.col("_row"))
        .alias("component_id"),
    )


def _roots(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, root): sets that reach each other through links have the same root."""
    groups = components(links.select("a", "b"))
    return sets.join(groups, F.col("set_id") == F.col("node"), "left").select(
        "set_id", F.coalesce("component", "set_id").alias("root"))


def _least_ids(members: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, component_id): the least id among the rows of all sets that a set reaches.

    Components are those of the sets, so rows without an id join what lies on both sides of them.
    """
    classes = members.groupBy("set_id").agg(F.min("_row").alias("head"))
    reach = cut_lineage(classes.join(_roots(classes.select("set_id"), links), "set_id"), "roots")
    least = reach.groupBy("root").agg(F.min("head").alias("component_id"))
    return reach.join(least, "root").select("set_id", "component_id")


def one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    k: int = 5, num: int = 8, den: int = 10,
) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, all its columns kept.

    Rows without an id come last in their group; of equal ids the least text hash stays, and of
    rows equal in both any one. Rows with empty sets stay as they are, whatever their ids.
    """
    packed.bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    # the caller's columns travel in one struct, so no name can clash
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"),
        F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("filled"),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("_row"), text.alias("text"))
    named = rows.select(F.col("_row").alias("id"), F.xxhash64("text").alias("hash"), "text")
    members = cut_lineage(named.mapInArrow(
        _set_members(k), "id long, hash long, n int, set_id long").where("n > 0"), "members")
    links = joining_links(rows, "text", k, num, den)
    roots = _roots(members.select("set_id").distinct(), links)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    heads = members.groupBy("set_id").agg(F.min(rank).alias("best")).join(roots, "set_id").groupBy(
        "root").agg(F.min("best").alias("best")).select(
        F.col("best.id").alias("head"), F.col("best.hash").alias("head_hash"))
    chosen = kept.where("filled").join(
        heads, F.col("id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("head_hash")),
        "left_semi").dropDuplicates(["id", "hash"])
    return chosen.select("row.*").unionByName(kept.where("not filled").select("row.*"))
