"""Sharding by balanced label propagation, in DataFrame operations only.

Labels are shards. In every round a linked document counts the shards of its neighbours and
asks to move where most of them are; a shard lets in as many as its quota still holds, chosen
by hash when more ask than fit. Documents without a smaller neighbour rest in every other round,
a random half in the rounds between, so that two linked documents cannot swap for ever. What no link binds fills the shards up to exactly even
row counts, and slots are numbered without sorting a whole shard anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage

SHARDS = 8
ROUNDS = 6
CHUNK_ROWS = 20_000
COPIES_PER_HUB = 512


def copy_links(docs: DataFrame, id_col: str, copy_of: list[str]) -> DataFrame:
    """Links (a, b) that tie rows equal in ``copy_of`` together as a shallow tree.

    Copies hang on hubs of some 512 each and the hubs on the smallest id, so no document has
    more than some hundreds of links through a hub and no pairs within a group are made.
    """
    groups = docs.groupBy(*copy_of).agg(F.count("*").alias("_m"), F.min(id_col).alias("_top"))
    rows = docs.join(groups.where("_m > 1"), copy_of).withColumn(
        "_sub", F.pmod(F.xxhash64(id_col), F.ceil(F.col("_m") / COPIES_PER_HUB))
    )
    hubs = rows.groupBy(*copy_of, "_sub").agg(
        F.min(id_col).alias("_hub"), F.min("_top").alias("_top")
    )
    to_hub = rows.select(*copy_of, "_sub", id_col).join(hubs, [*copy_of, "_sub"]).select(
        F.col(id_col).alias("a"), F.col("_hub").alias("b")
    )
    to_top = hubs.select(F.col("_hub").alias("a"), F.col("_top").alias("b"))
    return to_hub.unionByName(to_top).where("a <> b").distinct()


def _fits(shard: Column, share: dict[int, float], ticket: Column) -> Column:
    """Whether the hash ticket (0 to 1) lies within the share that this shard can take."""
    accepted = F.lit(0.0)
    for s, part in share.items():
        accepted = F.when(shard == s, F.lit(part)).otherwise(accepted)
    return ticket < accepted


def _ticket(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / F.lit(float(1 << 20))


def propagate(
    links: DataFrame, quota: list[int], rounds: int = ROUNDS
) -> DataFrame:
    """(node, shard) of every linked document after some rounds of label propagation.

    Rounds read what the round before wrote, so an executor that is lost costs one round.
    """
    shards = len(quota)
    both = cut_lineage(
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges"
    )
    labels = both.select(F.col("a").alias("node")).distinct().withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    )
    labels = cut_lineage(labels, "labels")
    for turn in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "shard"), "b")
        votes = seen.groupBy("a", "shard").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        best = votes.groupBy(F.col("a").alias("node")).agg(
            F.min("b").alias("least"),
            F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("top"),
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("all"),
        )
        asked = labels.join(best, "node").select(
            "node", "shard", (F.col("least") < F.col("node")).alias("follows"), (-F.col("top.s")).alias("wish"),
            (F.col("top.n") > F.coalesce(F.col("all")[F.col("shard")], F.lit(0))).alias("better"),
        )
        chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        awake = F.col("follows") if turn % 2 == 0 else chosen
        asked = cut_lineage(asked.withColumn("moves", F.col("better") & awake), "asked")
        load = {r[0]: r[1] for r in asked.groupBy("shard").count().collect()}
        open_wishes = asked.where("better").limit(1).count()
        wish = {r[0]: r[1] for r in asked.where("moves").groupBy("wish").count().collect()}
        share = {s: max(0.0, min(1.0, (quota[s] - load.get(s, 0)) / n)) for s, n in wish.items()}
        goes = F.col("moves") & _fits(F.col("wish"), share, _ticket("node", F.lit(turn)))
        labels = cut_lineage(
            asked.select("node", F.when(goes, F.col("wish")).otherwise(F.col("shard"))
                         .alias("shard")), "labels",
        )
        if not open_wishes:
            break
    return labels


def _numbered(rows: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """Adds ``_at``, the position from 0 within ``keys``; only chunks of rows are sorted."""
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n")).select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    return rows.join(sums, [*keys, "_chunk"]).withColumn(
        "_at", F.col("_base") + F.row_number().over(inner) - 1
    ).drop("_chunk", "_base")


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, law ``rows``.

    Row counts of any two shards differ by at most one. ``links`` (a, b) are the edges to keep
    uncut; without them rows of equal text are linked. A group larger than a shard is spread
    over several. NULL text has size 1 and checksum 0 and is linked with nothing; rows with a
    NULL id, and repeated rows, get a slot each. An empty table gives an empty one. Slots run
    from 0 without gaps in every shard. Columns other than the two named ones are not read.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("_key"),
    )
    base = cut_lineage(base, "rows")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    chunks = max(1, total // (CHUNK_ROWS * shards))
    if links is None:
        keyed = base.where("_key is not null and _id is not null")
        links = copy_links(keyed, "_id", ["_key", "size"])
    labels = propagate(links, quota, rounds)
    placed = base.join(labels.withColumnRenamed("node", "_id"), "_id", "left")
    order = ["_id", "size", "text_crc32"]
    bound = _numbered(placed.where("shard is not null"), ["shard"], order, chunks)
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    bound = cut_lineage(bound.withColumn("_in", F.col("_at") < limit), "bound")
    taken = {r[0]: r[1] for r in bound.where("_in").groupBy("shard").count().collect()}
    pool = placed.where("shard is null").select(*order).unionByName(
        bound.where("not _in").select(*order)
    )
    pool = _numbered(pool.withColumn("_all", F.lit(0)), ["_all"], order, chunks * shards)
    shard, slot, low = F.lit(shards - 1), F.col("_at"), 0
    for s in range(shards):
        room = quota[s] - taken.get(s, 0)
        here = (F.col("_at") >= low) & (F.col("_at") < low + room)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("_at") - F.lit(low) + F.lit(taken.get(s, 0))).otherwise(slot)
        low += room
    free = pool.select(*order, shard.alias("shard"), slot.alias("slot"))
    kept = bound.where("_in").select(*order, "shard", F.col("_at").alias("slot"))
    return kept.unionByName(free).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
