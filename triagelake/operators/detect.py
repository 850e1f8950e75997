"""Detectors on binned call durations: a quantile band and an isolation forest.

Both learn from baseline bins and end as a table of abnormal value ranges per call path,
so scoring is a plain join with a range check. The forest itself is a table of nodes whose splits
follow from digests, so it can be repeated by any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import FOREST_CONTAMINATION, FOREST_TREES, SAMPLE_SEED, TOP_K
from triagelake.functions.numbers import round_even
from triagelake.operators.traces import PATH, top_k
from triagelake.session import cut_lineage

EULER_GAMMA = 0.5772156649015329


def quantile_model(bins: DataFrame, contamination: float = FOREST_CONTAMINATION) -> DataFrame:
    """Values outside the central band of the baseline bins are abnormal."""
    v = F.col("mean_duration")
    half = contamination / 2
    cuts = F.percentile(v, [half, 1 - half])
    return bins.groupBy(*PATH).agg(cuts.alias("_q")).select(
        *PATH, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high")
    )


def quantile_events(bins: DataFrame, model: DataFrame) -> DataFrame:
    """Bins outside the band; call paths the model does not know are dropped."""
    joined = bins.join(model, PATH)
    v = F.col("mean_duration")
    return joined.where((v < F.col("low")) | (v > F.col("high"))).drop("low", "high")


def average_depth(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` values."""
    usual = F.lit(2.0) * (F.log(n - F.lit(1)) + F.lit(EULER_GAMMA)) - F.lit(2.0) * (
        n - F.lit(1)) / n
    return F.when(n <= F.lit(1), F.lit(0.0)).when(n == F.lit(2), F.lit(1.0)).otherwise(usual)


def _settled(mean: Column) -> Column:
    """Six decimals: the noise of a sum must not decide whether two means differ."""
    return round_even(mean, 6)


def grow_forest(
    bins: DataFrame,
    trees: int = FOREST_TREES,
    seed: int = SAMPLE_SEED,
    max_samples: int = 256,
    bin_key: tuple[str, ...] = ("uuid", "bin_start_ns"),
) -> DataFrame:
    """The nodes of an isolation forest per call path, one row per node.

    Every tree sees at most ``max_samples`` bins of its path, the first ones by a digest of bin
    and tree. A node splits its values at a point between the least and the largest that follows
    from a digest of (path, tree, node), down to single values or the depth limit; the children of
    node i are 2i and 2i + 1. A tree is one row with its ``max_samples`` values at most, sorted, and
    its nodes are ranges of them, so all levels are grown without another shuffle. Leaves have no threshold; ``low`` and
    ``high`` bound the values ``low < v <= high`` of a node. The number of bins is bounded by the
    sampled incidents, whatever the number of spans.
    """
    v = F.col("mean_duration")
    tree_key = [*PATH, "tree"]
    named = [c for c in bin_key if c in bins.columns]
    known = bins.where(v.isNotNull()).select(*PATH, *named, _settled(v).alias("mean_duration"))
    drawn = F.md5(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in named or ["mean_duration"]],
        F.col("tree").cast("string"), F.lit(str(seed))))
    first = Window.partitionBy(*tree_key).orderBy("_draw", *named, "mean_duration")
    numbered = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    held = F.array_sort(F.collect_list(v)).alias("_v")
    counted = known.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*PATH)))
    # where a tree sees all bins of its path, all trees see the same
    whole = counted.where(F.col("_size") <= F.lit(max_samples)).groupBy(*PATH).agg(held).select(
        *PATH, "_v", numbered)
    chosen = (
        counted.where(F.col("_size") > F.lit(max_samples)).select("*", numbered)
        .withColumn("_draw", drawn).withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= F.lit(max_samples)).groupBy(*tree_key).agg(held)
    )
    # equal arrays compress well, so the size of the shuffle says little about the work
    tasks = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = whole.unionByName(chosen).repartition(tasks, *tree_key).withColumn(
        "samples", F.size("_v"))
    path = ", ".join(PATH)
    draw = (f"conv(substring(md5(concat_ws('|', {path}, string(tree), string(n.node), '{seed}')), "
            f"1, 8), 16, 10) / {float(1 << 32)}D")

    def with_thresholds(nodes: str, depth: int) -> str:
        """The nodes of a level with the points at which they split."""
        least, most = "_v[n.first]", "_v[n.end - 1]"
        at = (f"CASE WHEN {least} < {most} AND {depth} < length(bin(greatest(samples, 2) - 1)) "
              f"THEN {least} + ({most} - {least}) * ({draw}) END")
        return (f"transform({nodes}, n -> struct(n.node AS node, {depth} AS depth, "
                f"n.end - n.first AS n, {at} AS threshold, n.low AS low, n.high AS high, "
                "n.first AS first, n.end AS end))")

    inner = "n.first + size(filter(slice(_v, n.first + 1, n.end - n.first), x -> x <= n.threshold))"
    halves = (f"array(struct(2 * n.node AS node, n.first AS first, {inner} AS end, n.low AS low, "
              f"n.threshold AS high), struct(2 * n.node + 1 AS node, {inner} AS first, n.end AS end, "
              "n.threshold AS low, n.high AS high))")
    root = ("array(struct(1L AS node, 0 AS first, samples AS end, double('-infinity') AS low, "
            "double('infinity') AS high))")
    levels = ["_level_0"]
    rows = rows.selectExpr("*", f"{with_thresholds(root, 0)} AS _level_0")
    for depth in range(1, (max_samples - 1).bit_length() + 1):
        split = f"filter({levels[-1]}, n -> n.threshold IS NOT NULL)"
        below = f"flatten(transform({split}, n -> {halves}))"
        levels.append(f"_level_{depth}")
        rows = rows.selectExpr("*", f"{with_thresholds(below, depth)} AS {levels[-1]}")
    every = rows.select(*tree_key, "samples", F.explode(F.concat(*levels)).alias("_n"))
    kept = ("node", "depth", "n", "threshold", "low", "high")
    return every.select(*tree_key, "samples", *[F.col(f"_n.{c}") for c in kept])


def _scored(nodes: DataFrame, points: DataFrame, trees: int) -> DataFrame:
    """Depths summed over all trees at the points and at the borders of the leaves.

    A leaf adds its depth from ``low`` on and takes it off after ``high``; the running sum by
    value is the sum over all trees. Depths are whole billionths, so sums do not depend on order.
    """
    deep = F.round((F.col("depth") + average_depth(F.col("n"))) * F.lit(1e9)).cast("long")
    leaves = nodes.where(F.col("threshold").isNull()).select(
        *PATH, "samples", "low", "high", deep.alias("_deep"))
    steps = leaves.select(*PATH, "samples", F.explode(F.array(
        F.struct(F.col("low").alias("x"), F.col("_deep").alias("d")),
        F.struct(F.col("high").alias("x"), (-F.col("_deep")).alias("d")))).alias("_s"))
    steps = steps.groupBy(*PATH, F.col("_s.x").alias("x")).agg(
        F.sum("_s.d").alias("d"), F.max("samples").alias("samples"))
    none = F.lit(None).cast("long")
    both = steps.withColumn("point", F.lit(False)).unionByName(points.select(
        *PATH, _settled(F.col("mean_duration")).alias("x"), F.lit(0).cast("long").alias("d"),
        none.alias("samples"), F.lit(True).alias("point")))
    # a value on a border belongs to the leaf that ends there
    upto = Window.partitionBy(*PATH).orderBy("x", F.col("point").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    size = F.max("samples").over(Window.partitionBy(*PATH))
    scale = F.when(size > F.lit(1), average_depth(size)).otherwise(F.lit(1.0))
    mean = F.sum("d").over(upto) / F.lit(1e9) / F.lit(trees)
    score = F.round(-F.pow(F.lit(2.0), -mean / scale), 9)
    return both.withColumn("score", score)


def forest_ranges(
    nodes: DataFrame, bins: DataFrame, trees: int, contamination: float = FOREST_CONTAMINATION,
) -> DataFrame:
    """Per call path the score below which a bin is abnormal, and the value ranges that lie below.

    The threshold is the ``contamination`` quantile of the scores of the training bins.
    """
    known = bins.where(F.col("mean_duration").isNotNull())
    scored = cut_lineage(_scored(nodes, known, trees), "scores")
    cuts = scored.where("point").groupBy(*PATH).agg(
        F.count(F.lit(1)).alias("train_bins"),
        F.round(F.percentile("score", contamination), 9).alias("cutoff"))
    order = Window.partitionBy(*PATH).orderBy("x")
    pieces = scored.where(~F.col("point")).join(cuts, PATH).select(
        *PATH, "train_bins", "cutoff", F.col("x").alias("low"), F.lead("x").over(order).alias("high"),
        (F.col("score") < F.col("cutoff")).alias("_bad"))
    pieces = pieces.where(F.col("high").isNotNull())
    begins = F.col("_bad") & ~F.coalesce(
        F.lag("_bad").over(Window.partitionBy(*PATH).orderBy("low")), F.lit(False))
    runs = pieces.withColumn("_begins", begins.cast("int")).withColumn(
        "_run", F.sum("_begins").over(Window.partitionBy(*PATH).orderBy("low")))
    merged = runs.groupBy(*PATH, "train_bins", "cutoff", "_bad", "_run").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    bad = F.when(F.col("_bad"), F.struct("low", "high"))
    return merged.groupBy(*PATH, "train_bins", "cutoff").agg(
        F.array_sort(F.collect_list(bad)).alias("abnormal")).select(
        *PATH, F.lit(trees).alias("trees"), "train_bins", "cutoff", "abnormal")


def train_forest(
    bins: DataFrame,
    trees: int = FOREST_TREES,
    contamination: float = FOREST_CONTAMINATION,
    seed: int = SAMPLE_SEED,
    max_samples: int = 256,
) -> DataFrame:
    """One isolation forest per call path, as the value ranges it calls abnormal."""
    nodes = cut_lineage(grow_forest(bins, trees, seed, max_samples), "forest")
    return forest_ranges(nodes, bins, trees, contamination)


def forest_events(bins: DataFrame, model: DataFrame) -> DataFrame:
    """Bins whose mean lies in an abnormal range of their call path's model."""
    v = _settled(F.col("mean_duration"))

    def inside(r):
        return (v > r["low"]) & (v <= r["high"])

    joined = bins.join(model.select(*PATH, "abnormal"), PATH)
    return joined.where(F.exists("abnormal", inside)).drop("abnormal")


def anomaly_combinations(
    events: DataFrame,
    callers: DataFrame,
    stats: DataFrame,
    scope: list[str],
    k: int = TOP_K,
) -> DataFrame:
    """Abnormal call paths of each scope, the most frequent ones first.

    ``callers`` gives the service and node of the first span of each group, ``stats`` the
    baseline mean, which is 0 for a path the baseline does not know.
    """
    grouped = events.groupBy(*scope, *PATH).agg(
        F.avg("mean_duration").alias("anomaly_avg_duration"),
        F.count(F.lit(1)).alias("anomaly_count"),
    )
    top = top_k(grouped, scope, "anomaly_count", PATH, k)
    named = top.join(callers, [*scope, *PATH], "left")
    base = stats.select(*PATH, F.col("mean").alias("_mean"))
    return named.join(base, PATH, "left").select(
        *scope, "node_name", "service_name", *PATH,
        F.coalesce("_mean", F.lit(0.0)).alias("normal_avg_duration"),
        "anomaly_avg_duration", "anomaly_count", "rank_no",
    )
