"""Detectors and baseline statistics as stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.fixed_values import (
    BIN_NS, FOREST_CONTAMINATION, FOREST_TREES, RECOVERY_NS, SAMPLE_INCIDENTS, SAMPLE_SEED,
)
from triagelake.operators.detect import forest_ranges, grow_forest
from triagelake.operators.incidents import sample_incidents
from triagelake.operators.traces import baseline_stats
from triagelake.plans.evidence import training_bins
from triagelake.session import cut_lineage
from triagelake.sinks.writers import save_table
from triagelake.sources.incidents import path_exists


def load_or_train(
    spark: SparkSession,
    path: str,
    span_table: DataFrame,
    incidents: DataFrame,
    order: list[str],
    sample: int = SAMPLE_INCIDENTS,
    seed: int = SAMPLE_SEED,
    recovery_ns: int = RECOVERY_NS,
    bin_ns: int = BIN_NS,
    contamination: float = FOREST_CONTAMINATION,
) -> tuple[DataFrame, DataFrame]:
    """Stored detectors and baseline statistics, trained and stored first if there are none.

    Beside them the nodes of the trees are stored as ``forest``.
    """
    models, stats = f"{path}/detectors", f"{path}/baseline"
    if not path_exists(spark, f"{models}/_SUCCESS"):
        chosen = cut_lineage(sample_incidents(incidents, sample, seed))
        bins = cut_lineage(training_bins(span_table, chosen, order, recovery_ns, bin_ns))
        save_table(baseline_stats(bins), stats)
        save_table(grow_forest(bins, seed=seed), f"{path}/forest")
        nodes = spark.read.parquet(f"{path}/forest")
        save_table(forest_ranges(nodes, bins, FOREST_TREES, contamination), models)
    return spark.read.parquet(models), spark.read.parquet(stats)
