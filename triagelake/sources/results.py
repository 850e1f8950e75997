"""Reader for result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.logs import last_wins
from triagelake.operators.ranks import numbered
from triagelake.schemas import CALL, RESULT
from triagelake.sources.incidents import path_exists
from triagelake.versions import newest


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, the last line per incident, files by name; a missing file is an empty table.

    Where the path has versions, the newest is read. Lines that do not parse are left out.
    """
    path = newest(spark, path)[1] or path
    if not path_exists(spark, path):
        return spark.createDataFrame([], RESULT)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start",
                     F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("_line"))
    parsed = lines.select("_line", F.from_json("value", RESULT).alias("_r")).select("_line", "_r.*")
    known = parsed.where(F.col("uuid").isNotNull())
    return last_wins(known, ["uuid"], ["_line"]).select(
        "component", "uuid", "reason", "reasoning_trace"
    )


def read_evidence_text(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, line_no, line) of stored evidence texts: files by name, lines in their order."""
    lines = spark.read.schema("value string, uuid string").text(path).select(
        "uuid", F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    return numbered(lines, ["uuid"], ["_file", "_block", "_at"]).select("uuid", "line_no", "line")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL).parquet(path)
