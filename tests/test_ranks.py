"""Line numbers inside groups, by a window and by ranges."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import logs, ranks, summary
from triagelake.sinks import writers
from triagelake.sources import telemetry
from triagelake.sources.results import read_evidence_text


@pytest.mark.parametrize("group_rows", [10, 1_000_000])
def test_numbers_of_a_hot_group_are_exact(spark, group_rows):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 > 0, F.lit("cold")).alias("g"),
        (F.col("id") * 7919 % 50).alias("v"), "id")
    found = ranks.numbered(rows, ["g"], [F.col("v").desc(), "id"], group_rows=group_rows, ranges=16)
    assert found.columns == ["g", "v", "id", "line_no"]
    got = [tuple(r) for r in found.collect()]
    want, at = [], {}
    for r in sorted(rows.collect(), key=lambda r: (-r.v, r.id)):
        at[r.g] = at.get(r.g, 0) + 1
        want.append((r.g, r.v, r.id, at[r.g]))
    assert sorted(got, key=str) == sorted(want, key=str) and set(at) == {"hot", "cold", None}
    assert ranks.numbered(rows.limit(0), ["g"], ["v"], group_rows=group_rows).count() == 0


def test_a_hot_group_is_dealt_to_many_tasks(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "cut_lineage",
                        lambda df, label: written.append(df.persist()) or written[-1])
    rows = spark.range(4000).select(F.lit("one").alias("g"), "id")
    assert ranks.numbered(rows, ["g"], ["id"], group_rows=10, ranges=8).count() == 4000
    sizes = [r["count"] for r in written[-1].groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1000


def test_text_of_an_incident_with_most_lines_keeps_its_order(spark, tmp_path):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4900, F.lit("u/1")).otherwise(F.lit("v")).alias("uuid"),
        F.col("id").alias("occurrence_count"), F.concat(F.lit("m"), "id").alias("line"))
    lines = logs.order_by_count(rows, ["uuid"], ["line"])
    writers.write_evidence_text(lines, str(tmp_path / "t"))
    got = sorted(tuple(r) for r in read_evidence_text(spark, str(tmp_path / "t")).collect())
    want = [("u/1", i + 1, f"m{4899 - i}") for i in range(4900)]
    want += [("v", i + 1, f"m{4999 - i}") for i in range(100)]
    assert got == want


def test_causes_of_files_without_rows(spark, tmp_path):
    table = spark.range(5).coalesce(1)
    table.write.parquet(str(tmp_path / "good + 1%"))
    table.limit(0).write.parquet(str(tmp_path / "none"))
    whole = next((tmp_path / "good + 1%").glob("*.parquet")).read_bytes()
    files = {"zero": b"", "text": b"some text that is no table", "cut": whole[:-30],
             "odd[1]{2}": b"PAR1 and no more", "garbled": whole[:4] + b"\x07" * 60 + whole[-4:], "x_deleted": b""}
    (tmp_path / "bad").mkdir()
    for name, content in files.items():
        (tmp_path / "bad" / f"{name} 1.parquet").write_bytes(content)
    found = {r.path.split("/")[-1].split(" ")[0].split("%")[0]: (r.status, r.cause)
             for r in telemetry.file_report(spark, str(tmp_path / "bad")).collect()}
    assert found.pop("garbled")[1].startswith("broken: ")
    assert found == {
        "odd[1]{2}": ("error", "broken: cut off"), "zero": ("error", "empty: no bytes"), "x_deleted": ("skipped", None),
        "text": ("error", "broken: does not start as Parquet"), "cut": ("error", "broken: cut off")}
    both = telemetry.file_report(spark, str(tmp_path)).groupBy("status", "cause").agg(
        F.sum("rows").alias("n"))
    seen = {(r.status, r.cause): r.n for r in both.collect()}
    assert seen["success", None] == 5 and seen["error", "empty: no rows"] == 0


def test_totals_are_observed_while_outcomes_are_stored(spark, tmp_path):
    rows = [("a", "found", 2), ("b", "empty", 0), ("c", "no_file", 0), ("d", "found", 5)]
    table = spark.createDataFrame(rows, "uuid string, status string, rows_found long")
    totals = summary.write_outcomes(table, str(tmp_path / "o"))
    assert list(totals.values()) == list(summary.run_summary(table).first()) == [4, 1, 1, 2, 7, 5]
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4
    none = summary.write_outcomes(table.limit(0), str(tmp_path / "e"))
    assert none["total_count"] == 0 and none["rows_max"] is None
