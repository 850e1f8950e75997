import json

import pytest
from conftest import rows

from triagelake.operators import incidents
from triagelake.sources.incidents import read_incident_csv, read_incident_json, read_incident_lists

REPORTS = [
    (0, "a", "from 2025-06-05T16:10:02Z to 2025-06-05T16:31:02Z, find the cause"),
    (1, "b", "2025-06-05T17:00:00Z then 2025-06-05T18:30:30Z not 2025-06-05T19:00:00Z"),
    (2, "c", "only 2025-06-05T17:00:00Z"),
    (3, "d", "nothing"),
]


def table(spark):
    return spark.createDataFrame(REPORTS, "ord long, uuid string, description string")


def test_times_need_two_instants(spark):
    found = incidents.incident_times(table(spark))
    assert rows(found, "uuid", "start_text", "end_text") == [
        ("a", "2025-06-05T16:10:02Z", "2025-06-05T16:31:02Z"),
        ("b", "2025-06-05T17:00:00Z", "2025-06-05T18:30:30Z")]


def test_keys_are_local(spark):
    row = incidents.incident_keys(incidents.incident_times(table(spark))).where("uuid='a'").first()
    assert row["start_ns"] == 1749139802000000000
    assert row["start_local"] == "2025-06-06_00-10-02"
    assert row["date"] == "2025-06-06"
    assert row["hour"] == "00-00-00"
    assert row["hour_key"] == "2025-06-06_00"
    assert row["duration_s"] == 1260.0 and row["duration_min"] == 21.0


def test_sample_is_seeded_and_whole_when_small(spark):
    many = spark.range(200).selectExpr("concat('u', id) AS uuid")
    first = rows(incidents.sample_incidents(many, 50))
    assert len(first) == 50
    assert first == rows(incidents.sample_incidents(many.repartition(7), 50))
    assert first != rows(incidents.sample_incidents(many, 50, seed=1))
    assert incidents.sample_incidents(many, 500).count() == 200


def test_pending_needs_component_and_reason(spark):
    results = spark.createDataFrame(
        [("a", "x", "y"), ("b", "", "y"), ("c", "x", None)],
        "uuid string, component string, reason string")
    assert rows(incidents.pending_incidents(table(spark), results), "uuid") == [
        ("b",), ("c",), ("d",)]


def test_json_lists_in_order_and_missing_ones(spark, tmp_path):
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    for path, names in ((one, ["x", "y"]), (two, ["z"])):
        path.write_text(json.dumps(
            [{"uuid": n, "Anomaly Description": f"about {n}\nmore"} for n in names], indent=2))
    both = read_incident_lists(spark, [str(one), str(two), str(tmp_path / "absent.json")])
    assert [r["uuid"] for r in both.orderBy("list_no", "ord").collect()] == ["x", "y", "z"]
    assert read_incident_json(spark, str(two)).first()["description"] == "about z\nmore"
    with pytest.raises(FileNotFoundError):
        read_incident_lists(spark, [str(tmp_path / "absent.json")])


def test_csv_with_quoted_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "uuid,start_time_utc,end_time_utc,start_time_beijing,end_time_beijing,start_timestamp,"
        "end_timestamp,date,hour,start_time_hour,duration_seconds,duration_minutes,"
        "Anomaly Description\n"
        "u1,a,b,c,d,5,9,2025-06-06,00-00-00,2025-06-06_00,4.0,0.1,\"said \"\"x\"\",\nand more\"\n")
    row = read_incident_csv(spark, str(path)).first()
    assert (row["uuid"], row["start_ns"], row["end_ns"]) == ("u1", 5, 9)
    assert row["description"] == 'said "x",\nand more'


def test_neighbours_run_over_the_joined_lists(spark):
    from triagelake.operators.incidents import union_lists
    from triagelake.operators.windows import neighbours

    ddl = "ord long, uuid string, start_ns long, end_ns long"
    a = spark.createDataFrame([(0, "a0", 10, 11), (1, "a1", 20, 21)], ddl)
    b = spark.createDataFrame([(0, "b0", 30, 31), (1, "b1", 40, 41)], ddl)
    found = {r.uuid: (r.prev_end_ns, r.next_start_ns) for r in neighbours(
        union_lists(a, b)).collect()}
    assert found == {"a0": (None, 20), "a1": (11, 30), "b0": (21, 40), "b1": (31, None)}


def test_the_last_nanosecond_of_an_hour_stays_in_it(spark):
    from pyspark.sql import functions as F
    from triagelake.functions.times import local_hour_key

    table = spark.createDataFrame([(1767196799999999950,), (1767196800000000000,), (-1,)], "ns long")
    keys = [r[0] for r in table.select(local_hour_key(F.col("ns"), "UTC")).collect()]
    assert keys == ["2025-12-31_15", "2025-12-31_16", "1969-12-31_23"]
