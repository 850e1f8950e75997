"""Stored results as versions: what readers see wherever a writer stops, and two writers at once."""

import pytest
from pyspark.sql import functions as F

from tests.test_results import result_rows
from triagelake import versions
from triagelake.sinks import writers
from triagelake.sources.results import read_results


class Stop(Exception):
    pass


def stored(spark, path):
    return {r["uuid"]: r["component"] for r in read_results(spark, path).collect()}


@pytest.mark.parametrize("step", ["write", "before put", "after put", "after publish"])
def test_readers_find_a_whole_table_wherever_a_writer_stops(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "results")
    writers.upsert_result_file(result_rows(spark, [("c1", "a", "r", 0), ("c2", "b", "r", 0)]), path)
    fresh = result_rows(spark, [("c3", "b", "r", 1), ("c4", "c", "r", 2)])
    old, new = {"a": "c1", "b": "c2"}, {"a": "c1", "b": "c3", "c": "c4"}

    def stop_after(call):
        def run(*args):
            call(*args)
            raise Stop
        return run

    def stop(*_):
        raise Stop

    with monkeypatch.context() as patch:
        if step == "write":
            patch.setattr(writers, "write_results", stop_after(writers.write_results))
        if step == "before put":
            patch.setattr(versions, "_put", stop)
        if step == "after put":
            patch.setattr(versions, "_put", stop_after(versions._put))
        if step == "after publish":
            patch.setattr(versions, "forget_old", stop)
        with pytest.raises(Stop):
            writers.upsert_result_file(fresh, path)
    assert stored(spark, path) == (new if step.startswith("after") else old)
    writers.upsert_result_file(fresh, path)
    assert stored(spark, path) == new


def test_of_two_writers_neither_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    writers.upsert_result_file(result_rows(spark, [("c1", "a", "r", 0)]), path)
    plain, met = writers.write_results, []

    def with_another(df, place):
        plain(df, place)
        if not met:
            met.append(1)
            writers.upsert_result_file(result_rows(spark, [("c2", "b", "r", 0)]), path)

    monkeypatch.setattr(writers, "write_results", with_another)
    writers.upsert_result_file(result_rows(spark, [("c3", "c", "r", 0)]), path)
    assert stored(spark, path) == {"a": "c1", "b": "c2", "c": "c3"}
    assert versions.newest(spark, path)[0] == 3
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, 2, "late")
    assert stored(spark, path) == {"a": "c1", "b": "c2", "c": "c3"}


def test_old_data_goes_and_manifests_stay(spark, tmp_path):
    path = tmp_path / "odd name %"
    for i in range(4):
        writers.upsert_result_file(result_rows(spark, [(f"c{i}", f"u{i}", "r", 0)]), str(path))
    assert len(list((path / "data").iterdir())) == versions.KEPT
    assert [p.name for p in sorted((path / "manifest").iterdir()) if p.name[0] == "0"] == [
        f"{i:012d}" for i in (1, 2, 3, 4)]
    assert stored(spark, str(path)) == {f"u{i}": f"c{i}" for i in range(4)}


def test_plain_folder_and_single_file_become_the_first_version(spark, tmp_path):
    folder, single = tmp_path / "plain", tmp_path / "one.jsonl"
    writers.write_results(result_rows(spark, [("c1", "a", "r", 0)]), str(folder))
    single.write_text('{"component": "c1", "uuid": "a", "reason": "r", "reasoning_trace": []}\n')
    for path in (str(folder), str(single)):
        writers.upsert_result_file(result_rows(spark, [("c2", "b", "r", 0)]), path)
        assert stored(spark, path) == {"a": "c1", "b": "c2"}
    writers.write_results(result_rows(spark, [("c9", "z", "r", 0)]), str(folder))
    assert stored(spark, str(folder)) == {"z": "c9"}
    empty = result_rows(spark, [("c", "u", "r", 0)]).where(F.lit(False))
    writers.upsert_result_file(empty, str(tmp_path / "none"))
    assert stored(spark, str(tmp_path / "none")) == {}
