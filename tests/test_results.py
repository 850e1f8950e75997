import json

from conftest import rows
from pyspark.sql import functions as F

from triagelake.operators import calls, results, summary
from triagelake.plans.evidence import evidence_bundle
from triagelake.schemas import RESULT
from triagelake.sinks import writers
from triagelake.sources.results import read_calls, read_results

GOOD = '{"component": "a", "reason": "r", "reasoning_trace": [{"step": 1, "action": "x", "observation": "{y}"}]}'


def test_reply_cases(spark):
    replies = spark.createDataFrame([
        ("plain", GOOD), ("prose", "Sure:\n" + GOOD.replace(", ", ",\n") + "\nbye"),
        ("two", GOOD + " and " + GOOD), ("broken", '{"component": "a", '), ("no", "nothing"),
        ("short", '{"component": "c"}'), ("empty", "{}"), ("null", None), ("back", "} x {"),
        ("bad", "{component: a}"),
        ("quotes", "{'component': 'a'}"), ("brace", '{"component": "a"}} {"b": {"c": 1}'),
        ("list", '{"component": "a"}] [{"b": 1}'), ("pair", '{"component": "a"}, {"b": 1}'),
        ("more", '{"component": "a"}, "y": {"b": 1}'),
        ("twice", '{"component": "a", "component": "z", "reason": "r"}'),
    ], "uuid string, reply string")
    found = results.parse_replies(replies)
    assert rows(found, "uuid", "component", "reason", F.size("reasoning_trace")) == [
        ("plain", "a", "r", 1), ("prose", "a", "r", 1), ("short", "c", "", 0),
        ("twice", "z", "r", 0)]
    assert found.where("uuid = 'plain'").first()["reasoning_trace"][0]["observation"] == "{y}"


def result_rows(spark, data):
    df = spark.createDataFrame([(c, u, r, [], s) for c, u, r, s in data],
                               "component string, uuid string, reason string, reasoning_trace "
                               "array<struct<step:int,action:string,observation:string>>, seq long")
    return df


def test_upsert_is_idempotent_and_prefers_fresh_rows(spark):
    old = result_rows(spark, [("a", "1", "x", 90), ("b", "2", None, 91)])
    new = result_rows(spark, [("c", "1", "y", 1), ("d", "1", "z", 2), ("e", "3", "w", 1)])
    merged = results.upsert_results(old, new)
    want = [("b", "2", ""), ("d", "1", "z"), ("e", "3", "w")]
    assert rows(merged, "component", "uuid", "reason") == want
    again = results.upsert_results(merged.withColumn("seq", F.lit(0)), new)
    assert rows(again, "component", "uuid", "reason") == want


def test_result_file(spark, tmp_path):
    path = str(tmp_path / "r")
    assert read_results(spark, path).count() == 0
    df = result_rows(spark, [("b", "2", "x", 0), (None, "1", "é", 0)]).drop("seq")
    writers.write_results(df, path)
    lines = [line for part in sorted((tmp_path / "r").glob("part-*"))
             for line in part.read_text().splitlines()]
    assert [list(json.loads(x)) for x in lines] == [
        ["component", "uuid", "reason", "reasoning_trace"]] * 2
    assert [json.loads(x)["uuid"] for x in lines] == ["1", "2"]
    single = tmp_path / "lines.jsonl"
    single.write_text(lines[0] + "\nnot json\n" + lines[1].replace('"x"', '"first"') + "\n"
                      + lines[1].replace('"x"', '"last"') + "\n")
    assert rows(read_results(spark, str(single)), "uuid", "reason") == [("1", "é"), ("2", "last")]


def test_component_levels(spark):
    df = spark.createDataFrame([("aiops-k8s-08",), ("redis-cart",), ("redis-cart-0",), ("x",), (None,)],
                               "component string")
    found = results.component_check(df)
    assert rows(found) == [(None, "unknown", False), ("aiops-k8s-08", "node", True),
                           ("redis-cart", "service", True), ("redis-cart-0", "pod", True),
                           ("x", "unknown", False)]


def test_hot_deck(spark):
    full = [(f"c{i}", f"u{i}", "r", 0) for i in range(30)]
    gaps = [("", f"g{i}", "r", 0) for i in range(200)] + [(None, "h", None, 0)]
    df = result_rows(spark, full + gaps).drop("seq")
    found = results.hot_deck_fill(df)
    assert found.count() == 231
    assert found.where("borrowed").count() == 201
    assert found.where("component IS NULL OR component = ''").count() == 0
    assert found.where("borrowed").select("component").distinct().count() > 25
    untouched = results.hot_deck_fill(result_rows(spark, gaps).drop("seq"))
    assert untouched.where("borrowed").count() == 0 and untouched.count() == 201


def test_upsert_of_a_stored_path(spark, tmp_path):
    path = str(tmp_path / "results")
    writers.upsert_result_file(result_rows(spark, [("c1", "a", "r", 0), ("c2", "b", "r", 0)]), path)
    writers.upsert_result_file(result_rows(spark, [("c3", "b", "r", 1), ("c4", "b", "s", 2)]), path)
    stored = {r["uuid"]: r["component"] for r in read_results(spark, path).collect()}
    assert stored == {"a": "c1", "b": "c4"}
    (tmp_path / "results").rename(tmp_path / "results.next")  # as if ended before the swap
    writers.upsert_result_file(result_rows(spark, [("c5", "c", "r", 0)]), path)
    stored = {r["uuid"]: r["component"] for r in read_results(spark, path).collect()}
    assert stored == {"a": "c1", "b": "c4", "c": "c5"}
    assert not (tmp_path / "results.next").exists()


def test_calls(spark, tmp_path):
    path = str(tmp_path / "calls")
    df = spark.createDataFrame([("b", "t", "first", "p", "r"), ("a", "t", "first", "p", "r"),
                                ("a", "u", "second", "p2", "r2")],
                               "uuid string, timestamp string, call_type string, prompt string, "
                               "response string")
    writers.append_calls(df.limit(1), path)
    writers.append_calls(df.where("uuid = 'a'"), path)
    stored = read_calls(spark, path)
    assert rows(calls.call_stats(stored)) == [(2, 3)]
    report = calls.call_report(stored, ["timestamp"]).collect()
    assert [(r["uuid"], r["timestamp"]) for r in report] == [("a", "t"), ("a", "u"), ("b", "t")]
    assert report[1]["entry"] == "[second]\nprompt: p2\nresponse: r2"


def test_summary(spark):
    incidents = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")],
                                      "uuid string, hour_key string")
    hours = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "hour_key string")
    found = spark.createDataFrame([("a",), ("a",)], "uuid string")
    outcomes = summary.run_outcomes(incidents, hours, found)
    assert rows(outcomes) == [("a", "found", 2), ("b", "empty", 0), ("c", "no_file", 0)]
    assert rows(summary.run_summary(outcomes)) == [(3, 1, 1, 1, 2, 2)]


def test_bundle_switches(spark):
    incidents = spark.createDataFrame([("a",), ("b",), ("c",)], "uuid string")

    def text(pairs):
        return spark.createDataFrame(pairs, "uuid string, text string")

    log, trace, status = text([("a", "L")]), text([("a", "T")]), text([("a", "S"), ("b", "S")])
    every = evidence_bundle(incidents, log, trace, status)
    assert rows(every, "uuid", "sections") == [("a", "log,trace,status"), ("b", "status")]
    assert every.where("uuid = 'a'").first()["content"] == (
        "### log\nL\n### trace\nT\n### status\nS")
    tied = evidence_bundle(incidents, log, trace, status, status_alone=False)
    assert rows(tied, "uuid", "sections") == [("a", "log,trace,status")]
    assert rows(evidence_bundle(incidents, log), "uuid", "sections") == [("a", "log")]
    assert RESULT.fieldNames()[0] == "component"


def test_the_last_line_wins_over_files_by_name(spark, tmp_path):
    from triagelake.sources.results import read_results

    line = '{"component": "%s", "uuid": "u", "reason": "r", "reasoning_trace": []}\n'
    (tmp_path / "a.jsonl").write_text(line % "first" + " " * 5000 + "\n")
    (tmp_path / "b.jsonl").write_text(line % "second")
    assert [r.component for r in read_results(spark, str(tmp_path)).collect()] == ["second"]
