import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from triagelake.functions.texts import (
    csv_line, pod_of_file, service_alias, service_of_log_pod, service_of_metric_pod,
)
from triagelake.mask_rules import mask_rules
from triagelake.operators import logs, templates
from triagelake.plans import evidence

SCHEMA = "timestamp_ns long, row_id long, pod_name string, node_name string, message string"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_filters(spark):
    df = table(spark, [(1, 1, "p", "n", "an Error"), (2, 2, "p", "n", "fine"),
                       (3, 3, "p", "n", None), (4, 4, "p", "n", "ERROR java"),
                       (5, 5, "p", "n", "error Java")])
    assert rows(logs.error_logs(df), "row_id") == [(1,), (4,), (5,)]
    assert rows(logs.drop_injected(df), "row_id") == [(1,), (2,), (3,), (5,)]


def test_select_existing(spark):
    df = table(spark, [(1, 1, "p", "n", "m")])
    assert logs.select_existing(df, ["message", "nope", "row_id"]).columns == ["message", "row_id"]
    with pytest.raises(ValueError):
        logs.select_existing(df, ["nope"])


def test_dedup_keeps_first_row_and_null_groups(spark):
    df = spark.createDataFrame(
        [(5, 1, "p", "t", "late"), (3, 2, "p", "t", "b"), (3, 1, "p", "t", "a"),
         (1, 1, "p", None, "x"), (2, 1, "p", None, "y"), (9, 1, None, "t", "z")],
        "timestamp_ns long, row_id long, pod_name string, template string, message string")
    found = logs.dedup_first(df, ["pod_name", "template"], ["timestamp_ns", "row_id"], ["message"])
    assert rows(found) == [(None, "t", "z", 1), ("p", None, "x", 2), ("p", "t", "a", 3)]


def test_counts_sort_as_numbers(spark):
    df = spark.createDataFrame([("u", "a", 9), ("u", "b", 10), ("u", "c", 100), ("u", "d", 9)],
                               "uuid string, message string, occurrence_count long")
    ordered = logs.order_by_count(df, ["uuid"], ["message"]).orderBy("line_no")
    assert [r["message"] for r in ordered.collect()] == ["c", "b", "a", "d"]


def test_sampling_and_last_wins(spark):
    df = spark.range(50).selectExpr("id AS row_id", "concat('g', id % 2) AS pod_name")
    sampled = logs.sample_per_group(df, ["pod_name"], ["row_id"])
    assert rows(sampled.groupBy("pod_name").count()) == [("g0", 3), ("g1", 3)]
    assert rows(sampled) == rows(logs.sample_per_group(df.repartition(5), ["pod_name"], ["row_id"]))
    assert rows(logs.last_wins(df, ["pod_name"], ["row_id"])) == [("g0", 48), ("g1", 49)]


def test_names(spark):
    df = spark.createDataFrame([("redis-cart-0",), ("_odd",), (None,)], "p string")
    assert [r[0] for r in df.select(service_of_log_pod(F.col("p"))).collect()] == [
        "redis", "_odd", None]
    assert [r[0] for r in df.select(service_of_metric_pod(F.col("p"))).collect()] == [
        "redis", "_odd", None]
    assert [r[0] for r in df.select(service_alias(service_of_log_pod(F.col("p")))).collect()] == [
        "redis-cart", "_odd", None]
    files = spark.createDataFrame([("pod_cart-0_2025.parquet",), ("cart-1.parquet",)], "f string")
    assert [r[0] for r in files.select(pod_of_file(F.col("f"))).collect()] == ["cart-0", "cart-1"]


def test_csv_line(spark):
    df = spark.createDataFrame([('say "x", y', None, "a\nb", 5, "plain")],
                               "a string, b string, c string, d int, e string")
    line = df.select(csv_line(*[F.col(c) for c in "abcde"])).first()[0]
    assert line == '"say ""x"", y",,"a\nb",5,plain'


MESSAGES = [
    '{"error":"failed to get ads: rpc error: code = Unknown desc = ","http.req.path":"/"}',
    '{"error":"could not retrieve cart: rpc error: code = Unavailable desc = connection error: '
    'desc = \\"transport: Error while dialing dial tcp 10.233.1.2:7070: connect: connection '
    'refused\\"","http.req.method":"GET","http.req.path":"/cart"}',
    "error at 2025-06-06T01:02:03.456Z from 10.2.3.4 see https://a.b/c?d=1 and "
    "abcdefgh-abcd-1234-zzzz-abcdefghijkl",
    "at System.IO.Pipelines.Pipe.Get(int x) in /a/b.cs:line 44 ABCDEFGHIJ",
    "nothing special", "", None,
]


def test_full_masks_equal_sequential_replacement(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    found = {r["message"]: r["masked"] for r in templates.masked_messages(df).collect()}
    for text in MESSAGES:
        if text is None:
            continue
        want = text
        for name, pattern in mask_rules():
            want = re.sub(pattern, lambda _: f"<:{name}:>", want)
        assert found[text] == want
    assert None not in found


def test_generic_masks_agree_with_the_full_list_on_generic_text(spark):
    df = spark.createDataFrame([(MESSAGES[2],), ("é٣٤٥٦-٠٦-٠٦T٠١:٠٢:٠٣.٤Z",)], "message string")
    generic = {r["message"]: r["masked"] for r in templates.masked_messages(df, full=False).collect()}
    for text, masked in generic.items():
        want = text
        for name, pattern in mask_rules()[-4:]:
            want = re.sub(pattern, f"<:{name}:>", want)
        assert masked == want


LINES = (["open file a1 by bob"] * 3 + ["open file a2 by amy"] * 2
         + ["open port 7 by bob"] + ["single"] * 2 + ["other"] + ["1 22 x"] + ["2 33 y"]
         + ["a|b=c:d_e,f g"] + ["\u00a0open\u2003file b9 by kim"])


def mined(spark, lines, parts=1):
    df = spark.createDataFrame([(m,) for m in lines], "message string").repartition(parts)
    return rows(templates.mine_templates(df, full=False), "template", "size")


def test_mined_templates(spark):
    assert mined(spark, LINES) == [
        ("1 22 x", 1), ("2 33 y", 1), ("a b c d e f g", 1), ("open file <*> by <*>", 6),
        ("open port 7 by bob", 1), ("other", 1), ("single", 2)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_mining_does_not_depend_on_order(spark, parts):
    assert mined(spark, LINES[::-1], parts) == mined(spark, LINES)


def test_matching_never_grows_the_model(spark):
    train = spark.createDataFrame([(m,) for m in LINES[:6]], "message string")
    known = templates.mine_templates(train, full=False)
    fresh = spark.createDataFrame(
        [("open file z9 by joe",), ("open port 8 by joe",), ("open file z9 at joe",)],
        "message string")
    found = templates.match_templates(fresh, known, full=False)
    assert rows(found, "message", "template", "params") == [
        ("open file z9 at joe", None, None),
        ("open file z9 by joe", "open file <*> by <*>", ["z9", "joe"]),
        ("open port 8 by joe", None, None)]


def test_examples_are_distinct_and_limited(spark):
    df = spark.createDataFrame(
        [(i, f"open file {i % 7} ok") for i in range(20)], "row_id long, message string")
    known = templates.mine_templates(df, full=False)
    matched = templates.match_templates(df, known, full=False)
    found = templates.template_examples(df, matched, ["row_id"], limit=3)
    assert rows(found, "example_no", "message") == [
        (1, "open file 0 ok"), (2, "open file 1 ok"), (3, "open file 2 ok")]


def test_top_with_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "template_id string, size long")
    assert rows(templates.top_n_with_ties(df, 2), "template_id") == [("a",), ("b",), ("c",)]


def test_log_evidence_drops_injected_after_dedup(spark):
    data = [(10, 1, "cart-0", "n1", "error java x1"), (11, 2, "cart-0", "n1", "error plain x2"),
            (12, 3, "cart-0", "n1", "error plain x3"), (13, 4, "cart-1", "n1", "Error other"),
            (99, 5, "cart-1", "n1", "Error other"), (100, 6, "cart-1", "n1", "error late")]
    df = table(spark, data)
    incidents = spark.createDataFrame([("u", 10, 99)], "uuid string, start_ns long, end_ns long")
    known = templates.mine_templates(logs.error_logs(df), full=False)
    found = evidence.log_evidence(df, incidents, known, ["timestamp_ns", "row_id"])
    lines = evidence.evidence_lines(found, evidence.LOG_COLUMNS, "line_no", "occurrence_count")
    text = evidence.evidence_text(lines, evidence.LOG_COLUMNS, "log").first()["log"]
    assert text == (
        "node_name,service_name,pod_name,message,occurrence_count\n"
        "n1,cart,cart-0,error plain x2,出现次数:2\nn1,cart,cart-1,Error other,出现次数:2\n")


def test_entity_names(spark):
    df = spark.createDataFrame([("u", "a", "b"), ("u", "b", None)], "uuid string, x string, y string")
    assert rows(logs.entity_names(df, {"pod": ["x", "y"]})) == [("u", "pod", "a"), ("u", "pod", "b")]


def test_mask_rules_run_only_where_their_literals_are():
    runs = templates._in_runs(mask_rules())
    assert sum(len(members) for _, members in runs) == len(mask_rules()) and len(runs) < 60
    assert [label for _, members in runs for *_, label in members] == [
        f"<:{name}:>" for name, _ in mask_rules()]
    assert templates._literals(dict(mask_rules())["UID"]) == {"-": 4}
    assert templates._literals("ab?c[x]+d|e") == {}
