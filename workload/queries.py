"""Every operator as a query on the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.fixed_values import FOREST_TREES, MISSING_LABEL, REPORT_LABELS
from triagelake.functions import times
from triagelake.functions.numbers import round_even
from triagelake.functions.texts import service_alias, service_of_metric_pod
from triagelake.operators import (
    calls, detect, incidents, logs, metrics, ranks, results, stats, summary, templates, traces,
    windows,
)
from triagelake.plans import evidence
from triagelake.plans.training import load_or_train
from triagelake.schemas import INCIDENT_CSV
from triagelake.session import cut_lineage, new_path
from triagelake.sinks import writers
from triagelake.sources import telemetry
from triagelake.sources.incidents import read_incident_csv
from triagelake.sources.results import read_calls, read_evidence_text, read_results
from workload import views
from workload.oracle import (
    HOUR, count_csv, csv, describe, local, r6, sql, text_sql, variant,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ORDER = ["timestamp_ns", "row_id"]
STATS = [c for c in stats.STAT_COLUMNS if c != "n"]
INCIDENT_CSV_TYPES = {f.name: f.dataType for f in INCIDENT_CSV}


def query(name: str, oracle: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return build
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), digits) for c in columns})


def joined(column: str, by: str = ",") -> F.Column:
    return F.array_join(F.col(column), by).alias(column)


# Incidents

def timed_reports(spark, sf):
    return incidents.incident_times(views.reports(spark, sf))


def report_incidents(spark, sf):
    return incidents.incident_keys(timed_reports(spark, sf))


def report_table(spark, sf):
    """All reported incidents as a written list."""
    return cut_lineage(report_incidents(spark, sf).select("ord", "uuid", "start_ns", "end_ns"))


@query("incident_times", """SELECT uuid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start_text,
    strftime(te, '%Y-%m-%dT%H:%M:%SZ') AS end_text FROM rep_inc""")
def _(spark, sf):
    return timed_reports(spark, sf).select("uuid", "start_text", "end_text")


@query("incident_keys", """SELECT uuid, start_ns, end_ns,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d_%H-%M-%S') AS start_local,
    strftime(te + INTERVAL 8 HOUR, '%Y-%m-%d_%H-%M-%S') AS end_local,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS date,
    strftime(ts + INTERVAL 8 HOUR, '%H-00-00') AS hour,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d_%H') AS hour_key,
    (end_ns - start_ns) / 1e9 AS duration_s,
    round_even((end_ns - start_ns) / 6e10, 6) AS duration_min FROM rep_inc""")
def _(spark, sf):
    keyed = rounded(report_incidents(spark, sf), "duration_min")
    return keyed.drop("ord", "description", "event_type")


@query("incident_union", """SELECT uuid, ord + CASE WHEN event_type = 'error' THEN 0
    ELSE 281474976710656 END AS ord, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END
    AS INTEGER) AS list_no FROM reports""")
def _(spark, sf):
    reports = views.reports(spark, sf)
    error = F.col("event_type") == "error"
    both = incidents.union_lists(reports.where(error), reports.where(~error))
    return both.select("uuid", "ord", "list_no")


@query("normal_windows", """SELECT uuid, 'normal_before' AS kind, p + 600000000000 AS w_start_ns,
    start_ns AS w_end_ns FROM (SELECT *, lag(end_ns) OVER (ORDER BY ord) AS p FROM rep_inc)
    WHERE p IS NOT NULL UNION ALL
    SELECT uuid, 'normal_after', end_ns + 600000000000, n FROM
    (SELECT *, lead(start_ns) OVER (ORDER BY ord) AS n FROM rep_inc) WHERE n IS NOT NULL""")
def _(spark, sf):
    return windows.normal_windows(report_table(spark, sf))


@query("normal_windows_two_lists", """SELECT uuid, 'normal_before' AS kind,
    p + 600000000000 AS w_start_ns, start_ns AS w_end_ns FROM two_lists WHERE p IS NOT NULL
    UNION ALL SELECT uuid, 'normal_after', end_ns + 600000000000, n FROM two_lists
    WHERE n IS NOT NULL""")
def _(spark, sf):
    reports = views.reports(spark, sf)
    error = F.col("event_type") == "error"
    both = incidents.union_lists(*[
        incidents.incident_keys(incidents.incident_times(reports.where(part)))
        for part in (error, ~error)
    ])
    return windows.normal_windows(cut_lineage(both.select("ord", "uuid", "start_ns", "end_ns")))


@query("recovery_windows", """SELECT uuid, 'recovery' AS kind, end_ns AS w_start_ns,
    end_ns + 2400000000000 AS w_end_ns FROM rep_inc""")
def _(spark, sf):
    return windows.recovery_windows(report_table(spark, sf))


@query("sample_incidents", """SELECT uuid, start_ns FROM rep_inc
    ORDER BY md5(uuid || '|42'), uuid LIMIT 50""")
def _(spark, sf):
    return incidents.sample_incidents(report_table(spark, sf)).select("uuid", "start_ns")


@query("pending_incidents", """SELECT uuid FROM rep_inc WHERE uuid NOT IN
    (SELECT uuid FROM results WHERE component <> '' AND reason <> '')""")
def _(spark, sf):
    found = parsed_results(spark, sf)
    return incidents.pending_incidents(report_table(spark, sf), found).select("uuid")


# Normalisation

@query("normalize_logs", """SELECT event_id AS row_id, ts_ns + 123 AS timestamp_ns,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS time_local,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS date,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d_%H') AS hour_key FROM ev""")
def _(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = views.events(spark, sf).select(
        F.col("event_id").alias("row_id"), F.concat(text, F.lit("123Z")).alias("@timestamp"))
    done = telemetry.normalize_logs(raw)
    return done.select("row_id", "timestamp_ns", F.date_format(
        "time_local", "yyyy-MM-dd HH:mm:ss").alias("time_local"), "date", "hour_key")


@query("normalize_metrics", """SELECT event_id AS row_id,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000000 AS timestamp_ns,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS date FROM ev""")
def _(spark, sf):
    text = F.concat(F.date_format("ts", views.ISO), F.lit("Z"))
    raw = views.events(spark, sf).select(F.col("event_id").alias("row_id"), text.alias("time"))
    return telemetry.normalize_metrics(raw).select("row_id", "timestamp_ns", "date")


@query("normalize_spans", """SELECT span_id, timestamp_ns,
    strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d %H:%M:%S') AS time_utc,
    strftime(make_timestamp(timestamp_ns // 1000) + INTERVAL 8 HOUR, '%Y-%m-%d_%H') AS hour_key
    FROM spans""")
def _(spark, sf):
    done = telemetry.normalize_spans(views.raw_spans(spark, sf))
    return done.select(F.col("spanID").alias("span_id"), "timestamp_ns", F.date_format(
        "time_utc", "yyyy-MM-dd HH:mm:ss").alias("time_utc"), "hour_key")


@query("time_keys_ns", f"""SELECT row_id, hour_end, day_end,
    {local('hour_end', '%Y-%m-%d_%H')} AS last_key, {local('hour_end + 1', '%Y-%m-%d_%H')} AS
    next_key, {local('day_end', '%Y-%m-%d')} AS last_date FROM
    (SELECT event_id AS row_id, (ts_ns // {HOUR} + 1) * {HOUR} - 1 AS hour_end,
     ((ts_ns + 8 * {HOUR}) // (24 * {HOUR}) + 1) * 24 * {HOUR} - 8 * {HOUR} - 1 AS day_end
     FROM ev)""")
def _(spark, sf):
    hour_end = F.expr(f"(ts_ns div {HOUR} + 1) * {HOUR} - 1")
    day_end = F.expr(f"((ts_ns + {8 * HOUR}) div {24 * HOUR} + 1) * {24 * HOUR} - {8 * HOUR} - 1")
    rows = views.events(spark, sf).select(
        F.col("event_id").alias("row_id"), hour_end.alias("hour_end"), day_end.alias("day_end"))
    return rows.select(
        "*", times.local_hour_key(F.col("hour_end")).alias("last_key"),
        times.local_hour_key(F.col("hour_end") + 1).alias("next_key"),
        times.local_date(F.col("day_end")).alias("last_date"))


@query("unpivot_apm", """SELECT l_orderkey, l_linenumber, metric, value FROM
    (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
    UNPIVOT (value FOR metric IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def _(spark, sf):
    wide = views.table(spark, sf, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "no_such_metric"]
    return metrics.unpivot_wide(wide, ["l_orderkey", "l_linenumber"], measures)


HOT_HOUR = f"(1704067200000000000 + 50 * {HOUR})"


@query("windows_of_all_lengths", f"""SELECT uuid, kind, count(*) AS facts, min(t) AS first_ns,
    max(t) AS last_ns, CAST(sum(event_id) AS BIGINT) AS ids FROM
    (SELECT event_id, CASE WHEN k % 3 = 0 THEN {HOT_HOUR} + ts_ns % {HOUR} ELSE ts_ns END AS t
     FROM ev) JOIN
    (SELECT uuid, unnest(['second', 'day', 'month']) AS kind, unnest([start_ns - 30000000000,
     start_ns, end_ns - 30 * 24 * {HOUR}]) AS a, unnest([start_ns + 30000000000,
     start_ns + 72 * {HOUR}, end_ns]) AS b FROM incidents) ON t BETWEEN a AND b GROUP BY 1, 2""")
def _(spark, sf):
    """Windows of seconds, days and a month at once, and an hour that holds a third of all rows."""
    t = F.expr(f"CASE WHEN k % 3 = 0 THEN {HOT_HOUR} + ts_ns % {HOUR} ELSE ts_ns END")
    facts = views.events(spark, sf).select("event_id", t.alias("timestamp_ns"))
    day = 24 * HOUR
    spans = [("second", "start_ns - 30000000000", "start_ns + 30000000000"),
             ("day", "start_ns", f"start_ns + {3 * day}"), ("month", f"end_ns - {30 * day}", "end_ns")]
    each = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.expr(a).alias("w_start_ns"), F.expr(b).alias("w_end_ns"))
        for kind, a, b in spans])).alias("w")
    span = cut_lineage(incident_table(spark, sf).select("uuid", each).select("uuid", "w.*"))
    found = windows.interval_join(facts, span, broadcast_rows=0, salt_rows=500)
    return found.groupBy("uuid", "kind").agg(
        F.count(F.lit(1)).alias("facts"), F.min("timestamp_ns").alias("first_ns"),
        F.max("timestamp_ns").alias("last_ns"), F.sum("event_id").alias("ids"))


# Metrics

def incident_table(spark, sf):
    """The incident list as the written table it is in practice."""
    return cut_lineage(views.incidents(spark, sf))


def metric_windows(spark, sf, scope="full"):
    days = incident_table(spark, sf)
    return cut_lineage(windows.clip_to_start(windows.all_windows(days), days, scope))


def metric_table(spark, sf):
    """The long metric table, written once for jobs that look at it several times."""
    return cut_lineage(views.metrics(spark, sf))


def of_kind(spark, sf, kind, table=None):
    table = views.metrics(spark, sf) if table is None else table
    table = table.where(F.col("entity_kind") == kind)
    if kind == "node":
        return metrics.keep_entities(table, views.NODES)
    if kind == "pod":
        return metrics.drop_device(metrics.keep_entities(table, views.PODS))
    return table


def paired(spark, sf, kind, scope="full", table=None, span=None, **options):
    entity = ["service", "entity", "metric"] if kind == "apm_pod" else ["entity", "metric"]
    options.setdefault("keep_empty", kind == "apm_pod")
    return metrics.fault_vs_normal(
        of_kind(spark, sf, kind, table),
        metric_windows(spark, sf, scope) if span is None else span, entity, **options)


def paired_rounded(spark, sf, kind, **options):
    names = [f"{side}_{c}" for side in metrics.SIDES for c in STATS]
    return rounded(paired(spark, sf, kind, **options), *names)


def describe_all(spark, sf, hot_rows=stats.HOT_GROUP_ROWS, trim=None):
    keys = ["entity_kind", "entity", "metric"]
    done = stats.describe(views.metrics(spark, sf), keys, hot_rows=hot_rows, trim=trim)
    return rounded(done, *STATS)


DESCRIBE_SQL = describe("metrics", "entity_kind, entity, metric")
TRIM_SQL = describe("""(SELECT *, row_number() OVER (p ORDER BY value NULLS LAST) AS rn,
    count(value) OVER p AS c FROM metrics
    WINDOW p AS (PARTITION BY entity_kind, entity, metric))""",
    "entity_kind, entity, metric", "c <= 4 OR (rn > 2 AND rn <= c - 2)")


@query("describe_metrics", DESCRIBE_SQL)
def _(spark, sf):
    return describe_all(spark, sf)


@query("describe_metrics_split", DESCRIBE_SQL)
def _(spark, sf):
    return describe_all(spark, sf, hot_rows=500)


@query("trimmed_describe", TRIM_SQL)
def _(spark, sf):
    return describe_all(spark, sf, trim=F.lit(True))


@query("trimmed_describe_split", TRIM_SQL)
def _(spark, sf):
    return describe_all(spark, sf, hot_rows=500, trim=F.lit(True))


@query("describe_in_range", "SELECT * FROM pod_s_stats WHERE n > 0")
def _(spark, sf):
    done = metrics.describe_in_windows(
        of_kind(spark, sf, "pod"), metric_windows(spark, sf), ["entity", "metric"])
    return rounded(done, *STATS)


@query("service_fault_vs_normal", "SELECT * FROM apm_s_paired")
def _(spark, sf):
    return paired_rounded(spark, sf, "apm_pod")


@query("node_fault_vs_normal", "SELECT * FROM node_s_paired")
def _(spark, sf):
    return paired_rounded(spark, sf, "node")


@query("pod_fault_vs_normal", "SELECT * FROM pod_s_paired")
def _(spark, sf):
    return paired_rounded(spark, sf, "pod")


@query("pod_fault_vs_normal_start_day", "SELECT * FROM day_s_paired")
def _(spark, sf):
    return paired_rounded(spark, sf, "pod", scope="day")


@query("db_fault_vs_normal", "SELECT * FROM db_s_paired")
def _(spark, sf):
    return paired_rounded(spark, sf, "db_component")


DEVIATION = ["normal_p50", "normal_p99", "fault_p50", "fault_p99", "normal_iqr", "fault_iqr",
             "p50_ratio", "p99_ratio"]


@query("metric_deviation", f"""SELECT uuid, service, entity, metric,
    {', '.join(f'{r6(c)} AS {c}' for c in DEVIATION)}, {"coalesce(p50_ratio < 0.05 AND p99_ratio < 0.05, false)"} AS stable
    FROM apm_s_dev""")
def metric_deviation(spark, sf):
    done = metrics.with_deviation(paired(spark, sf, "apm_pod")).withColumn(
        "stable", metrics.is_stable())
    return rounded(done.select("uuid", "service", "entity", "metric", *DEVIATION, "stable"),
                   *DEVIATION)


@query("node_pod_map", "SELECT * FROM placement")
def _(spark, sf):
    pods = views.metrics(spark, sf).where(F.col("entity_kind") == "pod")
    return metrics.node_pod_map(pods, views.NODES)


@query("node_pod_map_fallback", f"""SELECT d.date, d.node, p.pod FROM
    (SELECT date, unnest([{', '.join(f"'{n}'" for n in views.NODES)}]) AS node FROM days) d
    LEFT JOIN (SELECT DISTINCT date, instance AS node, entity AS pod FROM metrics
    WHERE entity_kind = 'pod' AND metric = 'pod_cpu_usage') p USING (date, node)""")
def _(spark, sf):
    pods = views.metrics(spark, sf).where(F.col("entity_kind") == "pod")
    return metrics.node_pod_map(pods, views.NODES, preferred="no_such_metric")


@query("service_rollup", "SELECT * FROM service_pods")
def _(spark, sf):
    return metrics.service_rollup(paired(spark, sf, "apm_pod"))


@query("system_totals", """SELECT uuid, count(*) AS microservices,
    CAST(sum(pod_count) AS BIGINT) AS pods, any_value(c) AS components FROM service_pods JOIN
    (SELECT uuid, count(DISTINCT entity) AS c FROM db_s_paired GROUP BY 1) USING (uuid) GROUP BY 1""")
def _(spark, sf):
    span = metric_windows(spark, sf)
    pods = metrics.service_rollup(paired(spark, sf, "apm_pod", span=span))
    return metrics.system_totals(pods, paired(spark, sf, "db_component", span=span))


@query("metric_coverage", """SELECT uuid, count(*) AS metric_count,
    string_agg(metric, ',' ORDER BY metric) AS metric_list,
    string_agg(label, ',' ORDER BY label) AS label_list FROM (SELECT DISTINCT uuid, metric,
    CASE metric WHEN 'node_cpu_usage_rate' THEN 'CPU使用率' WHEN 'node_memory_usage_rate'
    THEN '内存使用率' ELSE metric END AS label FROM node_s_paired) GROUP BY 1""")
def _(spark, sf):
    return metrics.metric_coverage(paired(spark, sf, "node"))


@query("service_db_report", f"""SELECT uuid, service, entity, metric, status,
    {', '.join(REPORT_LABELS)} FROM apm_report UNION ALL SELECT uuid, '' AS service, entity,
    metric, status, {', '.join(REPORT_LABELS)} FROM db_report""")
def _(spark, sf):
    table, span = metric_table(spark, sf), metric_windows(spark, sf)
    service = metrics.report_rows(
        paired(spark, sf, "apm_pod", table=table, span=span), ["service", "entity", "metric"])
    entity = ["entity", "metric"]
    grid = metrics.presence_grid(
        of_kind(spark, sf, "db_component", table), incident_table(spark, sf), entity)
    db = metrics.report_rows(
        paired(spark, sf, "db_component", table=table, span=span), entity, grid)
    return service.unionByName(db.withColumn("service", F.lit("")))


@query("node_report", "SELECT * FROM node_rows")
def _(spark, sf):
    days, table, span = incident_table(spark, sf), metric_table(spark, sf), metric_windows(spark, sf)
    entity = ["entity", "metric"]
    rows = {
        kind: metrics.report_rows(
            paired(spark, sf, kind, table=table, span=span), entity,
            metrics.presence_grid(of_kind(spark, sf, kind, table), days, entity))
        for kind in ("node", "pod")
    }
    pods = table.where(F.col("entity_kind") == "pod")
    placement = metrics.node_pod_map(pods, views.NODES)
    return metrics.node_pod_rows(rows["node"], rows["pod"], placement, days)


def metric_rows(spark, sf, scope="full"):
    return evidence.metric_evidence(
        metric_table(spark, sf), incident_table(spark, sf), views.NODES, views.PODS,
        views.DB_PAIRS, scope=scope)


METRIC_KEYS = ["section", "service", "node", "entity", "metric"]
METRIC_COLUMNS = [*METRIC_KEYS, "status", *REPORT_LABELS]


@query("metric_evidence", "SELECT * FROM metric_rows")
def _(spark, sf):
    return metric_rows(spark, sf)


@query("metric_evidence_start_day",
       variant("_d", "all_w", "day_w", "SELECT * FROM metric_rows"))
def _(spark, sf):
    return metric_rows(spark, sf, "day")


REPORT_MEMBER = "'\"' || metric || '\":{' || " + " || ',' || ".join(
    f"'\"{label}\":' || CAST({c} AS VARCHAR)" for c, label in REPORT_LABELS.items()) + " || '}'"


def _object_sql(source: str, member: str, keys: str) -> str:
    return (f"SELECT {keys}, '{{' || string_agg({member}, ',' ORDER BY {member}) || '}}' AS j "
            f"FROM ({source}) GROUP BY ALL")


@query("metric_report_json", "SELECT uuid, j AS report FROM (" + _object_sql(
    _object_sql(_object_sql("SELECT * FROM apm_report", REPORT_MEMBER, "uuid, service, entity"),
                "'\"' || entity || '\":' || j", "uuid, service"),
    "'\"' || service || '\":' || j", "uuid") + ")")
def _(spark, sf):
    rows = metric_rows(spark, sf).where(F.col("section") == "microservice")
    return evidence.metric_report_json(rows, ["service", "entity"])


MEMBER_OR_MARK = (f"CASE WHEN status = 'ok' THEN {REPORT_MEMBER} ELSE "
                  f"'\"' || metric || '\":\"{MISSING_LABEL}\"' END")


def _section_json_sql(section: str, level: str) -> str:
    rows = f"SELECT * FROM metric_rows WHERE section = '{section}'"
    return "SELECT uuid, j AS report FROM (" + _object_sql(
        _object_sql(rows, MEMBER_OR_MARK, f"uuid, {level}"),
        f"'\"' || {level} || '\":' || j", "uuid") + ")"


@query("metric_report_json_db", _section_json_sql("db_component", "entity"))
def _(spark, sf):
    rows = metric_rows(spark, sf).where(F.col("section") == "db_component")
    return evidence.metric_report_json(rows, ["entity"])


@query("metric_report_json_node", _section_json_sql("node", "node"))
def _(spark, sf):
    rows = metric_rows(spark, sf).where(F.col("section") == "node")
    return evidence.metric_report_json(rows, ["node"])


# Logs

def fault_logs(spark, sf, scope="full"):
    days = incident_table(spark, sf)
    span = windows.clip_to_start(windows.fault_windows(days), days, scope)
    return windows.in_windows(
        views.logs(spark, sf), span, [*ORDER, "pod_name", "node_name", "message"])


@query("log_time_range", "SELECT uuid, row_id, timestamp_ns FROM fault_logs")
def _(spark, sf):
    return fault_logs(spark, sf).select("uuid", "row_id", "timestamp_ns")


@query("log_time_range_start_hour", """SELECT w.uuid, l.row_id, l.timestamp_ns FROM logs l
    JOIN hour_w w ON l.timestamp_ns BETWEEN w.w_start_ns AND w.w_end_ns""")
def _(spark, sf):
    return fault_logs(spark, sf, "hour").select("uuid", "row_id", "timestamp_ns")


@query("error_logs", "SELECT row_id, pod_name, message FROM error_rows")
def _(spark, sf):
    return logs.error_logs(views.logs(spark, sf)).select("row_id", "pod_name", "message")


@query("drop_injected", """SELECT row_id, message FROM logs
    WHERE NOT coalesce(contains(message, 'java'), false)""")
def _(spark, sf):
    return logs.drop_injected(views.logs(spark, sf)).select("row_id", "message")


@query("select_existing", "SELECT pod_name, message, row_id FROM logs")
def _(spark, sf):
    return logs.select_existing(views.logs(spark, sf), ["pod_name", "no_such", "message", "row_id"])


def error_templates(spark, sf):
    return templates.mine_templates(logs.error_logs(views.logs(spark, sf)))


def tagged_logs(spark, sf):
    rows = logs.error_logs(fault_logs(spark, sf))
    matched = templates.match_templates(rows, error_templates(spark, sf))
    return templates.attach_templates(rows, matched)


@query("template_counts", """SELECT uuid, pod_name, template, count(*) AS occurrence_count
    FROM tagged GROUP BY ALL""")
def _(spark, sf):
    return logs.template_counts(tagged_logs(spark, sf), ["uuid", "pod_name", "template"])


@query("dedup_first", "SELECT * FROM deduped")
def _(spark, sf):
    return logs.dedup_first(tagged_logs(spark, sf), ["uuid", "pod_name", "template"], ORDER,
                            ["node_name", "message"])


def log_rows(spark, sf, scope="full"):
    return evidence.log_evidence(views.logs(spark, sf), incident_table(spark, sf),
                                 error_templates(spark, sf), ORDER, scope)


@query("sort_logs_by_count", """SELECT uuid, line_no, occurrence_count,
    '出现次数:' || CAST(occurrence_count AS VARCHAR) AS label FROM log_ev""")
def _(spark, sf):
    label = F.concat(F.lit("出现次数:"), F.col("occurrence_count").cast("string"))
    return log_rows(spark, sf).select("uuid", "line_no", "occurrence_count", label.alias("label"))


@query("sample_per_group", """SELECT pod_name, row_id FROM logs QUALIFY row_number() OVER
    (PARTITION BY pod_name ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) <= 3""")
def _(spark, sf):
    sampled = logs.sample_per_group(views.logs(spark, sf), ["pod_name"], ["row_id"])
    return sampled.select("pod_name", "row_id")


@query("last_wins", """SELECT pod_name, node_name, max(row_id) AS row_id FROM logs GROUP BY 1, 2""")
def _(spark, sf):
    table = views.logs(spark, sf).select("pod_name", "node_name", *ORDER)
    return logs.last_wins(table, ["pod_name", "node_name"], ORDER).drop("timestamp_ns")


@query("first_in_group", "SELECT * FROM callers")
def _(spark, sf):
    known = fault_paths(spark, sf).where(traces.known_path())
    return logs.first_in_group(known, ["uuid", *traces.PATH], ORDER, ["node_name", "service_name"])


@query("error_log_evidence", "SELECT * FROM log_ev")
def _(spark, sf):
    return log_rows(spark, sf)


@query("error_log_evidence_start_hour", variant("_h", "fault_w", "hour_w", "SELECT * FROM log_ev"))
def _(spark, sf):
    return log_rows(spark, sf, "hour")


@query("entity_sets", """SELECT DISTINCT uuid, kind, name FROM (
    SELECT uuid, 'log_pod' AS kind, pod_name AS name FROM log_ev
    UNION ALL SELECT uuid, 'log_service', service_name FROM log_ev
    UNION ALL SELECT uuid, 'log_node', node_name FROM log_ev
    UNION ALL SELECT uuid, 'trace_pod', child_pod FROM trace_ev
    UNION ALL SELECT uuid, 'trace_pod', parent_pod FROM trace_ev
    UNION ALL SELECT uuid, 'trace_service', service_name FROM trace_ev
    UNION ALL SELECT uuid, 'trace_node', node_name FROM trace_ev) WHERE name IS NOT NULL""")
def _(spark, sf):
    own = logs.entity_names(log_rows(spark, sf), {
        "log_pod": ["pod_name"], "log_service": ["service_name"], "log_node": ["node_name"]})
    calls_ = logs.entity_names(trace_rows(spark, sf), {
        "trace_pod": ["child_pod", "parent_pod"], "trace_service": ["service_name"],
        "trace_node": ["node_name"]})
    return own.unionByName(calls_)


# Templates

@query("mask_messages", "SELECT message, masked FROM short_masked")
def _(spark, sf):
    return templates.masked_messages(views.messages(spark, sf), full=False)


@query("mask_messages_full", "SELECT message, masked FROM full_masked")
def _(spark, sf):
    return templates.masked_messages(views.messages(spark, sf), full=True)


@query("tokenize", "SELECT masked, array_to_string(tokens, ' ') AS tokens, template_id FROM mt_leaf")
def _(spark, sf):
    masked = templates.masked_messages(views.messages(spark, sf))
    return templates.tokenized(masked.select("masked").distinct()).select(
        "masked", joined("tokens", " "), "template_id")


def mined(spark, sf):
    return templates.mine_templates(views.messages(spark, sf))


@query("mine_templates", """SELECT template_id, template, size FROM mt_templates""")
def _(spark, sf):
    return mined(spark, sf).select("template_id", "template", "size")


@query("match_templates", "SELECT message, template_id, template FROM lm_matched")
def _(spark, sf):
    matched = templates.match_templates(views.logs(spark, sf), error_templates(spark, sf))
    return matched.select("message", "template_id", "template")


@query("template_params", """SELECT message, array_to_string(params, '|') AS params FROM lm_matched
    WHERE template IS NOT NULL""")
def _(spark, sf):
    matched = templates.match_templates(views.logs(spark, sf), error_templates(spark, sf))
    return matched.where(F.col("template").isNotNull()).select("message", joined("params", "|"))


@query("template_catalogue", "SELECT template_id, template, size AS count FROM mt_templates")
def _(spark, sf):
    return templates.template_catalogue(mined(spark, sf))


@query("template_examples", """SELECT template_id, example_no, message FROM
    (SELECT m.template_id, m.message, row_number() OVER (PARTITION BY m.template_id
     ORDER BY s.timestamp_ns, s.row_id, m.message) AS example_no FROM
     (SELECT message, min(timestamp_ns) AS timestamp_ns, min(row_id) AS row_id FROM logs
      GROUP BY 1) s JOIN lm_matched m USING (message) WHERE m.template_id IS NOT NULL)
    WHERE example_no <= 1000""")
def _(spark, sf):
    table = views.logs(spark, sf)
    matched = templates.match_templates(table, error_templates(spark, sf))
    return templates.template_examples(table, matched, ORDER)


@query("top_n_with_ties", """SELECT template_id, size FROM mt_templates WHERE size >=
    (SELECT min(size) FROM (SELECT size FROM mt_templates ORDER BY size DESC LIMIT 1000))""")
def _(spark, sf):
    return templates.top_n_with_ties(mined(spark, sf)).select("template_id", "size")


@query("top_20_with_ties", """SELECT template_id, size FROM mt_templates WHERE size >=
    (SELECT min(size) FROM (SELECT size FROM mt_templates ORDER BY size DESC LIMIT 20))""")
def _(spark, sf):
    return templates.top_n_with_ties(mined(spark, sf), n=20).select("template_id", "size")


# Spans

def spans(spark, sf):
    return traces.span_fields(views.raw_spans(spark, sf), ["row_id"])


@query("span_fields", """SELECT span_id, parent_span_id, timestamp_ns, duration, operation, pod,
    service_name, node_name FROM spans""")
def _(spark, sf):
    return spans(spark, sf).drop("tags", "row_id")


@query("status_tags", "SELECT span_id, status_code, status_message FROM spans")
def _(spark, sf):
    return traces.status_tags(spans(spark, sf)).select("span_id", "status_code", "status_message")


@query("abnormal_status", "SELECT span_id, status_code FROM spans WHERE status_code <> '0'")
def _(spark, sf):
    return traces.abnormal_status(spans(spark, sf)).select("span_id", "status_code")


def fault_paths(spark, sf, **options):
    return evidence.fault_call_paths(
        spans(spark, sf), incident_table(spark, sf), ORDER, **options)


@query("span_time_range", "SELECT uuid, span_id, timestamp_ns FROM fault_spans")
def _(spark, sf):
    span = windows.fault_windows(incident_table(spark, sf))
    return windows.interval_join(spans(spark, sf), span).select("uuid", "span_id", "timestamp_ns")


@query("span_parent_join", "SELECT uuid, span_id, parent_pod, child_pod, operation FROM paths")
def _(spark, sf):
    return fault_paths(spark, sf).select("uuid", "span_id", *traces.PATH)


@query("span_parent_padded", "SELECT uuid, span_id, parent_pod, child_pod, operation FROM padded_paths")
def _(spark, sf):
    """Parents are looked up two hours around the window too."""
    found = fault_paths(spark, sf, pad_ns=views.PAD)
    return found.select("uuid", "span_id", *traces.PATH)


@query("span_parent_service", """SELECT span_id, parent_pod, parent_service,
    CASE service_name WHEN 'redis' THEN 'redis-cart' ELSE service_name END AS service_name,
    split_part(child_pod, '-', 1) AS pod_service,
    concat_ws('_', parent_pod, child_pod, operation) AS call_path FROM train_spans""")
def _(spark, sf):
    joined_ = evidence.training_spans(
        spans(spark, sf), sampled(spark, sf), ORDER, views.RECOVERY)
    return joined_.select(
        "span_id", "parent_pod", "parent_service",
        service_alias(F.col("service_name")).alias("service_name"),
        service_of_metric_pod(F.col("child_pod")).alias("pod_service"),
        F.concat_ws("_", *traces.PATH).alias("call_path"))


@query("status_combinations", "SELECT * FROM status_top")
def _(spark, sf):
    return traces.status_combinations(fault_paths(spark, sf), ["uuid"])


def sampled(spark, sf):
    return cut_lineage(incidents.sample_incidents(views.incidents(spark, sf), views.SAMPLE_N))


def train_bins(spark, sf):
    return cut_lineage(evidence.training_bins(
        spans(spark, sf), sampled(spark, sf), ORDER, views.RECOVERY, views.BIN))


def fault_bins(spark, sf):
    known = fault_paths(spark, sf).where(traces.known_path())
    return traces.window_mean_duration(known, ["uuid", *traces.PATH], views.BIN)


@query("window_mean_duration", f"""SELECT uuid, parent_pod, child_pod, operation, bin_start_ns,
    {r6('mean_duration')} AS mean_duration, spans FROM fault_bins""")
def _(spark, sf):
    return rounded(fault_bins(spark, sf), "mean_duration")


@query("baseline_stats", f"""SELECT parent_pod, child_pod, operation, {r6('avg(mean_duration)')} AS
    mean, {r6('stddev_pop(mean_duration)')} AS std,
    {r6('quantile_cont(mean_duration, 0.5)')} AS median, {r6('min(mean_duration)')} AS min,
    {r6('max(mean_duration)')} AS max, count(*) AS count FROM train_bins GROUP BY ALL""")
def _(spark, sf):
    done = traces.baseline_stats(train_bins(spark, sf))
    return rounded(done, "mean", "std", "median", "min", "max")


@query("normal_trace_groups", """SELECT uuid, parent_pod, child_pod, operation, count(*) AS spans,
    min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM quiet_spans GROUP BY ALL""")
def _(spark, sf):
    sample = sampled(spark, sf)
    around = evidence.training_spans(spans(spark, sf), sample, ORDER, views.RECOVERY)
    quiet = windows.interval_join(around, windows.recovery_windows(sample, views.RECOVERY))
    return traces.normal_trace_groups(quiet, ["uuid"])


@query("span_profile", """SELECT count(*) AS spans, count(DISTINCT pod) AS pods,
    count(DISTINCT service_name) AS services, count(DISTINCT node_name) AS nodes,
    count(DISTINCT span_id) AS span_ids, min(timestamp_ns) AS first_ns,
    max(timestamp_ns) AS last_ns FROM spans""")
def _(spark, sf):
    return traces.span_profile(spans(spark, sf))


# Detection

def band(spark, sf):
    return detect.quantile_model(train_bins(spark, sf), views.CONTAMINATION)


@query("quantile_detector", f"""SELECT uuid, parent_pod, child_pod, operation, bin_start_ns,
    {r6('mean_duration')} AS mean_duration, spans FROM bad_bins""")
def _(spark, sf):
    events = detect.quantile_events(fault_bins(spark, sf), band(spark, sf))
    return rounded(events, "mean_duration")


def trace_rows(spark, sf, paths=None):
    base = train_bins(spark, sf)
    found = evidence.trace_evidence(
        fault_paths(spark, sf) if paths is None else paths, detect.quantile_model(base, views.CONTAMINATION),
        traces.baseline_stats(base), ORDER, views.BIN)
    return rounded(found, "normal_avg_duration", "anomaly_avg_duration")


@query("anomaly_combinations", "SELECT * FROM trace_ev")
def _(spark, sf):
    bins = train_bins(spark, sf)
    model = detect.quantile_model(bins, views.CONTAMINATION)
    events = detect.quantile_events(fault_bins(spark, sf), model)
    known = fault_paths(spark, sf).where(traces.known_path())
    callers = logs.first_in_group(
        known, ["uuid", *traces.PATH], ORDER, ["node_name", "service_name"])
    found = detect.anomaly_combinations(events, callers, traces.baseline_stats(bins), ["uuid"])
    return rounded(found, "normal_avg_duration", "anomaly_avg_duration")


@query("trace_evidence", "SELECT * FROM trace_ev")
def _(spark, sf):
    return trace_rows(spark, sf)


@query("status_combinations_start_hour", "SELECT * FROM status_top_h")
def _(spark, sf):
    return traces.status_combinations(fault_paths(spark, sf, scope="hour"), ["uuid"])


@query("trace_evidence_start_hour", "SELECT * FROM trace_ev_h")
def _(spark, sf):
    return trace_rows(spark, sf, fault_paths(spark, sf, scope="hour"))


def forest(spark, sf, bins=None):
    bins = train_bins(spark, sf) if bins is None else bins
    return detect.train_forest(bins, contamination=views.CONTAMINATION)


@query("train_forest", f"""SELECT parent_pod, child_pod, operation, tree, node, depth, n,
    {r6('threshold')} AS threshold FROM forest_nodes""")
def _(spark, sf):
    """Every node of every tree with the point where it splits its values."""
    nodes = detect.grow_forest(train_bins(spark, sf))
    return rounded(nodes.drop("samples", "low", "high"), "threshold")


@query("forest_models", f"""SELECT parent_pod, child_pod, operation, {FOREST_TREES} AS trees,
    train_bins, {r6('cutoff')} AS cutoff FROM forest_cuts""")
def _(spark, sf):
    return rounded(forest(spark, sf), "cutoff").drop("abnormal")


@query("forest_flagged_share", f"""SELECT parent_pod, child_pod, operation, count(*) AS bins,
    CAST(sum(CASE WHEN score < cutoff THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
    sum(CASE WHEN score < cutoff THEN 1 ELSE 0 END) <= ceil(count(*) * {views.CONTAMINATION})
    AS within FROM forest_train JOIN forest_cuts USING (parent_pod, child_pod, operation)
    GROUP BY ALL""")
def _(spark, sf):
    """How many training bins each path's forest flags, and whether that keeps to its share."""
    bins = train_bins(spark, sf)
    model = cut_lineage(forest(spark, sf, bins))
    found = detect.forest_events(bins, model).groupBy(*traces.PATH).agg(
        F.count(F.lit(1)).alias("_flagged"))
    sizes = bins.groupBy(*traces.PATH).agg(F.count(F.lit(1)).alias("bins"))
    flagged = F.coalesce("_flagged", F.lit(0))
    within = flagged <= F.ceil(F.col("bins") * F.lit(views.CONTAMINATION))
    return sizes.join(found, traces.PATH, "left").select(
        *traces.PATH, "bins", flagged.alias("flagged"), within.alias("within"))


@query("stored_baseline", f"""SELECT parent_pod, child_pod, operation, {r6('avg(mean_duration)')} AS
    mean, count(*) AS count FROM train_bins GROUP BY ALL""")
def _(spark, sf):
    path = new_folder(spark)
    for _ in range(2):
        _, base = load_or_train(
            spark, path, spans(spark, sf), incident_table(spark, sf), ORDER, views.SAMPLE_N,
            recovery_ns=views.RECOVERY, bin_ns=views.BIN, contamination=views.CONTAMINATION)
    return rounded(base, "mean").select(*traces.PATH, "mean", "count")


@query("score_forest", f"""SELECT uuid, parent_pod, child_pod, operation, bin_start_ns,
    {r6('mean_duration')} AS mean_duration, spans FROM forest_bad""")
def _(spark, sf):
    events = detect.forest_events(fault_bins(spark, sf), forest(spark, sf))
    return rounded(events, "mean_duration")


@query("load_or_train", "SELECT * FROM forest_ev")
def _(spark, sf):
    path = new_folder(spark)
    for _ in range(2):
        model, base = load_or_train(
            spark, path, spans(spark, sf), incident_table(spark, sf), ORDER, views.SAMPLE_N,
            recovery_ns=views.RECOVERY, bin_ns=views.BIN, contamination=views.CONTAMINATION)
    found = evidence.trace_evidence(
        fault_paths(spark, sf), model, base, ORDER, views.BIN, find=detect.forest_events)
    return rounded(found, "normal_avg_duration", "anomaly_avg_duration")


# Bundle

def bundle_parts(spark, sf):
    lines = evidence.evidence_lines
    log = lines(log_rows(spark, sf), evidence.LOG_COLUMNS, "line_no", "occurrence_count")
    paths = cut_lineage(fault_paths(spark, sf))
    trace = lines(trace_rows(spark, sf, paths), evidence.TRACE_COLUMNS, "rank_no",
                  "anomaly_count")
    status = lines(traces.status_combinations(paths, ["uuid"]),
                   evidence.STATUS_COLUMNS, "rank_no", "occurrence_count")
    numbered = metric_rows(spark, sf).withColumn("line_no", F.array_join(F.array(*METRIC_KEYS), "/"))
    metric = lines(numbered, METRIC_COLUMNS, "line_no", "")
    return {
        "log_text": evidence.evidence_text(log, evidence.LOG_COLUMNS, "log"),
        "trace_text": evidence.evidence_text(trace, evidence.TRACE_COLUMNS, "trace"),
        "status_text": evidence.evidence_text(status, evidence.STATUS_COLUMNS, "status"),
        "metric_text": evidence.evidence_text(metric, METRIC_COLUMNS, "metric"),
    }


def _bundle_sql(kinds: list[str], status_alone: bool = True) -> str:
    source = {
        "log": (f"SELECT uuid, line_no, {count_csv(evidence.LOG_COLUMNS, 'occurrence_count')} "
                "AS line FROM log_ev", evidence.LOG_COLUMNS),
        "trace": (f"SELECT uuid, rank_no AS line_no, "
                  f"{count_csv(evidence.TRACE_COLUMNS, 'anomaly_count')} AS line FROM trace_ev",
                  evidence.TRACE_COLUMNS),
        "status": (f"SELECT uuid, rank_no AS line_no, "
                   f"{count_csv(evidence.STATUS_COLUMNS, 'occurrence_count')} AS line "
                   "FROM status_top", evidence.STATUS_COLUMNS),
        "metric": (f"SELECT uuid, concat_ws('/', {', '.join(METRIC_KEYS)}) AS line_no, "
                   f"{csv(*METRIC_COLUMNS)} AS line FROM metric_rows", METRIC_COLUMNS),
    }
    joins, shown = "", []
    for kind in kinds:
        lines, columns = source[kind]
        joins += (f" LEFT JOIN (SELECT uuid, text AS t_{kind} FROM "
                  f"({text_sql(lines, ','.join(columns))})) USING (uuid)")
        text = f"t_{kind}"
        if kind == "status" and not status_alone:
            text = "CASE WHEN t_trace IS NOT NULL THEN t_status END"
        shown.append((kind, text))
    names = ", ".join(f"CASE WHEN {t} IS NOT NULL THEN '{k}' END" for k, t in shown)
    texts = ", ".join(f"'### {k}' || chr(10) || {t}" for k, t in shown)
    return (f"SELECT * FROM (SELECT uuid, concat_ws(',', {names}) AS sections, "
            f"concat_ws(chr(10), {texts}) AS content FROM incidents{joins}) WHERE sections <> ''")


@query("evidence_bundle", _bundle_sql(["log", "trace", "status", "metric"]))
def _(spark, sf):
    return evidence.evidence_bundle(incident_table(spark, sf), **bundle_parts(spark, sf))


@query("evidence_bundle_log_trace", _bundle_sql(["log", "trace", "status"], status_alone=False))
def _(spark, sf):
    parts = bundle_parts(spark, sf)
    parts.pop("metric_text")
    return evidence.evidence_bundle(
        incident_table(spark, sf), **parts, status_alone=False)


@query("evidence_text", "SELECT * FROM (" + text_sql(
    f"SELECT uuid, line_no, {count_csv(evidence.LOG_COLUMNS, 'occurrence_count')} AS line "
    "FROM log_ev", ",".join(evidence.LOG_COLUMNS)) + ")")
def _(spark, sf):
    lines = evidence.evidence_lines(
        log_rows(spark, sf), evidence.LOG_COLUMNS, "line_no", "occurrence_count")
    return evidence.evidence_text(lines, evidence.LOG_COLUMNS, "text")


@query("evidence_text_lines", f"""SELECT uuid, line_no,
    {count_csv(evidence.LOG_COLUMNS, 'occurrence_count')} AS line FROM log_ev""")
def _(spark, sf):
    """The stored text of the incidents, read back line by line in its order."""
    path = new_folder(spark)
    lines = evidence.evidence_lines(
        log_rows(spark, sf), evidence.LOG_COLUMNS, "line_no", "occurrence_count")
    writers.write_evidence_text(lines, path)
    return read_evidence_text(spark, path)


@query("spans_numbered", """SELECT span_id, CAST(row_number() OVER (PARTITION BY big
    ORDER BY timestamp_ns, span_id) AS BIGINT) AS line_no FROM (SELECT span_id, timestamp_ns,
    CASE WHEN hash_no < 9 THEN 'most' ELSE 'rest' END AS big
    FROM (SELECT *, ascii(right(md5(span_id), 1)) % 10 AS hash_no FROM spans))""")
def _(spark, sf):
    """Numbers inside groups of which one holds most rows and is spread over many tasks."""
    table = spans(spark, sf)
    digit = F.ascii(F.right(F.md5("span_id"), F.lit(1))) % 10
    big = F.when(digit < 9, F.lit("most")).otherwise(F.lit("rest"))
    rows = table.select("span_id", "timestamp_ns", big.alias("big"))
    found = ranks.numbered(rows, ["big"], ["timestamp_ns", "span_id"], group_rows=100)
    return found.select("span_id", "line_no")


# Files

def new_folder(spark):
    return new_path(spark, "files")


@query("partitioned_scan", "SELECT uuid, row_id, timestamp_ns, hour_key FROM fault_logs")
def _(spark, sf):
    path = new_folder(spark)
    rows = views.logs(spark, sf).withColumn("date", F.substring("hour_key", 1, 10))
    writers.write_normalised(rows, path)
    stored = telemetry.read_table(spark, path, rows.schema)
    span = windows.fault_windows(incident_table(spark, sf))
    found = windows.interval_join(stored, span, partition_by="hour_key")
    return found.select("uuid", "row_id", "timestamp_ns", "hour_key")


@query("partitioned_metric_scan", """SELECT w.uuid, m.entity_kind, m.date, count(*) AS n FROM
    metrics m JOIN fault_w w ON m.timestamp_ns BETWEEN w.w_start_ns AND w.w_end_ns GROUP BY ALL""")
def _(spark, sf):
    path = new_folder(spark)
    rows = views.metrics(spark, sf)
    writers.write_normalised(rows, path, ("date", "entity_kind"))
    stored = telemetry.read_table(spark, path, rows.schema)
    span = windows.fault_windows(incident_table(spark, sf))
    found = windows.interval_join(stored, span, partition_by="date")
    return found.groupBy("uuid", "entity_kind", "date").agg(F.count(F.lit(1)).alias("n"))


def raw_in_windows(spark, sf, kind, write):
    """Raw files of the whole table, of which only those that a fault window needs are read."""
    root = new_folder(spark)
    write(spark, sf, root)
    span = cut_lineage(windows.fault_windows(incident_table(spark, sf)))
    rows = telemetry.read_in_windows(spark, root, span, kind)
    return windows.interval_join(rows, span)


@query("raw_log_scan", "SELECT uuid, timestamp_ns, hour_key, pod_name, node_name, message FROM fault_logs")
def _(spark, sf):
    found = raw_in_windows(spark, sf, "log", views.write_raw_logs)
    return found.select("uuid", "timestamp_ns", "hour_key", "pod_name", "node_name", "message")


@query("raw_span_scan", f"""SELECT uuid, span_id, parent_span_id, timestamp_ns,
    CAST(floor(duration) AS BIGINT) AS duration, operation, pod, service_name, node_name,
    'trace_jaeger-span_' ||
    {local('timestamp_ns', '%Y-%m-%d_%H')} || '-00-00.parquet' AS source_file FROM fault_spans""")
def _(spark, sf):
    found = raw_in_windows(spark, sf, "span", views.write_raw_spans)
    return found.select("uuid", "span_id", "parent_span_id", "timestamp_ns", "duration",
                        "operation", "pod", "service_name", "node_name", "source_file")


@query("raw_metric_scan", """SELECT w.uuid, m.timestamp_ns, m.date, m.entity_kind, m.entity,
    m.service, m.metric, m.value, m.instance, m.device FROM metrics m JOIN fault_w w
    ON m.timestamp_ns BETWEEN w.w_start_ns AND w.w_end_ns WHERE m.value IS NOT NULL""")
def _(spark, sf):
    found = raw_in_windows(spark, sf, "metric", views.write_raw_metrics)
    return found.where(F.col("value").isNotNull()).select(
        "uuid", "timestamp_ns", "date", "entity_kind", "entity", "service", "metric", "value",
        "instance", "device")


@query("file_report", "SELECT 'success' AS status, count(*) AS rows FROM logs")
def _(spark, sf):
    path = new_folder(spark)
    writers.save_table(views.logs(spark, sf), path)
    report = telemetry.file_report(spark, path)
    return report.groupBy("status").agg(F.sum("rows").alias("rows"))


@query("file_report_causes", """SELECT 'success' AS status, CAST(NULL AS VARCHAR) AS cause,
    count(*) AS rows FROM logs WHERE level_no < 2 GROUP BY level_no
    UNION ALL SELECT 'skipped', NULL, count(*) FROM logs WHERE level_no = 2
    UNION ALL SELECT 'error', 'empty: no rows', 0
    UNION ALL SELECT 'error', 'broken: does not start as Parquet', 0""".replace(
        "level_no", "(row_id % 3)"))
def _(spark, sf):
    """A folder with sound, deleted, empty and broken files."""
    path = new_folder(spark)
    table = views.logs(spark, sf)
    for part, folder in ((0, "a"), (1, "b"), (2, "c_deleted")):
        writers.save_table(table.where(F.col("row_id") % 3 == part).coalesce(1), f"{path}/{folder}")
    writers.save_table(table.limit(0), f"{path}/d")
    text = f"{path}/e.text"
    table.select(F.col("message").alias("value")).limit(1).coalesce(1).write.text(text)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    system = fs_path(text).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(fs_path(f"{text}/part-*")):
        system.rename(found.getPath(), fs_path(f"{path}/e.parquet"))
    return telemetry.file_report(spark, path).select("status", "cause", "rows")


@query("merged_spans", """SELECT span_id, parent_pod, parent_service,
    'spans_' || strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d') AS source_file
    FROM train_spans""")
def _(spark, sf):
    """Training spans keep the name of the file they come from."""
    path = new_folder(spark)
    name = F.concat(F.lit("spans_"), F.date_format(
        F.timestamp_micros(F.expr("timestamp_ns div 1000")), "yyyy-MM-dd"))
    table = spans(spark, sf).withColumn("source_file", name)
    around = evidence.training_spans(table, sampled(spark, sf), ORDER, views.RECOVERY)
    writers.save_table(around, path)
    stored = telemetry.read_table(spark, path)
    return stored.select("span_id", "parent_pod", "parent_service", "source_file")


@query("result_file", "SELECT uuid, component, reason, steps, observation FROM results")
def _(spark, sf):
    path = new_folder(spark)
    writers.write_results(parsed_results(spark, sf), path)
    return flat(read_results(spark, path))


@query("result_file_many", "SELECT uuid, component, reason, steps, observation FROM results")
def _(spark, sf):
    """Several files with repeated incidents; the last line of the last file counts."""
    path = new_folder(spark)
    lines = cut_lineage(fresh(spark, sf)).repartitionByRange(6, "seq").sortWithinPartitions("seq")
    lines.drop("seq").write.json(path)
    return flat(read_results(spark, path))


@query("upsert_path", "SELECT uuid, component, reason, steps, observation FROM results")
def _(spark, sf):
    """A stored file that gets the later half of the replies merged in."""
    path = new_folder(spark)
    table = cut_lineage(fresh(spark, sf))
    early = F.col("seq") % 3 < 2
    writers.upsert_result_file(table.where(early), path)
    writers.upsert_result_file(table.where(~early), path)
    return flat(read_results(spark, path))


@query("incident_csv_scan", "SELECT uuid, start_ns, end_ns, date, hour_key FROM incidents")
def _(spark, sf):
    path = new_folder(spark)
    columns = {c: F.lit(None).cast(t) for c, t in INCIDENT_CSV_TYPES.items()}
    columns.update({
        "uuid": F.col("uuid"), "start_timestamp": F.col("start_ns"), "date": F.col("date"),
        "end_timestamp": F.col("end_ns"), "start_time_hour": F.col("hour_key"),
        "Anomaly Description": F.concat(F.lit('quoted "text",\nsecond line of '), "uuid"),
    })
    rows = views.incidents(spark, sf).select(*[c.alias(n) for n, c in columns.items()])
    rows.write.option("header", "true").option("escape", '"').csv(path)
    read = read_incident_csv(spark, path)
    return read.where(F.contains("description", F.lit("second line"))).select(
        "uuid", "start_ns", "end_ns", "date", "hour_key")


@query("call_log", """SELECT 2 * count(*) AS total_calls, count(DISTINCT conv_id) AS total_uuids
    FROM conversations""")
def _(spark, sf):
    path = new_folder(spark)
    rows = views.calls(spark, sf).select(
        "uuid", F.lit("2024-01-01 00:00:00").alias("timestamp"), "call_type", "prompt", "response")
    writers.append_calls(rows, path)
    writers.append_calls(rows, path)
    return calls.call_stats(read_calls(spark, path))


@query("catalogue_file", "SELECT template, CAST(size AS VARCHAR) AS count FROM mt_templates")
def _(spark, sf):
    path = new_folder(spark)
    writers.write_catalogue(
        templates.template_catalogue(mined(spark, sf)).select("template", "count"), path)
    return spark.read.option("header", "true").option("escape", '"').option(
        "multiLine", "true").csv(path).select(F.coalesce("template", F.lit("")).alias(
            "template"), "count")


# Results

def fresh(spark, sf):
    return results.parse_replies(views.replies(spark, sf))


def flat(df):
    steps = F.coalesce(F.array_join(F.transform("reasoning_trace", lambda s: s["observation"]), ";"),
                       F.lit(""))
    return df.withColumn("steps", F.size("reasoning_trace")).withColumn(
        "observation", steps).drop("reasoning_trace")


def parsed_results(spark, sf):
    table = fresh(spark, sf)
    return results.upsert_results(table.limit(0), table)


@query("parse_replies", "SELECT uuid, seq, component, reason, steps, observation FROM answers")
def _(spark, sf):
    return flat(fresh(spark, sf))


@query("upsert_results", """SELECT uuid, arg_max(component, place) AS component,
    arg_max(reason, place) AS reason, arg_max(steps, place) AS steps,
    arg_max(observation, place) AS observation FROM
    (SELECT *, CASE WHEN component = 'frontend-1' THEN seq ELSE seq + 1000000000000 END AS place
     FROM answers) GROUP BY 1""")
def _(spark, sf):
    table = cut_lineage(fresh(spark, sf))
    known = F.col("component") == "frontend-1"
    return flat(results.upsert_results(table.where(known), table.where(~known)))


@query("component_check", f"""SELECT uuid, component,
    CASE WHEN component = 'aiops-k8s-03' THEN 'node' WHEN component = 'frontend-1' THEN 'pod'
    WHEN component = 'no-such-part' THEN 'unknown' ELSE 'service' END AS level,
    component <> 'no-such-part' AS valid FROM results""")
def _(spark, sf):
    checked = results.component_check(parsed_results(spark, sf))
    return checked.select("uuid", "component", "level", "valid")


@query("hot_deck_fill", """SELECT * FROM (WITH f AS (SELECT *, md5(uuid || '|0') AS h,
    component <> '' AND reason <> '' AS filled FROM results),
    d AS (SELECT row_number() OVER (ORDER BY h, uuid) - 1 AS no, component AS dc, reason AS dr
    FROM f WHERE filled)
    SELECT uuid, CASE WHEN no IS NULL THEN component ELSE dc END AS component,
    CASE WHEN no IS NULL THEN reason ELSE dr END AS reason, no IS NOT NULL AS borrowed
    FROM f LEFT JOIN d ON NOT filled
    AND no = CAST('0x' || left(h, 8) AS BIGINT) % (SELECT count(*) FROM d))""")
def _(spark, sf):
    return results.hot_deck_fill(parsed_results(spark, sf)).drop("reasoning_trace")


# Calls and run summary

@query("call_stats", """SELECT count(DISTINCT conv_id) AS total_uuids, count(*) AS total_calls
    FROM conversations""")
def _(spark, sf):
    return calls.call_stats(views.calls(spark, sf))


@query("call_report", """SELECT CAST(conv_id AS VARCHAR) AS uuid, turn, '[' || role || ']' ||
    chr(10) || 'prompt: turn ' || CAST(turn AS VARCHAR) || chr(10) || 'response: ' || text AS entry
    FROM conversations""")
def _(spark, sf):
    return calls.call_report(views.calls(spark, sf), ["turn"])


OUTCOMES = """SELECT i.uuid, CASE WHEN coalesce(e.n, 0) > 0 THEN 'found' WHEN i.hour_key IN
    (SELECT hour_key FROM logs) THEN 'empty' ELSE 'no_file' END AS status,
    coalesce(e.n, 0) AS rows_found FROM incidents i LEFT JOIN
    (SELECT uuid, count(*) AS n FROM log_ev GROUP BY 1) e USING (uuid)"""


@query("run_summary_observed", f"""SELECT count(*) AS total_count,
    count(CASE WHEN status = 'no_file' THEN 1 END) AS no_file_count,
    count(CASE WHEN status = 'empty' THEN 1 END) AS empty_count,
    count(CASE WHEN status = 'found' THEN 1 END) AS found_count,
    CAST(sum(rows_found) AS BIGINT) AS rows_total, max(rows_found) AS rows_max
    FROM ({OUTCOMES})""")
def _(spark, sf):
    """The totals as they were observed while the outcomes were stored."""
    totals = summary.write_outcomes(run_outcomes(spark, sf), new_folder(spark))
    return spark.createDataFrame(
        [tuple(totals.values())], ", ".join(f"{c} long" for c in totals))


@query("run_outcomes", OUTCOMES)
def run_outcomes(spark, sf):
    return summary.run_outcomes(
        incident_table(spark, sf), views.logs(spark, sf), log_rows(spark, sf))


@query("run_summary", f"""SELECT count(*) AS total_count,
    count(CASE WHEN status = 'no_file' THEN 1 END) AS no_file_count,
    count(CASE WHEN status = 'empty' THEN 1 END) AS empty_count,
    count(CASE WHEN status = 'found' THEN 1 END) AS found_count,
    CAST(sum(rows_found) AS BIGINT) AS rows_total, max(rows_found) AS rows_max
    FROM ({OUTCOMES})""")
def _(spark, sf):
    return summary.run_summary(run_outcomes(spark, sf))
