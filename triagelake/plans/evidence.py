"""Evidence of each kind for all incidents, and the bundle of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.fixed_values import (
    BIN_NS, HOUR_NS, MISSING_LABEL, NORMAL_MARGIN_NS, RECOVERY_NS, REPORT_LABELS, TOP_K,
)
from triagelake.functions.texts import count_label, csv_line
from triagelake.operators import detect, logs, metrics, templates, traces, windows
from triagelake.session import cut_lineage

LOG_COLUMNS = ["node_name", "service_name", "pod_name", "message", "occurrence_count"]
STATUS_COLUMNS = [*traces.STATUS_KEYS, "occurrence_count"]
TRACE_COLUMNS = [
    "node_name", "service_name", "parent_pod", "child_pod", "operation",
    "normal_avg_duration", "anomaly_avg_duration", "anomaly_count",
]


def log_evidence(
    log_table: DataFrame,
    incidents: DataFrame,
    template_table: DataFrame,
    order: list[str],
    scope: str = "full",
    full_masks: bool = True,
    **join_options,
) -> DataFrame:
    """Error logs of each incident, one row per pod and template, the frequent ones first."""
    spans = windows.clip_to_start(windows.fault_windows(incidents), incidents, scope)
    columns = list(dict.fromkeys([*order, "pod_name", "node_name", "message"]))
    rows = windows.in_windows(logs.error_logs(log_table), spans, columns, **join_options)
    merged = cut_lineage(
        logs.distinct_messages(rows, ["uuid", "pod_name"], order, ["node_name"])
    )
    matched = templates.match_templates(merged, template_table, full=full_masks)
    tagged = templates.attach_templates(merged, matched)
    first = logs.dedup_merged(tagged, ["uuid", "pod_name", "template"], ["node_name"])
    kept = logs.drop_injected(logs.with_service(first))
    return logs.order_by_count(kept, ["uuid"], ["pod_name", "template", "message"])


def fault_call_paths(
    span_table: DataFrame, incidents: DataFrame, order: list[str], scope: str = "full",
    pad_ns: int = 0, **join_options,
) -> DataFrame:
    """Spans inside the fault windows with status code and message and the pod of their parent.

    Parents are looked up among the spans of the window. With ``pad_ns`` also among those that
    lie up to so long before or after it: a Bloom filter of the wanted ids keeps other spans of
    that time from leaving the scan.
    """
    spans = windows.clip_to_start(windows.fault_windows(incidents), incidents, scope)
    rows = windows.interval_join(traces.status_fields(span_table), spans, **join_options).drop(
        "kind", "w_start_ns", "w_end_ns"
    )
    if not pad_ns:
        return traces.call_path_spans(rows, ["uuid"], order)
    rows = cut_lineage(rows, "spans")
    wider = spans.select(
        "uuid", (F.col("w_start_ns") - F.lit(pad_ns)).alias("w_start_ns"),
        (F.col("w_end_ns") + F.lit(pad_ns)).alias("w_end_ns"))
    narrow = span_table.select(*dict.fromkeys(["span_id", "pod", "timestamp_ns", *order]))
    bloom = traces.bloom_words(rows, "parent_span_id")
    named = traces.maybe_named(narrow, "span_id", bloom)
    parents = windows.interval_join(named, wider, **join_options).drop("w_start_ns", "w_end_ns")
    return traces.call_path_spans(rows, ["uuid"], order, parents)


def training_bins(
    span_table: DataFrame,
    sample: DataFrame,
    order: list[str],
    recovery_ns: int = RECOVERY_NS,
    bin_ns: int = BIN_NS,
    **join_options,
) -> DataFrame:
    """Binned durations of every call path after the sampled incidents.

    Only spans of the hours between the start of a sampled incident and the end of its
    recovery take part, and parents are looked up among those.
    """
    rows = training_spans(span_table, sample, order, recovery_ns)
    quiet = windows.interval_join(
        rows, windows.recovery_windows(sample, recovery_ns), **join_options
    )
    return traces.window_mean_duration(
        quiet.where(traces.known_path()), ["uuid", *traces.PATH], bin_ns
    )


def training_spans(
    span_table: DataFrame, sample: DataFrame, order: list[str], recovery_ns: int = RECOVERY_NS
) -> DataFrame:
    """Spans around the sampled incidents with the pod and service of their parent.

    Other columns of the table, such as ``source_file``, stay; tags become status fields.
    """
    last = F.expr(f"(end_ns + {recovery_ns}) div {HOUR_NS}")
    hours = sample.select(
        F.explode(F.sequence(F.expr(f"start_ns div {HOUR_NS}"), last)).alias("_hour")
    ).distinct()
    around = traces.status_fields(span_table).withColumn("_hour", F.expr(f"timestamp_ns div {HOUR_NS}")).join(
        hours, "_hour", "left_semi"
    ).drop("_hour")
    parents = {"pod": "parent_pod", "service_name": "parent_service"}
    return traces.with_parent(around, [], parents, order).withColumnRenamed("pod", "child_pod")


def trace_evidence(
    paths: DataFrame,
    model: DataFrame,
    stats: DataFrame,
    order: list[str],
    bin_ns: int = BIN_NS,
    k: int = TOP_K,
    find=detect.quantile_events,
) -> DataFrame:
    """Most frequent abnormal call paths; ``find`` scores bins with the given model."""
    keys = ["uuid", *traces.PATH]
    used = dict.fromkeys([*keys, "timestamp_ns", "duration", *order, "node_name", "service_name"])
    known = cut_lineage(paths.where(traces.known_path()).select(*used))
    bins = traces.window_mean_duration(known, keys, bin_ns)
    events = find(bins, model)
    callers = logs.first_in_group(known, keys, order, ["node_name", "service_name"])
    return detect.anomaly_combinations(events, callers, stats, ["uuid"], k)


def metric_evidence(
    metric_table: DataFrame,
    incidents: DataFrame,
    nodes: list[str],
    pods: list[str],
    db_metrics: list[tuple[str, str]],
    margin_ns: int = NORMAL_MARGIN_NS,
    scope: str = "full",
    preferred: str = "pod_cpu_usage",
    **options,
) -> DataFrame:
    """Moved metrics of services, database components, nodes and the pods on each node.

    One pass over the metric table computes the statistics of all four kinds.
    """
    entity = ["entity_kind", "service", "entity", "metric"]
    span = cut_lineage(
        windows.clip_to_start(windows.all_windows(incidents, margin_ns), incidents, scope)
    )
    kind, name = F.col("entity_kind"), F.col("entity")
    wanted = (
        (kind == F.lit("apm_pod"))
        | ((kind == F.lit("node")) & name.isin(nodes))
        | ((kind == F.lit("pod")) & name.isin(pods))
        | ((kind == F.lit("db_component")) & F.concat_ws("/", name, "metric").isin(
            ["/".join(pair) for pair in db_metrics]))
    )
    used = metrics.drop_device(metric_table.where(wanted)).withColumn(
        "service", F.coalesce("service", F.lit(""))
    )
    stats = metrics.describe_in_windows(used, span, entity, keep_empty=True, **options)
    # a service metric without any measurement is reported as such, others count as absent
    stats = stats.where((kind == F.lit("apm_pod")) | (F.col("n") > F.lit(0)))
    paired = cut_lineage(metrics.pair_sides(stats, entity))
    grid = metrics.presence_grid(
        used.where(kind.isin("node", "pod", "db_component")), incidents, entity
    )
    service_rows = metrics.report_rows(paired.where(kind == F.lit("apm_pod")), entity)
    other_rows = metrics.report_rows(
        paired.where(kind != F.lit("apm_pod")), entity, grid
    ).drop("service")
    flat = ["uuid", "section", "service", "node", "entity", "metric", "status", *REPORT_LABELS]
    none = F.lit("")
    of_service = service_rows.withColumn("section", F.lit("microservice")).withColumn("node", none)
    of_db = other_rows.where(kind == F.lit("db_component")).withColumn(
        "section", F.lit("db_component")).withColumn("service", none).withColumn("node", none)
    placement = metrics.node_pod_map(metric_table.where(kind == F.lit("pod")), nodes, preferred)
    below = metrics.node_pod_rows(
        other_rows.where(kind == F.lit("node")), other_rows.where(kind == F.lit("pod")),
        placement, incidents,
    ).select(
        "uuid", F.when(F.col("pod").isNull(), F.lit("node")).otherwise(
            F.lit("pod")).alias("section"),
        none.alias("service"), "node", F.coalesce("pod", F.lit("")).alias("entity"),
        F.coalesce("metric", F.lit("")).alias("metric"), "status", *REPORT_LABELS,
    )
    return (
        of_service.select(*flat).unionByName(of_db.select(*flat)).unionByName(below.select(*flat))
    )


def evidence_lines(evidence: DataFrame, columns: list[str], line_no: str, count: str) -> DataFrame:
    """CSV lines of an evidence table, the count shown as a label."""
    shown = [count_label(F.col(c)) if c == count else F.col(c) for c in columns]
    return evidence.select("uuid", F.col(line_no).alias("line_no"), csv_line(*shown).alias("line"))


def evidence_text(lines: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One CSV text per incident.

    The number of lines is bounded by the top-k of the evidence or, for logs, by the pods
    times the templates.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    body = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")
    return lines.groupBy("uuid").agg(
        F.concat(F.lit(",".join(columns) + "\n"), body, F.lit("\n")).alias(name)
    )


def _member(name: Column, value: Column) -> Column:
    text = F.to_json(F.create_map(name, value))
    return F.substring(text, F.lit(2), F.length(text) - F.lit(2))


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(members)), ","), F.lit("}"))


def metric_report_json(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Nested JSON of a flat metric report, one text per incident.

    ``levels`` are the nesting columns from outer to inner; the innermost object maps metric
    names to their six numbers or to the marker for missing data. Every level is bounded by
    the component list and the metric list.
    """
    numbers = F.struct(*[F.col(c).alias(label) for c, label in REPORT_LABELS.items()])
    value = F.when(F.col("status") == F.lit("ok"), _member(F.col("metric"), numbers)).otherwise(
        _member(F.col("metric"), F.lit(MISSING_LABEL))
    )
    result = rows.groupBy("uuid", *levels).agg(_object(value).alias("_json"))
    for depth in range(len(levels) - 1, -1, -1):
        name = F.to_json(F.create_map(F.col(levels[depth]), F.lit(0)))
        key = F.substring(name, F.lit(2), F.length(name) - F.lit(4))
        member = F.concat(key, F.lit(":"), F.col("_json"))
        result = result.groupBy("uuid", *levels[:depth]).agg(_object(member).alias("_json"))
    return result.withColumnRenamed("_json", "report")


def evidence_bundle(
    incidents: DataFrame,
    log_text: DataFrame | None = None,
    trace_text: DataFrame | None = None,
    status_text: DataFrame | None = None,
    metric_text: DataFrame | None = None,
    status_alone: bool = True,
) -> DataFrame:
    """All evidence texts of each incident in the order log, trace, status, metric.

    A kind that is not given is switched off. Incidents without any evidence are left out.
    With ``status_alone=False`` status evidence appears only next to trace evidence.
    """
    parts = {"log": log_text, "trace": trace_text, "status": status_text, "metric": metric_text}
    bundle = incidents.select("uuid")
    for name, texts in parts.items():
        if texts is None:
            bundle = bundle.withColumn(name, F.lit(None).cast("string"))
            continue
        column = next(c for c in texts.columns if c != "uuid")
        bundle = bundle.join(texts.select("uuid", F.col(column).alias(name)), "uuid", "left")
    if not status_alone:
        bundle = bundle.withColumn("status", F.when(F.col("trace").isNotNull(), F.col("status")))
    names = F.concat_ws(",", *[
        F.when(F.col(n).isNotNull(), F.lit(n)) for n in ("log", "trace", "status", "metric")
    ])
    titled = [
        F.concat(F.lit(f"### {n}\n"), F.col(n)) for n in ("log", "trace", "status", "metric")
    ]
    return (
        bundle.withColumn("sections", names).where(F.col("sections") != F.lit(""))
        .select("uuid", "sections", F.concat_ws("\n", *titled).alias("content"))
    )
