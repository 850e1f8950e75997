"""The same queries as SQL for a second engine, built from shared named subqueries."""

from __future__ import annotations

import re

from triagelake.fixed_values import (
    COUNT_LABEL, FOREST_TREES, MISSING_LABEL, NODES, PODS, REPORT_LABELS, SAMPLE_SEED, SERVICES,
    STABLE_RATIO,
)
from triagelake.mask_rules import mask_rules
from workload import views

HOUR = 3_600_000_000_000
STATS = ["mean", "std", "min", "p25", "p50", "p75", "p95", "p99", "max", "non_zero_ratio"]
PATH = "parent_pod, child_pod, operation"
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"
DAY = r"\p{Nd}"


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def r6(x: str) -> str:
    return f"round_even({x}, 6)"


def local(ns: str, pattern: str) -> str:
    return f"strftime(make_timestamp(({ns}) // 1000) + INTERVAL 8 HOUR, '{pattern}')"


def describe(source: str, keys: str, where: str = "true") -> str:
    """Statistics per key of the rows that pass, rounded."""
    q = ", ".join(
        f"{r6(f'quantile_cont(value, {p})')} AS {n}"
        for n, p in (("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95), ("p99", .99))
    )
    return f"""SELECT {keys}, count(value) AS n, {r6('avg(value)')} AS mean,
        {r6('stddev_samp(value)')} AS std, {r6('min(value)')} AS min, {q},
        {r6('max(value)')} AS max,
        {r6('avg(CASE WHEN value <> 0 THEN 1 WHEN value = 0 THEN 0 END)')} AS non_zero_ratio
        FROM {source} WHERE {where} GROUP BY ALL"""


def mask_sql(x: str) -> str:
    d = DAY
    rules = [
        (f"{d}{{4}}-{d}{{2}}-{d}{{2}}T{d}{{2}}:{d}{{2}}:{d}{{2}}\\.{d}+Z", "ISO_TIMESTAMP"),
        ("https?://[a-zA-Z0-9$-_@.&+!*(),]+", "URL"),
        (r"\.".join([f"{d}{{1,3}}"] * 4), "HOST"),
        ("-".join(f"{WORD}{{{n}}}" for n in (8, 4, 4, 4, 12)), "UID"),
    ]
    for pattern, name in rules:
        x = f"regexp_replace({x}, '{pattern}', '<:{name}:>', 'g')"
    return x


def mask_all_sql(x: str) -> str:
    """The whole ordered rule list, digits and word characters as Unicode classes."""
    for name, pattern in mask_rules():
        if name == "URL":
            pattern = "https?://[a-zA-Z0-9$-_@.&+!*(),]+"
        pattern = pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", WORD)
        pattern = pattern.replace(r"\d", DAY).replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '<:{name}:>', 'g')"
    return x


def csv(*columns: str) -> str:
    def field(c):
        t = f"CAST({c} AS VARCHAR)"
        quoted = f"""'"' || replace({t}, '"', '""') || '"'"""
        return (f"CASE WHEN {c} IS NULL THEN '' WHEN regexp_matches({t}, '[,\"\\r\\n]') "
                f"THEN {quoted} ELSE {t} END")
    return " || ',' || ".join(field(c) for c in columns)


def leaf_sql(tokens: str) -> str:
    digit = f"regexp_matches({tokens}[i], '{DAY}')"
    n = f"len({tokens})"
    head = f"generate_series(1, greatest(least({n} - 1, 7), 0))"
    path = f"list_transform({head}, lambda i: CASE WHEN {digit} THEN '<*>' ELSE {tokens}[i] END)"
    plain_head = f"list_filter({head}, lambda i: NOT {digit})"
    plain = f"list_filter(generate_series(1, {n}), lambda i: NOT {digit})"
    anchor = (f"CASE WHEN len({plain_head}) > 0 THEN '' WHEN len({plain}) > 0 THEN "
              f"CAST({plain}[1] - 1 AS VARCHAR) || chr(1) || {tokens}[{plain}[1]] "
              f"ELSE array_to_string({tokens}, chr(1)) END")
    return f"md5(CAST({n} AS VARCHAR) || chr(1) || array_to_string({path}, chr(1)) || chr(1) || {anchor})"


def templates_cte(source: str, masks: str, prefix: str) -> dict[str, str]:
    """Masked messages, leaves and the template table of a message source."""
    tokens = (f"list_filter(string_split_regex(translate(masked, '_|:=,', '     '), '{SPACES}'), "
              "lambda t: t <> '')")
    return {
        f"{prefix}_masked": f"""SELECT masked, count(*) AS n FROM
            {source} JOIN {masks} USING (message) GROUP BY 1""",
        f"{prefix}_tok": f"SELECT masked, n, {tokens} AS tokens FROM {prefix}_masked",
        f"{prefix}_leaf": f"SELECT *, {leaf_sql('tokens')} AS template_id FROM {prefix}_tok",
        f"{prefix}_pos": f"""SELECT template_id, pos,
            CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok FROM
            (SELECT template_id, unnest(tokens) AS tok,
                    unnest(generate_series(1, len(tokens))) AS pos FROM {prefix}_leaf)
            GROUP BY 1, 2""",
        f"{prefix}_list": f"""SELECT template_id, list(tok ORDER BY pos) AS template_tokens
            FROM {prefix}_pos GROUP BY 1""",
        f"{prefix}_templates": f"""SELECT c.template_id, coalesce(l.template_tokens, []) AS
            template_tokens, c.size,
            coalesce(array_to_string(l.template_tokens, ' '), '') AS template FROM
            (SELECT template_id, CAST(sum(n) AS BIGINT) AS size FROM {prefix}_leaf GROUP BY 1) c
            LEFT JOIN {prefix}_list l USING (template_id)""",
    }


def match_cte(masks: str, known: str, prefix: str) -> dict[str, str]:
    tokens = (f"list_filter(string_split_regex(translate(masked, '_|:=,', '     '), '{SPACES}'), "
              "lambda t: t <> '')")
    index = "generate_series(1, greatest(len(tokens), len(template_tokens)))"
    bad = (f"len(list_filter({index}, lambda i: NOT coalesce(template_tokens[i] = '<*>' OR "
           "template_tokens[i] = tokens[i], false))) > 0")
    params = ("list_transform(list_filter(generate_series(1, len(tokens)), "
              "lambda i: template_tokens[i] = '<*>'), lambda i: tokens[i])")
    return {
        f"{prefix}_in": f"""SELECT message, masked, tokens, {leaf_sql('tokens')} AS template_id FROM
            (SELECT message, masked, {tokens} AS tokens FROM {masks})""",
        f"{prefix}_matched": f"""SELECT message, masked,
            CASE WHEN ok THEN template_id END AS template_id,
            CASE WHEN ok THEN template END AS template,
            CASE WHEN ok THEN {params} END AS params FROM
            (SELECT m.*, t.template, t.template_tokens,
                    t.template_id IS NOT NULL AND NOT ({bad}) AS ok
             FROM {prefix}_in m LEFT JOIN {known}_templates t USING (template_id))""",
    }


def stats_cte(prefix: str, metrics: str, windows: str, keys: str, keep_empty: bool) -> dict[str, str]:
    """Window rows, trimming and statistics per side, and the pairing of both sides."""
    part = f"PARTITION BY uuid, kind, {keys}"
    pair = ", ".join(
        f"max(CASE WHEN kind = '{side}' THEN {c} END) AS {side}_{c}"
        for side in ("normal", "fault") for c in ["n", *STATS]
    )
    having = "" if keep_empty else "WHERE n > 0"
    return {
        f"{prefix}_rows": f"""SELECT w.uuid, CASE WHEN w.kind = 'fault' THEN 'fault' ELSE 'normal'
            END AS kind, {', '.join('m.' + k.strip() for k in keys.split(','))}, m.value
            FROM {metrics} m JOIN {windows} w
            ON m.timestamp_ns BETWEEN w.w_start_ns AND w.w_end_ns""",
        f"{prefix}_ranked": f"""SELECT *, row_number() OVER ({part} ORDER BY value NULLS LAST) AS rn,
            count(value) OVER ({part}) AS c FROM {prefix}_rows""",
        f"{prefix}_stats": describe(
            f"{prefix}_ranked", f"uuid, {keys}, kind",
            "kind = 'fault' OR c <= 4 OR (rn > 2 AND rn <= c - 2)"),
        f"{prefix}_paired": f"SELECT uuid, {keys}, {pair} FROM {prefix}_stats {having} GROUP BY ALL",
        f"{prefix}_dev": f"""SELECT *, normal_p75 - normal_p25 AS normal_iqr,
            fault_p75 - fault_p25 AS fault_iqr,
            abs(fault_p50 - normal_p50) / ((fault_p50 + normal_p50) / 2.0 + 1e-9) AS p50_ratio,
            abs(fault_p99 - normal_p99) / ((fault_p99 + normal_p99) / 2.0 + 1e-9) AS p99_ratio
            FROM {prefix}_paired""",
    }


def average_depth_sql(n: str) -> str:
    return (f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1) + "
            f"0.5772156649015329) - 2.0 * ({n} - 1) / CAST({n} AS DOUBLE) END)")


def forest_cte(trees: int, samples: int, seed: int, contamination: float) -> dict[str, str]:
    """The forest level by level, and the scores of training and fault bins."""
    key = f"{PATH}, tree"
    found = {
        "fs_0": f"""SELECT {key}, {r6('mean_duration')} AS mean_duration, count(*) OVER (PARTITION BY {key}) AS size,
            CAST(1 AS BIGINT) AS node, CAST('-infinity' AS DOUBLE) AS low,
            CAST('infinity' AS DOUBLE) AS high FROM
            (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY md5(concat_ws('|', uuid,
             CAST(bin_start_ns AS VARCHAR), CAST(tree AS VARCHAR), '{seed}')), uuid, bin_start_ns)
             AS place FROM train_bins CROSS JOIN (SELECT CAST(range AS INTEGER) AS tree
             FROM range({trees}))) WHERE place <= {samples}""",
    }
    parts = []
    for d in range((samples - 1).bit_length() + 1):
        draw = (f"CAST('0x' || substr(md5(concat_ws('|', {PATH}, CAST(tree AS VARCHAR), "
                f"CAST(node AS VARCHAR), '{seed}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE")
        found[f"ft_{d}"] = f"""SELECT *, CASE WHEN mn < mx AND {d} < length(bin(greatest(size, 2)
            - 1)) THEN mn + (mx - mn) * ({draw}) END AS cut_at FROM (SELECT *, count(*) OVER w AS n,
            min(mean_duration) OVER w AS mn, max(mean_duration) OVER w AS mx FROM fs_{d}
            WINDOW w AS (PARTITION BY {key}, node))"""
        found[f"fs_{d + 1}"] = f"""SELECT {key}, mean_duration, size,
            node * 2 + CASE WHEN mean_duration > cut_at THEN 1 ELSE 0 END AS node,
            CASE WHEN mean_duration > cut_at THEN cut_at ELSE low END AS low,
            CASE WHEN mean_duration > cut_at THEN high ELSE cut_at END AS high FROM ft_{d}
            WHERE cut_at IS NOT NULL"""
        parts.append(f"""SELECT DISTINCT {key}, node, {d} AS depth, n, cut_at AS threshold, low,
            high, size AS samples FROM ft_{d}""")
    found["forest_nodes"] = " UNION ALL ".join(parts)
    deep = f"CAST(round((depth + {average_depth_sql('n')}) * 1e9) AS BIGINT)"
    scale = f"CASE WHEN samples > 1 THEN {average_depth_sql('samples')} ELSE 1.0 END"
    found["forest_leaves"] = f"""SELECT {PATH}, low, high, samples, {deep} AS deep FROM forest_nodes
        WHERE threshold IS NULL"""
    for name in ("train", "fault"):
        found[f"forest_{name}"] = f"""SELECT b.*, score FROM {name}_bins b JOIN
            (SELECT uuid, {PATH}, bin_start_ns, round(-pow(2.0, -(sum(deep) / 1e9 / {trees}) /
             max({scale})), 9) AS score FROM {name}_bins JOIN forest_leaves USING ({PATH})
             WHERE {r6('mean_duration')} > low AND {r6('mean_duration')} <= high GROUP BY ALL)
            USING (uuid, {PATH}, bin_start_ns)"""
    found["forest_cuts"] = f"""SELECT {PATH}, count(*) AS train_bins,
        round(quantile_cont(score, {contamination}), 9) AS cutoff FROM forest_train GROUP BY ALL"""
    found["forest_bad"] = f"""SELECT f.* FROM forest_fault f JOIN forest_cuts USING ({PATH})
        WHERE score < cutoff"""
    return found


BOTH = "normal_n IS NOT NULL AND fault_n IS NOT NULL"
STABLE = f"coalesce(p50_ratio < {STABLE_RATIO} AND p99_ratio < {STABLE_RATIO}, false)"
SIX = ", ".join(
    f"CASE WHEN {BOTH} THEN round_even(round_even({c}, 6), 2) END AS {c}" for c in REPORT_LABELS
)
STATUS = f"CASE WHEN {BOTH} THEN 'ok' ELSE 'missing' END AS status"
SIX_NAMES = ", ".join(REPORT_LABELS)

CTE: dict[str, str] = {
    "ev": """SELECT event_id, ts, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "inc0": """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS ord,
        (min(CASE WHEN event_type = 'error' THEN ts_ns END) // 1000000000) * 1000000000 AS start_ns
        FROM ev GROUP BY 1""",
    "incidents": f"""SELECT ord, 'inc-' || lpad(CAST(ord AS VARCHAR), 3, '0') AS uuid, start_ns,
        start_ns + (12 + CASE WHEN ord % 7 = 3 THEN 14 ELSE 0 END) * {HOUR} AS end_ns,
        {local('start_ns', '%Y-%m-%d')} AS date, {local('start_ns', '%Y-%m-%d_%H')} AS hour_key
        FROM inc0 WHERE start_ns IS NOT NULL""",
    "reports": """SELECT event_id AS ord, 'rep-' || CAST(event_id AS VARCHAR) AS uuid, event_type,
        ts, ts + to_minutes(k + 1) AS te, k FROM ev""",
    "rep_inc": f"""SELECT *, epoch(date_trunc('second', ts))::BIGINT * 1000000000 AS start_ns,
        epoch(date_trunc('second', CASE WHEN false THEN ts ELSE te END))::BIGINT * 1000000000
        AS end_ns FROM reports WHERE k % 10 <> 0""",
    "fault_w": """SELECT uuid, 'fault' AS kind, start_ns AS w_start_ns, end_ns AS w_end_ns
        FROM incidents""",
    "near": """SELECT *, lag(end_ns) OVER (ORDER BY ord) AS prev_end, lead(start_ns) OVER
        (ORDER BY ord) AS next_start FROM incidents""",
    "normal_w": """SELECT uuid, 'normal_before' AS kind, prev_end + 600000000000 AS w_start_ns,
        start_ns AS w_end_ns FROM near WHERE prev_end IS NOT NULL
        UNION ALL SELECT uuid, 'normal_after', end_ns + 600000000000, next_start FROM near
        WHERE next_start IS NOT NULL""",
    "all_w": "SELECT * FROM fault_w UNION ALL SELECT * FROM normal_w",
    "day_w": f"""SELECT w.uuid, w.kind, greatest(w_start_ns, lo) AS w_start_ns,
        least(w_end_ns, lo + 24 * {HOUR} - 1) AS w_end_ns FROM all_w w JOIN
        (SELECT uuid, ((start_ns + 8 * {HOUR}) // (24 * {HOUR})) * 24 * {HOUR} - 8 * {HOUR} AS lo
         FROM incidents) USING (uuid)""",
    "hour_w": f"""SELECT w.uuid, w.kind, greatest(w_start_ns, lo) AS w_start_ns,
        least(w_end_ns, lo + {HOUR} - 1) AS w_end_ns FROM fault_w w JOIN
        (SELECT uuid, (start_ns // {HOUR}) * {HOUR} AS lo FROM incidents) USING (uuid)""",
    "evm": f"""SELECT ts_ns AS timestamp_ns, {local('ts_ns', '%Y-%m-%d')} AS date, event_type, k,
        CASE WHEN k <> 97 THEN value END AS v, CAST(k AS DOUBLE) AS level,
        event_type || '-' || CAST(user_id % 2 AS VARCHAR) AS pod,
        'node-0' || CAST(user_id % 8 + 1 AS VARCHAR) AS node,
        ['tidb-tidb', 'tidb-pd', 'tidb-tikv'][user_id % 3 + 1] AS part,
        CASE WHEN k % 5 = 0 THEN '/dev/dmb' WHEN k % 5 > 1 THEN '/dev/vda' END AS device FROM ev""",
    "metrics": """
        SELECT timestamp_ns, date, 'apm_pod' AS entity_kind, pod AS entity, event_type AS service,
               'rrt' AS metric, v AS value, NULL AS instance, NULL AS device FROM evm
        UNION ALL SELECT timestamp_ns, date, 'apm_pod', pod, event_type, 'request', level, NULL, NULL FROM evm
        UNION ALL SELECT timestamp_ns, date, 'pod', pod, event_type, 'pod_cpu_usage', v, node, device FROM evm
        UNION ALL SELECT timestamp_ns, date, 'pod', pod, event_type, 'pod_processes', level, node, device FROM evm
        UNION ALL SELECT timestamp_ns, date, 'node', node, NULL, 'node_cpu_usage_rate', v, NULL, NULL FROM evm
        UNION ALL SELECT timestamp_ns, date, 'node', node, NULL, 'node_memory_usage_rate', level, NULL, NULL FROM evm
        UNION ALL SELECT timestamp_ns, date, 'db_component', part, NULL, 'cpu_usage', v, NULL, NULL FROM evm""",
    "apm": "SELECT * FROM metrics WHERE entity_kind = 'apm_pod'",
    "nodem": f"SELECT * FROM metrics WHERE entity_kind = 'node' AND entity IN ({_list(views.NODES)})",
    "podm": f"""SELECT * FROM metrics WHERE entity_kind = 'pod' AND entity IN ({_list(views.PODS)})
        AND device IS DISTINCT FROM '/dev/dmb'""",
    "dbm": "SELECT * FROM metrics WHERE entity_kind = 'db_component'",
    **stats_cte("apm_s", "apm", "all_w", "service, entity, metric", True),
    **stats_cte("node_s", "nodem", "all_w", "entity, metric", False),
    **stats_cte("pod_s", "podm", "all_w", "entity, metric", False),
    **stats_cte("db_s", "dbm", "all_w", "entity, metric", False),
    **stats_cte("day_s", "podm", "day_w", "entity, metric", False),
    "node_grid": "SELECT DISTINCT uuid, entity, metric FROM nodem JOIN incidents USING (date)",
    "pod_grid": "SELECT DISTINCT uuid, entity, metric FROM podm JOIN incidents USING (date)",
    "db_grid": "SELECT DISTINCT uuid, entity, metric FROM dbm JOIN incidents USING (date)",
    **{
        f"{n}_report": f"""SELECT uuid, entity, metric, {STATUS}, {SIX} FROM {n}_grid LEFT JOIN
        {n}_s_dev USING (uuid, entity, metric) WHERE NOT ({BOTH} AND {STABLE})"""
        for n in ("node", "pod", "db")
    },
    "apm_report": f"""SELECT uuid, service, entity, metric, {STATUS}, {SIX} FROM apm_s_dev
        WHERE {BOTH} AND NOT {STABLE}""",
    "days": "SELECT DISTINCT date FROM metrics WHERE entity_kind = 'pod'",
    "placed": """SELECT DISTINCT date, instance AS node, entity AS pod FROM metrics
        WHERE entity_kind = 'pod' AND metric = 'pod_cpu_usage'""",
    "placement": f"""SELECT d.date, d.node, p.pod FROM
        (SELECT date, unnest([{_list(views.NODES)}]) AS node FROM days) d
        LEFT JOIN placed p USING (date, node)""",
    "hosts": """SELECT i.uuid, p.node, p.pod FROM placement p JOIN incidents i USING (date)
        WHERE p.pod IS NOT NULL""",
    "node_rows": f"""SELECT uuid, entity AS node, NULL AS pod, metric, status, {SIX_NAMES}
        FROM node_report UNION ALL
        SELECT h.uuid, h.node, h.pod, r.metric, coalesce(r.status, 'empty'), {SIX_NAMES}
        FROM hosts h LEFT JOIN pod_report r ON h.uuid = r.uuid AND h.pod = r.entity""",
    "service_pods": """SELECT uuid, service, count(*) AS pod_count,
        string_agg(entity, ',' ORDER BY entity) AS pod_list FROM
        (SELECT DISTINCT uuid, service, entity FROM apm_s_paired) GROUP BY 1, 2""",
    "metric_rows": f"""
        SELECT uuid, 'microservice' AS section, service, '' AS node, entity, metric, status,
               {SIX_NAMES} FROM apm_report
        UNION ALL SELECT uuid, 'db_component', '', '', entity, metric, status, {SIX_NAMES}
               FROM db_report
        UNION ALL SELECT uuid, CASE WHEN pod IS NULL THEN 'node' ELSE 'pod' END, '', node,
               coalesce(pod, ''), coalesce(metric, ''), status, {SIX_NAMES} FROM node_rows""",
    # logs
    "logs": f"""SELECT ts_ns AS timestamp_ns, event_id AS row_id,
        event_type || '-' || CAST(user_id % 2 AS VARCHAR) AS pod_name,
        'node-0' || CAST(user_id % 8 + 1 AS VARCHAR) AS node_name,
        CASE WHEN k <> 97 THEN event_type || ' user=' || CAST(user_id AS VARCHAR) || ' value=' ||
          CAST(value AS VARCHAR) || ' k=' || CAST(k AS VARCHAR) || CASE WHEN k % 10 = 3 THEN
          ' java.lang.Error Injected' WHEN k % 10 = 4 THEN ' Error, code' WHEN k % 10 = 5 THEN
          '{views.CART_FAILURE}' WHEN k % 10 = 6 THEN '{views.DEADLINE}' ELSE '' END END AS message,
        {local('ts_ns', '%Y-%m-%d_%H')} AS hour_key FROM ev""",
    "error_rows": "SELECT * FROM logs WHERE contains(lower(message), 'error')",
    "messages": """SELECT doc_id AS a, CAST(line_no AS BIGINT) AS b, message FROM
        (SELECT doc_id, unnest(string_split(text, chr(10))) AS message,
         unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents)
        UNION ALL SELECT -1, row_id, message FROM logs""",
    **{
        name: f"""SELECT message, {mask('message')} AS masked FROM
        (SELECT DISTINCT message FROM {source} WHERE message IS NOT NULL)"""
        for name, mask, source in (("full_masked", mask_all_sql, "messages"),
                                   ("log_masked", mask_all_sql, "logs"),
                                   ("short_masked", mask_sql, "messages"))
    },
    **templates_cte("error_rows", "log_masked", "et"),
    **templates_cte("messages", "full_masked", "mt"),
    **match_cte("log_masked", "et", "lm"),
    "fault_logs": """SELECT w.uuid, l.* FROM logs l JOIN fault_w w
        ON l.timestamp_ns BETWEEN w.w_start_ns AND w.w_end_ns""",
    "tagged": """SELECT e.*, m.template FROM fault_logs e LEFT JOIN lm_matched m USING (message)
        WHERE contains(lower(e.message), 'error')""",
    "deduped": """SELECT uuid, pod_name, template, min_by(node_name, row_id) AS node_name,
        min_by(message, row_id) AS message, count(*) AS occurrence_count FROM tagged
        GROUP BY 1, 2, 3""",
    "log_ev": """SELECT uuid, node_name, regexp_extract(pod_name, '^([a-zA-Z0-9]+)', 1) AS
        service_name, pod_name, template, message, occurrence_count, row_number() OVER
        (PARTITION BY uuid ORDER BY occurrence_count DESC, pod_name NULLS FIRST,
         template NULLS FIRST, message NULLS FIRST) AS line_no
        FROM deduped WHERE NOT contains(message, 'java')""",
    # spans
    "spans": """SELECT 's' || CAST(event_id AS VARCHAR) AS span_id, CASE WHEN event_id % 10 <> 0
        AND event_id % 11 <> 0 THEN 's' || CAST(event_id - 1 - user_id % 7 AS VARCHAR) END
        AS parent_span_id, ts_ns AS timestamp_ns, value AS duration,
        'op' || CAST(event_id % 2 AS VARCHAR) AS operation,
        ['frontend', 'cart', 'redis'][user_id % 3 + 1] || '-0' AS pod,
        ['frontend', 'cart', 'redis'][user_id % 3 + 1] AS service_name,
        'node-0' || CAST(user_id % 8 + 1 AS VARCHAR) AS node_name,
        CASE WHEN event_id % 13 <> 0 THEN CAST(k % 3 AS VARCHAR) END AS status_code,
        event_type AS status_message, event_id AS row_id FROM ev""",
    "fault_spans": """SELECT w.uuid, s.* FROM spans s JOIN fault_w w
        ON s.timestamp_ns BETWEEN w.w_start_ns AND w.w_end_ns""",
    "paths": """SELECT c.*, c.pod AS child_pod, p.pod AS parent_pod FROM fault_spans c
        LEFT JOIN fault_spans p ON c.uuid = p.uuid AND c.parent_span_id = p.span_id""",
    "status_counts": """SELECT uuid, node_name, CASE WHEN service_name = 'redis' THEN 'redis-cart'
        ELSE service_name END AS service_name, coalesce(parent_pod, 'N/A') AS parent_pod,
        child_pod, operation, status_code, status_message, count(*) AS occurrence_count
        FROM paths WHERE status_code <> '0' GROUP BY ALL""",
    "status_top": """SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY occurrence_count DESC,
        node_name, service_name, parent_pod, child_pod, operation, status_code, status_message)
        AS rank_no FROM status_counts QUALIFY rank_no <= 20""",
    "sampled": f"""SELECT * FROM incidents ORDER BY md5(uuid || '|42'), uuid
        LIMIT {views.SAMPLE_N}""",
    "train_hours": f"""SELECT DISTINCT unnest(generate_series(start_ns // {HOUR},
        (end_ns + {views.RECOVERY}) // {HOUR})) AS h FROM sampled""",
    "near_spans": f"""SELECT * FROM spans WHERE timestamp_ns // {HOUR} IN
        (SELECT h FROM train_hours)""",
    "train_spans": """SELECT c.*, c.pod AS child_pod, p.pod AS parent_pod,
        p.service_name AS parent_service FROM near_spans c LEFT JOIN near_spans p
        ON c.parent_span_id = p.span_id""",
    "quiet_spans": f"""SELECT i.uuid, s.* FROM train_spans s JOIN sampled i
        ON s.timestamp_ns BETWEEN i.end_ns AND i.end_ns + {views.RECOVERY}
        WHERE s.parent_pod IS NOT NULL""",
    **{
        f"{name}_bins": f"""SELECT uuid, {PATH}, lo + b * {views.BIN} AS bin_start_ns,
        avg(duration) AS mean_duration, count(*) AS spans FROM
        (SELECT *, unnest(CASE WHEN (timestamp_ns - lo) % {views.BIN} = 0 AND timestamp_ns > lo
          THEN [(timestamp_ns - lo) // {views.BIN} - 1, (timestamp_ns - lo) // {views.BIN}]
          ELSE [(timestamp_ns - lo) // {views.BIN}] END) AS b FROM
         (SELECT *, min(timestamp_ns) OVER g AS lo, max(timestamp_ns) OVER g AS hi FROM {source}
          WHERE parent_pod IS NOT NULL
          WINDOW g AS (PARTITION BY uuid, {PATH})) )
        WHERE lo + b * {views.BIN} < hi GROUP BY ALL"""
        for name, source in (("fault", "paths"), ("train", "quiet_spans"))
    },
    "band": f"""SELECT {PATH}, quantile_cont(mean_duration, {views.CONTAMINATION / 2}) AS low,
        quantile_cont(mean_duration, {1 - views.CONTAMINATION / 2}) AS high,
        avg(mean_duration) AS base_mean FROM train_bins GROUP BY ALL""",
    "bad_bins": f"""SELECT b.* FROM fault_bins b JOIN band USING ({PATH})
        WHERE mean_duration < low OR mean_duration > high""",
    "callers": f"""SELECT uuid, {PATH}, min_by(node_name, row_id) AS node_name,
        min_by(service_name, row_id) AS service_name FROM paths WHERE parent_pod IS NOT NULL
        GROUP BY ALL""",
    "trace_ev": f"""SELECT * FROM (SELECT uuid, node_name, service_name, {PATH},
        {r6('coalesce(base_mean, 0)')} AS normal_avg_duration,
        {r6('anomaly_avg_duration')} AS anomaly_avg_duration, anomaly_count,
        row_number() OVER (PARTITION BY uuid ORDER BY anomaly_count DESC, {PATH}) AS rank_no FROM
        (SELECT uuid, {PATH}, avg(mean_duration) AS anomaly_avg_duration, count(*) AS anomaly_count
         FROM bad_bins GROUP BY ALL) LEFT JOIN callers USING (uuid, {PATH})
        LEFT JOIN band USING ({PATH})) WHERE rank_no <= 20""",
    **forest_cte(FOREST_TREES, 256, SAMPLE_SEED, views.CONTAMINATION),
    "forest_ev": f"""SELECT * FROM (SELECT uuid, node_name, service_name, {PATH},
        {r6('coalesce(base_mean, 0)')} AS normal_avg_duration,
        {r6('anomaly_avg_duration')} AS anomaly_avg_duration, anomaly_count,
        row_number() OVER (PARTITION BY uuid ORDER BY anomaly_count DESC, {PATH}) AS rank_no FROM
        (SELECT uuid, {PATH}, avg(mean_duration) AS anomaly_avg_duration, count(*) AS anomaly_count
         FROM forest_bad GROUP BY ALL) LEFT JOIN callers USING (uuid, {PATH})
        LEFT JOIN band USING ({PATH})) WHERE rank_no <= 20""",
    "padded": f"""SELECT DISTINCT w.uuid, s.span_id, s.pod FROM spans s JOIN fault_w w
        ON s.timestamp_ns BETWEEN w.w_start_ns - {views.PAD} AND w.w_end_ns + {views.PAD}""",
    "padded_paths": """SELECT c.*, c.pod AS child_pod, p.pod AS parent_pod FROM fault_spans c
        LEFT JOIN padded p ON c.uuid = p.uuid AND c.parent_span_id = p.span_id""",
    # replies
    "replies": """SELECT 'rep-' || CAST(event_id // 3 AS VARCHAR) AS uuid, event_id AS seq, k,
        ['cartservice', 'frontend-1', 'aiops-k8s-03', 'redis-cart', 'no-such-part']
        [user_id % 5 + 1] AS component,
        CASE WHEN k % 9 = 0 THEN '' ELSE 'high ' || event_type END AS reason FROM ev""",
    "answers": """SELECT uuid, seq, component,
        CASE WHEN k % 8 = 1 THEN '' ELSE reason END AS reason,
        CASE WHEN k % 8 = 1 THEN 0 ELSE 1 END AS steps,
        CASE WHEN k % 8 = 1 THEN '' ELSE 'k=' || CAST(k AS VARCHAR) END AS observation
        FROM replies WHERE k % 7 <> 0 AND k % 5 <> 0""",
    "results": """SELECT uuid, arg_max(component, seq) AS component, arg_max(reason, seq) AS reason,
        arg_max(steps, seq) AS steps, arg_max(observation, seq) AS observation FROM answers
        GROUP BY 1""",
    "two_lists": """SELECT *, lag(end_ns) OVER o AS p, lead(start_ns) OVER o AS n FROM rep_inc
        WINDOW o AS (ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, ord)""",
    "gaps": """SELECT uuid, r.component, r.reason, r.observation FROM
        (SELECT DISTINCT uuid FROM replies) LEFT JOIN results r USING (uuid)""",
}


def sql(final: str) -> str:
    """The final query with every named subquery it needs, directly or not."""
    names = list(CTE)
    words = {n: set(re.findall(r"\b[a-z_0-9]+\b", CTE[n])) for n in names}
    needed: set[str] = set()
    todo = [n for n in names if n in set(re.findall(r"\b[a-z_0-9]+\b", final))]
    while todo:
        name = todo.pop()
        if name in needed:
            continue
        needed.add(name)
        todo += [n for n in names if n in words[name] and n != name]
    if not needed:
        return final
    ordered = [n for n in names if n in needed]
    kept = {n: " MATERIALIZED" if n.startswith(("ft_", "forest_")) else "" for n in ordered}
    return "WITH " + ",\n".join(f"{n} AS{kept[n]} ({CTE[n]})" for n in ordered) + "\n" + final


def variant(suffix: str, old: str, new: str, final: str) -> str:
    """``final`` with one base subquery exchanged in everything that depends on it."""
    moved = {old: new}
    for name, body in list(CTE.items()):
        words = set(re.findall(r"\b[a-z_0-9]+\b", body))
        if name != old and words & set(moved) and not name.endswith(suffix) and name != new:
            moved[name] = f"{name}{suffix}"

    def rename(text: str) -> str:
        return re.sub(r"\b[a-z_0-9]+\b", lambda m: moved.get(m.group(), m.group()), text)

    for name, other in list(moved.items()):
        if name != old:
            CTE[other] = rename(CTE[name])
    return rename(final)


def text_sql(lines: str, header: str) -> str:
    """CSV text per incident from a subquery with uuid, line_no and line."""
    return (f"SELECT uuid, '{header}' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) "
            f"|| chr(10) AS text FROM ({lines}) GROUP BY uuid")


def count_csv(columns: list[str], count: str) -> str:
    return csv(*[f"('{COUNT_LABEL}' || CAST({c} AS VARCHAR))" if c == count else c
                 for c in columns])


__all__ = ["CTE", "sql", "csv", "text_sql", "count_csv", "MISSING_LABEL", "NODES", "PODS",
           "SERVICES"]
