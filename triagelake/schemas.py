"""Declared schemas of the raw and normalised tables."""

from __future__ import annotations

from pyspark.sql import types as T

TAG = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
])
REFERENCE = T.StructType([
    T.StructField("refType", T.StringType()),
    T.StructField("spanID", T.StringType()),
    T.StructField("traceID", T.StringType()),
])
PROCESS = T.StructType([
    T.StructField("serviceName", T.StringType()),
    T.StructField("tags", T.ArrayType(TAG)),
])
RAW_LOG = T.StructType([
    T.StructField("@timestamp", T.StringType()),
    T.StructField("k8_pod", T.StringType()),
    T.StructField("k8_node_name", T.StringType()),
    T.StructField("message", T.StringType()),
])
RAW_SPAN = T.StructType([
    T.StructField("spanID", T.StringType()),
    T.StructField("startTime", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("operationName", T.StringType()),
    T.StructField("process", PROCESS),
    T.StructField("references", T.ArrayType(REFERENCE)),
    T.StructField("tags", T.ArrayType(TAG)),
])
INCIDENT_JSON = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("Anomaly Description", T.StringType()),
])
INCIDENT_CSV = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("start_time_utc", T.StringType()),
    T.StructField("end_time_utc", T.StringType()),
    T.StructField("start_time_beijing", T.StringType()),
    T.StructField("end_time_beijing", T.StringType()),
    T.StructField("start_timestamp", T.LongType()),
    T.StructField("end_timestamp", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("hour", T.StringType()),
    T.StructField("start_time_hour", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("duration_minutes", T.DoubleType()),
    T.StructField("Anomaly Description", T.StringType()),
])
TRACE_STEP = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("observation", T.StringType()),
])
RESULT = T.StructType([
    T.StructField("component", T.StringType()),
    T.StructField("uuid", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("reasoning_trace", T.ArrayType(TRACE_STEP)),
])
CALL = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("call_type", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("response", T.StringType()),
])


def raw_metric(value_columns: list[str], entity_columns: list[str]) -> T.StructType:
    """Raw metric files: a text instant, entity columns and one double per metric."""
    fields = [T.StructField("time", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in entity_columns]
    fields += [T.StructField(c, T.DoubleType()) for c in value_columns]
    return T.StructType(fields)
