"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.fixed_values import COUNT_LABEL, SERVICE_ALIASES


def contains_error(message: Column) -> Column:
    """The word "error" in any case; a missing message is no error."""
    return F.coalesce(F.contains(F.lower(message), F.lit("error")), F.lit(False))


def is_injected(message: Column) -> Column:
    """Messages of the fault injector name "java", in lower case."""
    return F.coalesce(F.contains(message, F.lit("java")), F.lit(False))


def service_of_log_pod(pod: Column) -> Column:
    """Leading letters and digits of the pod name, or the whole name."""
    head = F.regexp_extract(pod, "^([a-zA-Z0-9]+)", 1)
    return F.when(head == F.lit(""), pod).otherwise(head)


def service_of_metric_pod(pod: Column) -> Column:
    return F.split_part(pod, F.lit("-"), F.lit(1))


def pod_of_file(file_name: Column) -> Column:
    """Second underscore part of a file name, or its stem."""
    return F.when(
        F.contains(file_name, F.lit("_")), F.split_part(file_name, F.lit("_"), F.lit(2))
    ).otherwise(F.split_part(file_name, F.lit("."), F.lit(1)))


def service_alias(service: Column, aliases: dict[str, str] | None = None) -> Column:
    result = service
    for short, full in (SERVICE_ALIASES if aliases is None else aliases).items():
        result = F.when(service == F.lit(short), F.lit(full)).otherwise(result)
    return result


def text_or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def call_path(parent: Column, child: Column, operation: Column) -> Column:
    """Readable name of a call path; joins use the three columns, not this text."""
    return F.concat_ws("_", parent, child, operation)


def count_label(count: Column) -> Column:
    return F.concat(F.lit(COUNT_LABEL), count.cast("string"))


def csv_field(value: Column) -> Column:
    """One CSV field: empty for NULL, quoted only where it has to be."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    plain = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(text, F.lit('[,"\\r\\n]')), quoted).otherwise(plain)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_field(v) for v in values])
