"""Fields inside a nested span record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_tag(tags: Column, *keys: str) -> Column:
    """Value of the first tag whose key is one of ``keys``."""
    hits = F.filter(tags, lambda tag: tag["key"].isin(*keys))
    return F.get(hits, F.lit(0))["value"]


def pod_name(process: Column) -> Column:
    return first_tag(process["tags"], "name", "podName")


def node_name(process: Column) -> Column:
    return first_tag(process["tags"], "node_name", "nodeName")


def service_name(process: Column) -> Column:
    return process["serviceName"]


def parent_span_id(references: Column) -> Column:
    """Only a span with exactly one reference has a parent."""
    return F.when(F.size(references) == F.lit(1), F.get(references, F.lit(0))["spanID"])


def mentions_status(tags: Column) -> Column:
    """Some tag speaks of a status, in its key or its value."""
    def hit(tag):
        text = F.concat_ws(" ", tag["key"], tag["value"])
        return F.contains(F.lower(text), F.lit("status"))

    return F.coalesce(F.exists(tags, hit), F.lit(False))


def last_tag(tags: Column, key: str) -> Column:
    """Value of the last tag with this key that has a value."""
    hits = F.filter(tags, lambda tag: (tag["key"] == F.lit(key)) & tag["value"].isNotNull())
    return F.try_element_at(hits, F.lit(-1))["value"]
