"""Instants are kept as nanoseconds since the epoch; these expressions convert them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.fixed_values import LOCAL_ZONE


def iso_to_ns(text: Column) -> Column:
    """ISO-8601 text to nanoseconds; digits beyond the microsecond are kept."""
    micros = F.unix_micros(F.try_to_timestamp(text))
    fraction = F.regexp_extract(text, r"\.(\d+)", 1)
    rest = F.substring(F.rpad(fraction, 9, "0"), 7, 3).cast("long")
    # most instants end with the microsecond; the expression is only needed for others
    seventh = F.substr(text, F.instr(text, ".") + F.lit(7), F.lit(1))
    longer = seventh.between(F.lit("0"), F.lit("9"))
    return micros * F.lit(1000) + F.when(longer, rest).otherwise(F.lit(0).cast("long"))


def ns_to_utc(ns: Column) -> Column:
    whole = ns - F.pmod(ns, F.lit(1000))  # whole numbers throughout: a double has 53 bits
    return F.timestamp_micros(F.call_function("div", whole, F.lit(1000)))


def ns_to_local(ns: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ns_to_utc(ns), zone)


def local_date(ns: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(ns_to_local(ns, zone), "yyyy-MM-dd")


def local_hour_key(ns: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(ns_to_local(ns, zone), "yyyy-MM-dd_HH")
