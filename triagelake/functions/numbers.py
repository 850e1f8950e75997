"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double, the way numerical Python rounds."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def nan_to_null(value: Column) -> Column:
    """A missing measurement is NULL, never NaN."""
    return F.when(~F.isnan(value), value)


def symmetric_ratio(fault: Column, normal: Column) -> Column:
    """Distance of two levels relative to their middle."""
    return F.abs(fault - normal) / ((fault + normal) / F.lit(2.0) + F.lit(1e-9))
