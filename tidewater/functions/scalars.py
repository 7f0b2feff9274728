"""Scalar expressions: time parsing, exact ratios, empty-string tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_time(c: Column) -> Column:
    """``yyyy-MM-dd H:mm:ss`` (one- or two-digit hour) as a timestamp; null where it cannot be read."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd H:mm:ss"))


def half_up_ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded half up to two places in exact integer arithmetic; 0.0 for a zero or null whole."""
    p, n = part.cast("bigint"), whole.cast("bigint")
    hundredths = F.call_function("div", p * 200 + n, F.nullif(n * 2, F.lit(0)))
    return F.coalesce(hundredths / F.lit(100.0), F.lit(0.0))


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_comma(c: Column) -> Column:
    """Drop one leading and one trailing comma."""
    return F.regexp_replace(c, r"^,|,\z", "")
