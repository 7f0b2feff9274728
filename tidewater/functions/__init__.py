"""Column expressions shared by the operators."""

from tidewater.functions.scalars import blank_to_null, half_up_ratio, is_empty, parse_time, trim_comma

__all__ = ["blank_to_null", "half_up_ratio", "is_empty", "parse_time", "trim_comma"]
