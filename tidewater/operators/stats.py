"""Visit-length and step-length histograms and their ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions import half_up_ratio

#: Bucket name, first and last whole second (None: no upper end).
VISIT_BUCKETS = (
    ("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60),
    ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None),
)
#: Bucket name, first and last number of steps.
STEP_BUCKETS = (("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None))


def _counts(column: str, buckets: tuple) -> list[Column]:
    c = F.col(column)
    inside = lambda lo, hi: c >= lo if hi is None else c.between(lo, hi)
    return [F.count_if(inside(lo, hi)).alias(f"{column}_{name}") for name, lo, hi in buckets]


def visit_length_histogram(sessions: DataFrame) -> DataFrame:
    """One row, nine counts; a visit of 0 seconds is in no bucket."""
    return sessions.agg(*_counts("visit_length", VISIT_BUCKETS))


def step_length_histogram(sessions: DataFrame) -> DataFrame:
    """One row, six counts."""
    return sessions.agg(*_counts("step_length", STEP_BUCKETS))


def session_aggr_stat(sessions: DataFrame, task_id: int) -> DataFrame:
    """One row: session count and the share of each bucket, two places half up; zeros where no session is left.

    One aggregate over the filtered sessions, so filter and counts are one pass.
    """
    g = sessions.agg(F.count(F.lit(1)).alias("n"), *_counts("visit_length", VISIT_BUCKETS), *_counts("step_length", STEP_BUCKETS))
    names = [f"visit_length_{b[0]}" for b in VISIT_BUCKETS] + [f"step_length_{b[0]}" for b in STEP_BUCKETS]
    return g.select(F.lit(task_id).cast("int").alias("task_id"), F.col("n").cast("int").alias("session_count"), *[half_up_ratio(F.col(c), F.col("n")).alias(c) for c in names])
