"""Session rollup and user join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.functions import parse_time


def session_rollup(actions: DataFrame) -> DataFrame:
    """One row a session: user, distinct keywords and categories, start, end, visit length, step length.

    Two levels. The first groups actions by session, user, keyword and category: only minima, maxima and a count, so it stays
    a hash aggregate with partial sums on the map side, and a session with a third of all actions is many groups until its repeats are gone. The second
    merges what is left of each session. A log bucketed by session_id (``save_actions``) needs no shuffle for either.

    Keywords that are null or '' and null categories are left out; sets are sorted. A time that cannot be read is ignored
    by start and end, but its row counts as a step; the user is that of the earliest
    readable action, the smaller id on ties.
    """
    a = actions.select("session_id", "user_id", F.nullif("search_keyword", F.lit("")).alias("kw"), "click_category_id", parse_time(F.col("action_time")).alias("at"))
    parts = a.groupBy("session_id", "user_id", "kw", "click_category_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    g = parts.groupBy("session_id").agg(
        F.min_by("user_id", F.struct(F.col("first").isNull(), "first", "user_id")).alias("user_id"),
        F.array_sort(F.collect_set("kw")).alias("search_keywords"),
        F.array_sort(F.collect_set("click_category_id")).alias("click_category_ids"),
        F.min("first").alias("start_time"),
        F.max("last").alias("end_time"),
        F.sum("n").alias("step_length"),
    )
    length = F.unix_seconds(F.col("end_time")) - F.unix_seconds(F.col("start_time"))
    return g.withColumn("visit_length", F.coalesce(length, F.lit(0)))


def session_user_join(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with age, professional, city and sex; sessions of unknown users drop out.

    No hint: Spark broadcasts the user table while it is small and sort-merges beyond.
    """
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def session_count(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("session_count"))
