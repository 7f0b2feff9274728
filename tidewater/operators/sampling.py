"""Sampling stratified by hour, in proportion to traffic, and the sampled sessions' actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewater.functions import blank_to_null


def _with_hour(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns({"date": F.date_format("start_time", "yyyy-MM-dd"), "hour": F.hour("start_time")})


def sessions_per_hour(sessions: DataFrame) -> DataFrame:
    return _with_hour(sessions).groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"))


def sessions_per_day(sessions: DataFrame) -> DataFrame:
    return _with_hour(sessions).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def _quota(hours: DataFrame, total: int) -> DataFrame:
    """(date, hour, n) with each hour's quota."""
    day = hours.groupBy("date").agg(F.sum("n").alias("day_n"))
    day = day.withColumn("days", F.count(F.lit(1)).over(Window.partitionBy()))  # one row a day
    per_day = F.call_function("div", F.lit(total).cast("bigint"), F.col("days"))
    share = F.floor(F.col("n").cast("double") / F.col("day_n").cast("double") * per_day)
    return hours.join(day, "date").select("date", "hour", "n", F.least("n", share.cast("bigint")).alias("quota"))


def sample_quota(sessions: DataFrame, total: int = 100) -> DataFrame:
    """Sessions to draw from each hour: total div days, shared by hour in proportion and truncated.

    One row an hour of data, so its size does not grow with traffic. The share is taken in
    doubles (29 of 100 at 100 a day gives 28). No sessions give no rows.
    """
    return _quota(sessions_per_hour(sessions), total)


def _drawn(sessions: DataFrame, seed: str) -> DataFrame:
    """Sessions with date, hour, a seeded hash, and the hash's class: a rising function of it, eight classes to each halving of what is left."""
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("session_id")))
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("double")
    return _with_hour(sessions).withColumn("h", h).withColumn("class", F.floor(F.log2(number + 1) * 8).cast("int"))


def candidates(sessions: DataFrame, total: int, seed: str) -> DataFrame:
    """Sessions of the classes that hold their hour's quota, with ``quota``: about an eighth more than are drawn."""
    drawn = _drawn(sessions, seed)
    classes = drawn.groupBy("date", "hour", "class").agg(F.count(F.lit(1)).alias("n"))
    quota = _quota(classes.groupBy("date", "hour").agg(F.sum("n").alias("n")), total).where("quota > 0").select("date", "hour", "quota")
    before = F.sum("n").over(Window.partitionBy("date", "hour").orderBy("class")) - F.col("n")
    ends = classes.join(quota, ["date", "hour"]).withColumn("before", before).where(F.col("before") < F.col("quota"))
    ends = ends.groupBy("date", "hour").agg(F.max("class").alias("end"), F.max("quota").alias("quota"))
    return drawn.join(F.broadcast(ends), ["date", "hour"]).where(F.col("class") <= F.col("end"))


def sample_sessions(sessions: DataFrame, total: int = 100, seed: str = "0") -> DataFrame:
    """The sampled sessions: the ``quota`` sessions of each hour with the smallest seeded hash.

    A uniform draw without replacement that repeats for the same seed. Sessions are counted by hour and class of the hash (at most 480 classes, summed
    before they move); the classes that hold an hour's quota are its candidates, whatever its traffic and
    whatever ``total``. Only they are shuffled and ranked. The classes' ends are one row an hour that is sampled, ``total`` rows at most, so they are broadcast.
    ``sessions`` is read twice: a stored table saves computing it again.
    """
    w = Window.partitionBy("date", "hour").orderBy("h", "session_id")
    ranked = candidates(sessions, total, seed).withColumn("rn", F.row_number().over(w))
    return ranked.where("rn <= quota").drop("h", "class", "end", "rn", "quota", "date", "hour")


def session_random_extract(sampled: DataFrame, task_id: int) -> DataFrame:
    """Sampled sessions in the 5 output columns; an empty list is written as null."""
    text = lambda c: blank_to_null(F.array_join(c, ","))
    return sampled.select(
        F.lit(task_id).cast("int").alias("task_id"), "session_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        text("click_category_ids").alias("click_category_ids"), text("search_keywords").alias("search_keywords"),
    )


def session_detail(actions: DataFrame, sampled: DataFrame, task_id: int) -> DataFrame:
    """Every action of a sampled session in the 12 output columns.

    A left semi join: the sample holds at most ``total`` ids, and Spark chooses the join from its size.
    """
    kept = actions.join(sampled.select("session_id"), "session_id", "left_semi")
    names = ("user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids")
    return kept.select(F.lit(task_id).cast("int").alias("task_id"), *names)
