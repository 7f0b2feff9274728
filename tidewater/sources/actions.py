"""The action log (12 columns) and the user dimension (7 columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.sources.layout import bucketed

USER_COLUMNS = ("user_id", "username", "name", "age", "professional", "city", "sex")


def actions_in_range(actions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose ``date`` lies in [start, end]; a missing bound is open.

    The bounds are Column predicates on the raw column, so a table partitioned by
    ``date`` is pruned and a file's statistics are used.
    """
    if start is not None:
        actions = actions.where(F.col("date") >= F.lit(start))
    if end is not None:
        actions = actions.where(F.col("date") <= F.lit(end))
    return actions


def save_actions(actions: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save the action log as a table partitioned by ``date`` and bucketed by ``session_id``, and read it back.

    A date range prunes partitions; the rollup and the detail of a sample read it without a shuffle of actions.
    """
    return bucketed(actions.repartition(buckets, "session_id"), table, buckets, "session_id", path=path, partition_by=("date",))


def user_dim(users: DataFrame) -> DataFrame:
    return users.select(*USER_COLUMNS)


def adapt_actions(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``events`` seen as an action log: a session is one user's day.

    The date range becomes a half-open range on the raw timestamp, so it reaches the scan.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        e = e.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        e = e.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    day = F.col("ts").cast("date").cast("string")
    product = F.col("event_id") % 100
    return e.select(
        day.alias("date"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("_"), day).alias("session_id"),
        (k % 10).alias("page_id"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").cast("string").alias("action_time"),
        F.when(kind == "view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        F.when(kind == "click", k).alias("click_category_id"),
        F.when(kind == "click", product).alias("click_product_id"),
        F.when(kind == "signup", k.cast("string")).alias("order_category_ids"),
        F.when(kind == "signup", product.cast("string")).alias("order_product_ids"),
        F.when(kind == "purchase", k.cast("string")).alias("pay_category_ids"),
        F.when(kind == "purchase", product.cast("string")).alias("pay_product_ids"),
    )


def adapt_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` joined to ``nation``, seen as the user table."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("name"),
        (F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"),
        F.col("n_name").alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
    )
