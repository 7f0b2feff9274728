"""Task record: one row with JSON parameters, each an array whose first element counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The parameter keys of a task record.
PARAM_KEYS = ("startDate", "endDate", "startAge", "endAge", "professionals", "cities", "sex", "keywords", "categoryIds")


@dataclass(frozen=True)
class TaskParams:
    """Parameters of one task; None means that the parameter is absent (or empty)."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[int, ...] | None = None


def task_params(tasks: DataFrame, task_id: int) -> DataFrame:
    """The task's parameters as one row of columns; only element 0 of each array is read, '' reads as missing."""
    first = [F.nullif(F.get_json_object("task_param", f"$.{k}[0]"), F.lit("")).alias(k) for k in PARAM_KEYS]
    return tasks.where(F.col("task_id") == task_id).select("task_id", *first)


def read_task(tasks: DataFrame, task_id: int) -> TaskParams:
    """The one driver round trip of a job: the task row. A missing task raises LookupError."""
    row = task_params(tasks, task_id).first()
    if row is None:
        raise LookupError(f"no task {task_id}")
    many = lambda v: None if v is None else tuple(v.split(","))
    return TaskParams(
        row.startDate, row.endDate,
        None if row.startAge is None else int(row.startAge), None if row.endAge is None else int(row.endAge),
        many(row.professionals), many(row.cities), row.sex, many(row.keywords),
        None if row.categoryIds is None else tuple(int(x) for x in row.categoryIds.split(",")),
    )


def read_task_jdbc(spark: SparkSession, url: str, table: str = "task", **options: str) -> DataFrame:
    """A table over JDBC, columns in lower case; predicates, such as that on ``task_id``, are pushed to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.toDF(*[c.lower() for c in df.columns])


def read_source(spark: SparkSession, at: str, table: str, **options: str) -> DataFrame:
    """A parquet path, a table name of the catalog, or ``table`` of a ``jdbc:`` address."""
    if at.startswith("jdbc:"):
        return read_task_jdbc(spark, at, table, **options)
    return spark.read.parquet(at) if "/" in at else spark.table(at)
