"""Idempotent outputs: a task's rows are replaced as a whole, so a re-run leaves neither duplicates nor rows it no longer has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, functions as F


def write_task_output(df: DataFrame, path: str, task_id: int) -> int:
    """Write one task's rows below ``path`` (parquet, a folder ``task_id=N`` each task) in place of those it had; returns their number.

    Rows are staged and put in place when all tasks of the job are done; other tasks' folders stay. Without rows the task's folder is
    left with an empty file, so what an earlier run wrote is gone and the table can be read.
    """
    seen = Observation()
    rows = df.withColumn("task_id", F.lit(task_id).cast("int")).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)
    n = seen.get.get("n") or 0
    if not n:
        df.drop("task_id").limit(0).write.mode("overwrite").parquet(f"{path}/task_id={task_id}")
    return n


def write_task_table(df: DataFrame, table: str, task_id: int) -> int:
    """The same for a table of the catalog, partitioned by ``task_id``: a static overwrite of the task's partition, also by no rows. The table is created where it is missing."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.limit(0).withColumn("task_id", F.lit(task_id).cast("int")).write.format("parquet").partitionBy("task_id").saveAsTable(table)
    columns = [c for c in spark.table(table).columns if c != "task_id"]
    df.select(*columns).createOrReplaceTempView(view := f"rows_{uuid.uuid4().hex}")
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (task_id = {int(task_id)}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return spark.table(table).where(F.col("task_id") == task_id).count()  # of one partition, from its files' footers


def replace_task_jdbc(df: DataFrame, url: str, table: str, task_id: int, batch_size: int = 1000, **options: str) -> int:
    """Write a task's rows over JDBC in place of those it had, in one transaction of the database; returns their number.

    Tasks write to a staging table of their own in batches. Only when all are in, one transaction deletes the old rows and takes
    the new ones over, so a failed or retried write leaves the old rows. The target is created where it is missing.
    """
    write_jdbc(df.limit(0), url, table, batch_size, **options)
    staging = f"{table}_{uuid.uuid4().hex[:12]}"
    seen = Observation()
    quoted = df.sparkSession._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier  # as Spark names columns when it writes
    names = ", ".join(quoted(c) for c in df.columns)
    try:
        write_jdbc(df.observe(seen, F.count(F.lit(1)).alias("n")), url, staging, batch_size, "errorifexists", **options)
        _transaction(df, url, options, f"DELETE FROM {table} WHERE {quoted('task_id')} = {int(task_id)}", f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}")
    finally:
        _drop(df, url, options, staging)
    return seen.get.get("n") or 0


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, mode: str = "append", **options: str) -> None:
    """Write over JDBC in batches of ``batch_size`` rows a statement; errors propagate."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **options).mode(mode).save()


def _connection(df: DataFrame, url: str, options: dict[str, str]):
    jvm = df.sparkSession._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    return jvm.java.sql.DriverManager.getConnection(url, properties)


def _transaction(df: DataFrame, url: str, options: dict[str, str], *statements: str) -> None:
    """All statements or none."""
    connection = _connection(df, url, options)
    try:
        connection.setAutoCommit(False)
        for s in statements:
            connection.createStatement().executeUpdate(s)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _drop(df: DataFrame, url: str, options: dict[str, str], table: str) -> None:
    """Drop a table that may not have come to be."""
    connection = _connection(df, url, options)
    try:
        if connection.getMetaData().getTables(None, None, table, None).next() or connection.getMetaData().getTables(None, None, table.upper(), None).next():
            connection.createStatement().executeUpdate(f"DROP TABLE {table}")
    finally:
        connection.close()
