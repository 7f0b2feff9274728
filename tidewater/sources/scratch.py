"""Scratch tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; where none is set (tests on one machine), a temporary folder, then set."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewater/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._tidewater_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables made by ``materialize`` or ``bucketed_scratch`` that nothing reads any more."""
    for df in stored:
        if table := getattr(df, "_tidewater_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidewater_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
