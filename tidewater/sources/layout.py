"""Tables bucketed by a key, so that aggregates and joins on the key read them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidewater.sources.scratch import scratch_path


def bucketed(df: DataFrame, name: str, buckets: int, *columns: str, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Save ``df`` as table ``name``, bucketed by ``columns`` in files below ``path``, and read it back.

    Each task writes the buckets it holds; shuffle ``df`` by the columns first where one file a bucket is wanted. Readers that group by
    the columns, or join on them, need no exchange of this table.
    """
    writer = df.write.format("parquet").bucketBy(buckets, *columns).partitionBy(*partition_by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_scratch(df: DataFrame, name: str, buckets: int, *columns: str) -> DataFrame:
    """As ``materialize``, bucketed: a table of its own name in the shared folder, for ``discard``."""
    table = f"tidewater_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, table)
    stored = bucketed(df, table, buckets, *columns, path=path)
    stored._tidewater_path, stored._tidewater_table = path, table
    return stored
