"""Connected components of a graph of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.sources.scratch import discard, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a long, b long) to (v, component), the smallest vertex of each component; one row a vertex with an edge.

    Each step is a minimum per vertex with partial aggregation and a join, so a hub of any degree is never gathered; each
    round is written to the shared folder, as is the result. Rounds end when the edges, then stars, no longer change.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct()
    e = materialize(e, name)
    seen = None
    while True:
        both = e.union(e.select("m", "u"))
        low = both.groupBy("u").agg(F.min("m").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("m > u").select(F.col("m").alias("u"), F.col("low").alias("m")).distinct()
        least = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(least, "u").where("m <> low").select(F.greatest("m", "low").alias("u"), F.least("m", "low").alias("m"))
        before, e = e, materialize(small.union(least.select("u", "low")).distinct(), name)
        discard(before)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "m")).alias("x")).first()
        if now == seen:
            break
        seen = now
    out = materialize(e.select(F.col("u").alias("v"), F.col("m").alias("component")).union(e.select("m", "m").distinct()), name)
    discard(e)
    return out
