"""Sharding: a keyed Feistel permutation of global row numbers, by DataFrame functions only.

Rows are numbered 0..n-1 in (doc_id, content hash) order. The permutation works on the
mixed-radix square a*b >= n with a = ceil(sqrt n), so less than one number in sqrt(n) lands
outside [0, n) and walks the cycle until it is inside. Row number r goes to shard
p(r) mod shards at slot p(r) div shards: counts differ by one at most, slots have no gaps, and either
can be computed for any row number without the table (``place``).

Edge cases: an empty table gives no rows; null ids sort first and are spread by content; equal
rows take neighbouring numbers (which of two identical rows has which cannot be told); null
text counts as empty. Columns of the input named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.sources.scratch import materialize

P = 2147483647  # a prime; products of two residues fit into 63 bits
PAIRS = 4  # Feistel rounds, two at a time


def round_keys(seed: int) -> list[tuple[int, int]]:
    digest = lambda i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16) % P
    return [(digest(2 * i), digest(2 * i + 1)) for i in range(PAIRS)]


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mix(x, k):
    """Round function on integers or Columns: residues mod P, never over 63 bits."""
    t = ((x % P) * 48271 + k) % P
    s = (t * t + 12345) % P
    return (s * 69621 + t) % P


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, without the table."""
    a, b = sides(n)
    x = row
    while True:
        left, right = divmod(x, b)
        for k1, k2 in round_keys(seed):
            left = (left + _mix(right, k1)) % a
            right = (right + _mix(left, k2)) % b
        x = left * b + right
        if x < n:
            return x % shards, x // shards


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    keys = F.array(*(F.struct(F.lit(k1).cast("bigint").alias("k1"), F.lit(k2).cast("bigint").alias("k2")) for k1, k2 in round_keys(seed)))
    la, lb = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")

    def pair(acc: Column, k: Column) -> Column:
        left = (acc["l"] + _mix(acc["r"], k["k1"])) % la
        return F.struct(left.alias("l"), ((acc["r"] + _mix(left, k["k2"])) % lb).alias("r"))

    start = F.struct(F.call_function("div", x, lb).alias("l"), (x % lb).alias("r"))
    return F.aggregate(keys, start, pair, lambda s: s["l"] * lb + s["r"])


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The Feistel image of ``row`` within [0, n); the walk is as long as there are numbers outside, so it always ends."""
    a, b = sides(n)
    outside = a * b - n
    first = _feistel(row, a, b, seed)
    if not outside:
        return first
    inside = lambda v: v < n
    walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), v, lambda u, _: F.when(inside(u), u).otherwise(_feistel(u, a, b, seed)))
    return F.aggregate(F.array(first), row, lambda _, v: F.when(inside(v), v).otherwise(walk(v)))


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Global row numbers 0..n-1 in ``order``: one range shuffle, no window over all rows.

    The ranges are written once to the shared folder, since another run of the
    range partitioner may cut elsewhere. Offsets are one row a partition, which bounds their broadcast.
    """
    at = "_tidewater_at"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    part = F.shiftright(at, 33)
    counts = ranged.groupBy(part.alias("_tidewater_part")).agg(F.count(F.lit(1)).alias("_tidewater_n"))
    before = F.sum("_tidewater_n").over(Window.orderBy("_tidewater_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_tidewater_part", F.coalesce(before, F.lit(0)).alias("_tidewater_before"))
    out = ranged.join(F.broadcast(offsets), part == F.col("_tidewater_part"))
    return out.withColumn(name, F.col("_tidewater_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, "_tidewater_part", "_tidewater_before")


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", content: list[str] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long); see the module's text.

    ``content`` names the columns that order rows of equal id (all hashable ones by default).
    """
    keep = docs.drop("shard", "slot")
    content = content or [c for c, kind in keep.dtypes if c != id_col and not kind.startswith("map") and "variant" not in kind]
    tie = "_tidewater_tie"
    rows = numbered(keep.withColumn(tie, F.xxhash64(F.lit(seed), *content)), [id_col, tie], "_tidewater_row").drop(tie)
    n = rows.count()
    image = "_tidewater_image"
    rows = rows.withColumn(image, permuted(F.col("_tidewater_row"), n, seed))
    return rows.withColumns({"shard": (F.col(image) % shards).cast("int"), "slot": F.call_function("div", F.col(image), F.lit(shards).cast("bigint"))}).drop(image, "_tidewater_row")
