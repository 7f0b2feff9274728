"""Mixing sources to target weights by weighted fair queueing, by DataFrame functions only.

Each source's documents stand in a shuffled queue that may be passed through up to ``max_repeats`` times. A document's
virtual finish time is its source's words up to and including it, over the source's target.
All entries in order of finish time, cut where the words of all sources would pass
the budget, are the mix: at finish time 1 every source has had its target.

Running sums are built in two levels: sums of (source, slice of the shuffle key), offsets over those
sums, then sums within a slice. No task sees a whole source, however large.

Edge cases: null text has 0 words; documents without words take up no budget; a null
source is a source of its own, last in order; null ids are ordered by content; rows of equal ids by the rest; equal rows
are separate entries; documents larger than their source's target finish late and are taken if the budget is not used up by then; an empty table gives an empty mix. Input columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.sources.scratch import discard, materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000  # source tables beyond this many rows are joined by a shuffle
SLICE_ROWS = 500  # aim for this many rows of the largest source in a slice
BINS, SORTED = 2000, 20_000  # stretches of time looked at together; entries sorted in one task


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, source_rank, target): weights by rank, capped at
    ``max_repeats`` times the size, the excess shared out again by weight until none is above.

    That end point is min(cap, level * weight) for one level. With sources ordered by
    cap / weight, the level is the first at which the budget left after the
    capped sources, per weight left, does not pass the next source's cap. One row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*map(F.lit, weights))
    s = sizes.withColumn("source_rank", rank).withColumn("_w", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * max_repeats).withColumn("_fill", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_fill", "source_rank")
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (budget - before) / left)
    s = s.withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "source_rank", "_level"))).over(every))
    return s.select("source", "source_size", "source_rank", F.least(F.col("_cap").cast("double"), F.col("_first._level") * F.col("_w")).alias("target"))


def queue_key(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Shuffle key: md5 of seed and id, or of the content where the id is null."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("x"), F.xxhash64(text_col).cast("string")))))


def fair_queue(rows: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, Callable[[DataFrame], Callable[[Column], Column]]]:
    """``rows`` (source, size, _key, _tie, ...) with source_size, source_rank, target and _sum, the words of
    its source up to this row; and a function from such rows, stored, to: as a function of the pass, whether that entry is in the mix.

    ``rows`` is read several times: it should be a stored table or cheap to compute.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sizes = materialize(sizes, "mix-sources")
    bound = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"), F.coalesce(F.max("_rows"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("sources")).first()
    targets = source_targets(sizes.drop("_rows"), weights, max_repeats)
    slices = max(1, min(1 << 20, -(-bound.most // SLICE_ROWS)))
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("_slice", F.shiftright(lead * slices, 32))
    tagged = rows.join(F.broadcast(targets) if bound.sources <= BROADCAST_SOURCES else targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])

    sums = tagged.groupBy("source_rank", "_slice").agg(F.sum("size").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("source_rank").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source_rank", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("size").over(Window.partitionBy("source_rank", "_slice").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    queued = tagged.withColumn("_within", within).join(offsets, ["source_rank", "_slice"])
    queued = queued.withColumn("_sum", F.col("_before") + F.col("_within")).drop("_before", "_within", "_slice")

    return queued, lambda kept: _within(_cut(kept, bound.budget, max_repeats))


def _within(cut) -> Callable[[Column], Column]:
    if cut is None:
        return lambda p: F.lit(True)
    last = F.struct(F.lit(cut.f).alias("f"), F.lit(cut.s).alias("s"), F.lit(cut.k).alias("k"), F.lit(cut.t).alias("t"))
    return lambda p: F.struct(finish_time(p).alias("f"), F.col("source_rank").alias("s"), F.col("_key").alias("k"), F.col("_tie").alias("t")) < last


def finish_time(p: Column) -> Column:
    """Virtual finish time of a document's entry in pass ``p``; nothing is due to a source without words."""
    return F.coalesce((p * F.col("source_size") + F.col("_sum")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))


def _cut(queued: DataFrame, budget: int, max_repeats: int):
    """The first entry that would pass the budget, as a row (f, s, k, t); None if all entries fit.

    The finish time where the budget ends is closed in on: words by ``BINS`` stretches of time (all that reaches
    the driver), then by ``BINS`` stretches of the one where the budget ends, until that holds few entries; only they are sorted.
    """
    entries = queued.where("size > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    entries = entries.select(finish_time(F.col("_pass")).alias("f"), F.col("source_rank").alias("s"), F.col("_key").alias("k"), F.col("_tie").alias("t"), "size")
    total = entries.agg(F.sum("size").alias("size"), F.min("f").alias("lo"), F.max("f").alias("hi")).first()
    if (total.size or 0) <= budget:
        return None
    at, before, lo, hi = entries, 0, total.lo, total.hi
    while hi > lo:
        bin_ = F.least(F.floor((F.col("f") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = at.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).orderBy("bin").collect()
        for b in bins:
            if before + b["size"] > budget:
                break
            before += b["size"]
        lo, hi = b.lo, b.hi
        at = entries.where((F.col("f") >= lo) & (F.col("f") <= hi))
        if b.n <= SORTED:
            break
    w = Window.orderBy("f", "s", "k", "t").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("_upto", F.sum("size").over(w) + F.lit(before))
    return at.where(F.col("_upto") > budget).orderBy("f", "s", "k", "t").first()


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with ``mix_pass`` and ``virtual_finish``, sorted by finish time."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), queue_key(seed, id_col, text_col).alias("_key"), F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)).alias("_tie"))
    queued, within = fair_queue(rows, max_repeats, weights)
    narrow = materialize(queued.drop("_row"), "mix-queued")  # texts stay where they are while the cut is looked for
    taken = within(narrow)
    discard(narrow)
    entries = queued.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).where(taken(F.col("_pass")) & ((F.col("size") > 0) | (F.col("_pass") == 0)))
    ordered = entries.withColumn("_finish", finish_time(F.col("_pass"))).orderBy("_finish", "source_rank", "_key", "_tie")
    keep = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("mix_pass", "virtual_finish")]
    return ordered.select(*keep, F.col("_pass").alias("mix_pass"), F.col("_finish").alias("virtual_finish"))


def taken_words(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), queue_key(seed).alias("_key"), F.xxhash64("text").alias("_tie"))
    rows = materialize(rows, "mix-rows")
    queued, within = fair_queue(rows, max_repeats, weights)
    queued = materialize(queued, "mix-queued")
    discard(rows)
    times = F.size(F.filter(F.array(*map(F.lit, range(max_repeats))), within(queued)))
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("bigint").alias("taken"))
