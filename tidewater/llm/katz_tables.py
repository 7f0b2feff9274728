"""Katz backoff model of any order in stored n-gram tables, for texts of this corpus or another.

The model is that of ``katz``, with histories of up to ``order - 1`` words: P(w | h) = d_r * r / c(h) where h and w stand together r times in
training, else alpha(h) * P(w | h without its first word), down to the word alone and the unknown word. Good-Turing discounts are found for each
length of n-gram; alpha(h) makes the probabilities after h sum to exactly one; a history never seen has alpha 1.

Tables, partitioned by n: ``grams`` (n, gram, r, log_p), one row an n-gram seen, and ``backoff`` (n, history, log_alpha), one row a history. n-grams are named by 64-bit
hashes and counted with partial sums a stretch of text at a time; probabilities and weights are joins and sums over these tables. Scoring looks
each different n-gram of the new texts up once, from the longest to the shortest.

Edge cases: null and empty texts are one end token; a model of no texts knows the unknown word alone; equal texts are
scored once; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.llm import katz, words
from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize


GRAMS, BACKOFF = "gram long, r long, log_p double, n int", "history long, log_alpha double, n int"


class Model(NamedTuple):
    order: int
    grams: DataFrame
    backoff: DataFrame
    unknown: float

    def save(self, path: str) -> None:
        self.grams.write.mode("overwrite").partitionBy("n").parquet(f"{path}/grams")
        self.backoff.write.mode("overwrite").partitionBy("n").parquet(f"{path}/backoff")
        self.grams.sparkSession.createDataFrame([(self.order, self.unknown)], "order int, unknown double").write.mode("overwrite").parquet(f"{path}/constants")


def load(spark: SparkSession, path: str) -> Model:
    c = spark.read.parquet(f"{path}/constants").first()
    return Model(c.order, spark.read.schema(GRAMS).parquet(f"{path}/grams"), spark.read.schema(BACKOFF).parquet(f"{path}/backoff"), c.unknown)


def _chains(texts: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(first row, end row, first token of each row, n-grams that end at each token for n = 1.., their histories for n = 1..; the first is unused)."""
    for lo, hi, w, _, at in katz.tokens(texts):
        grams, histories = [w], [w]
        for _ in range(1, order):
            history = np.empty_like(w)
            history[1:] = grams[-1][:-1]
            history[at[:-1]] = katz.START
            histories.append(history)
            grams.append(words.paired(history, w))
        yield lo, hi, at, grams, histories


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _log_discounted(n: Column, r: Column, discounts: list[np.ndarray]) -> Column:
    """log10 of d_r * r."""
    table = F.array(*(F.array(*(F.lit(float(x)) for x in (*d, katz.BIG))) for d in discounts))
    return F.log10(F.element_at(F.element_at(table, n), F.least(r, F.lit(katz.TOP + 1)).cast("int")) * r)


def fit(docs: DataFrame, order: int = 3, text_col: str = "text") -> Model:
    """The model of all texts of ``docs``; its tables are in the scratch folder until saved."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, grams, histories in _chains(b.column(0), order):
                for n in range(1, order + 1):
                    names, one, r = np.unique(grams[n - 1], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(names), n, np.int32)), _signed(names), _signed(histories[n - 1][one]), _signed(grams[n - 2][one]), pa.array(r)],
                        ["n", "gram", "history", "lower", "r"],
                    )

    counts = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(count, "n int, gram long, history long, lower long, r long")
    counts = counts.groupBy("n", "gram").agg(F.sum("r").alias("r"), F.min("history").alias("history"), F.min("lower").alias("lower"))
    counts = materialize(counts, "katz-counts")
    tally = np.zeros((order + 1, katz.TOP + 3), np.int64)
    for x in counts.groupBy("n", F.least("r", F.lit(katz.TOP + 2)).alias("r")).agg(F.count(F.lit(1)).alias("times")).collect():  # a few rows a length
        tally[x.n, x.r] = x.times
    total = counts.where("n = 1").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first().r
    big = int(total - (tally[1, 1 : katz.TOP + 1] * np.arange(1, katz.TOP + 1)).sum())
    unknown = katz.constants(tally[1], big, tally[1], int(tally[1].sum()), 0).unknown
    discounts = [katz.good_turing(tally[n]) for n in range(1, order + 1)]

    # a history's count; every word has the same at n = 1
    by = counts.where("n > 1").groupBy("n", "history").agg(F.sum("r").alias("c"))
    grams = counts.join(by, ["n", "history"], "left")
    log_p = _log_discounted(F.col("n"), F.col("r"), discounts) - F.log10(F.coalesce("c", F.lit(total)).cast("double"))
    grams = materialize(grams.withColumn("log_p", log_p), "katz-grams")
    low = grams.select((F.col("n") + 1).alias("n"), F.col("gram").alias("lower"), F.col("log_p").alias("lower_p"))
    met = grams.where("n > 1").join(low, ["n", "lower"])
    sums = met.groupBy("n", "history").agg(F.sum(F.pow(F.lit(10.0), "log_p")).alias("seen"), F.sum(F.pow(F.lit(10.0), "lower_p")).alias("below"))
    backoff = materialize(sums.select("n", "history", (F.log10(1 - F.col("seen")) - F.log10(1 - F.col("below"))).alias("log_alpha")), "katz-backoff")
    discard(counts)
    return Model(order, grams.select("n", "gram", "r", "log_p"), backoff, unknown)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and score, the model's log10 probability of the whole text."""
    bounded_batches(docs.sparkSession)
    order = model.order
    names = [*(f"g{n}" for n in range(1, order + 1)), *(f"h{n}" for n in range(2, order + 1))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, at, grams, histories in _chains(b.column(1), order):
                row = np.repeat(np.arange(lo, hi), np.diff(at))
                by = np.lexsort((grams[-1], row))
                new = np.ones(len(by), bool)
                new[1:] = (grams[-1][by][1:] != grams[-1][by][:-1]) | (row[by][1:] != row[by][:-1])
                one = by[new]
                times = np.diff(np.append(np.flatnonzero(new), len(by)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[one])), pa.array(times), *(_signed(x[one]) for x in (*grams, *histories[1:]))], ["key", "times", *names])

    made = ("n_tokens", "score")
    keyed = docs.drop(*made).withColumn("_katz_key", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    texts = keyed.select("_katz_key", F.coalesce(text_col, F.lit("")).alias("text")).dropDuplicates(["_katz_key"])
    each = materialize(texts.mapInArrow(read, ", ".join(["key string", "times long", *(f"{c} long" for c in names)])), "katz-tokens")
    top = each.select(*names).dropDuplicates([f"g{order}"])
    value = F.lit(float(np.log10(model.unknown)))
    for n in range(1, order + 1):
        p = model.grams.where(F.col("n") == n).select(F.col("gram").alias(f"g{n}"), F.col("log_p").alias(f"p{n}"))
        top = top.join(p, f"g{n}", "left")
        if n == 1:
            value = F.coalesce(F.col("p1"), value)
        else:
            a = model.backoff.where(F.col("n") == n).select(F.col("history").alias(f"h{n}"), F.col("log_alpha").alias(f"a{n}"))
            top = top.join(a, f"h{n}", "left")
            value = F.coalesce(F.col(f"p{n}"), F.coalesce(F.col(f"a{n}"), F.lit(0.0)) + value)
    scored = each.select("key", "times", f"g{order}").join(top.select(f"g{order}", value.alias("value")), f"g{order}")
    sums = scored.groupBy("key").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("value")).alias("score"))
    sums = materialize(sums.withColumnRenamed("key", "_katz_key"), "katz-sums")
    discard(each)
    return keyed.join(sums, "_katz_key").drop("_katz_key")
