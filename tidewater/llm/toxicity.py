"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of words after words. It takes, in turn:

* what follows the word before: counts of word pairs by class;
* the word alone: counts by class;
* its spelling: each byte, and the word's end, after up to ``ORDER - 1`` bytes before it in the word, counts by class;
* shorter runs of bytes, down to none: counts of both classes together.

Each level keeps what is left of its counts after a discount and passes on to the next level what was taken. As Kneser-Ney asks, what is counted for a pair or a
word are the different words before it, so copies of a text count once; byte runs are counted by word, and below the highest order by the different bytes
before. The levels by class take whole counts off: a rare expression keeps nothing there, so it says
no more than its parts are known to say. How much is chosen from ``DISCOUNTS`` by the log-loss on training rows that the models have not seen.

A text's evidence is the log-likelihood ratio of the two models by word, length-normalised: the mean over the text, and the highest of a word.
A logistic curve over these two, fitted on texts that its models have not seen, turns evidence into a score from 0 to 1. Toxic texts weigh
``WEIGHT`` times as much there (or as often as they are rarer, if that is less), as they are few.

Fitting uses labelled rows only: at most about ``SAMPLE`` of them, drawn by hash. A quarter of them is kept from the models of the curve and for the choice of
discounts; the final models have all. Of words and pairs only those above the discount and the histories that hold such are sent to the executors, of spelling the byte
runs of the sample. Scoring covers every row and whole texts.

Edge cases: null, empty and word-free texts have no evidence and get the curve's value there; without
labels of both classes every score is the share of toxic labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.llm import words
from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

ORDER = 7
DISCOUNT = 0.75  # of counts of both classes
SAMPLE = 8_000
FILES = 16  # of the sample's texts
WEIGHT = 2.0
THRESHOLD = 0.7
START = np.uint64(0x3C79AC492BA7B653)  # stands for the word before the first
END = 32  # stands for the end of a word; no word holds this byte
BYTE = np.uint64(8)


class Discounts(NamedTuple):
    """What is taken off counts by class."""

    run: float
    word: float
    pair: float


DISCOUNTS = (Discounts(3.0, 2.0, 6.0), Discounts(2.0, 2.0, 4.0), Discounts(4.0, 3.0, 8.0))


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the given words and their ends, with up to ORDER - 1 bytes before in the word, packed into an integer (last byte lowest); and where each word's begin."""
    n = ends - starts
    at = np.concatenate(([0], np.cumsum(n + 1)))
    offset = np.arange(at[-1]) - np.repeat(at[:-1], n + 1)
    flat = np.full(at[-1], END, np.uint64)
    inner = offset < np.repeat(n, n + 1)
    flat[inner] = data[(np.repeat(starts, n + 1) + offset)[inner]]
    key = flat.copy()
    for d in range(1, ORDER):
        ok = offset >= d
        key[ok] |= flat[np.flatnonzero(ok) - d] << np.uint64(8 * d)
    return key, at


def before(h: np.ndarray, first: np.ndarray, start: np.ndarray | np.uint64 = START) -> np.ndarray:
    """The word before each word within its row."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[first[:-1][np.diff(first) > 0]] = start
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are among the sorted keys, and their places there (anything where not)."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[i] == x, i


class Table(NamedTuple):
    """Log-likelihood ratios by sorted key."""

    key: np.ndarray
    ratio: np.ndarray

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x have a ratio, and the ratio (0 where not)."""
        known, i = _find(self.key, x)
        out = np.zeros(len(x))
        out[known] = self.ratio[i[known]]
        return known, out


NONE = Table(np.empty(0, np.uint64), np.empty(0))


class Model(NamedTuple):
    """Ratios of byte runs, of unseen bytes by context, of words and pairs above the discount, of other words by history; what is passed on below words; the curve's weights."""

    run: Table = NONE
    context: Table = NONE
    word: Table = NONE
    pair: Table = NONE
    history: Table = NONE
    rest: float = 0.0
    curve: np.ndarray = np.zeros(3)

    def spelling(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ratios of words by their bytes alone."""
        if not len(starts):
            return np.empty(0)
        key, at = runs(data, starts, ends)
        seen, out = self.run.of(key)
        out[~seen] = self.context.of(key[~seen] >> BYTE)[1]  # what an unseen byte is passed on to is the same for both classes
        return np.add.reduceat(out, at[:-1])

    def by_word(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Ratio of every word of some rows."""
        one, back = np.unique(h, return_index=True, return_inverse=True)[1:]
        known, alone = self.word.of(h[one])
        new = one[~known]
        alone[~known] = self.rest + self.spelling(data, starts[new], ends[new])
        history = before(h, first)
        paired, ratio = self.pair.of(words.paired(history, h))
        return np.where(paired, ratio, self.history.of(history)[1] + alone[back])

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean ratio over its words, and the highest of a word."""
        out = np.zeros((len(texts), 2))
        for lo, hi, data, starts, ends, h, first in words.spelled(texts, plain=True):
            if not len(h):
                continue
            ratio = self.by_word(data, starts, ends, h, first)
            n = np.diff(first)
            some = np.flatnonzero(n)
            out[lo + some, 0] = np.add.reduceat(ratio, first[some]) / n[some]
            out[lo + some, 1] = np.maximum.reduceat(ratio, first[some])
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(evidence) @ self.curve, -30, 30)))


def design(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence])


def _grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of values by sorted distinct key."""
    key, back = np.unique(key, return_inverse=True)
    return key, *(np.bincount(back, v, len(key)) for v in values)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return values[np.searchsorted(keys, wanted)]


def _logs(c: np.ndarray, discount: float, n: np.ndarray, left: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log of (what the discount leaves of count c + what n's counts pass on, left, * lower) / n; log lower where nothing was counted."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.log((np.maximum(c - discount, 0) + left * lower) / n), np.log(lower))


def _passed(left: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of the share passed on; 0 where nothing was counted."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.log(left / n), 0.0)


class Spelling(NamedTuple):
    """Sorted byte runs with their log-probabilities by class, and contexts with the log of what they pass on by class."""

    run: np.ndarray
    toxic: np.ndarray
    ordinary: np.ndarray
    context: np.ndarray
    toxic_rest: np.ndarray
    ordinary_rest: np.ndarray


def spelling(run: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float) -> Spelling:
    """From counts of byte runs by class.

    ``lower`` is the probability of a run's last byte after the shorter contexts, built from one
    byte up; a run that begins at the word's start has no byte before it to count, so its plain count is used.
    """
    both = toxic + ordinary
    lower = np.full(len(run), 1 / 256)
    for order in range(1, ORDER):
        mask = np.uint64((1 << (8 * order)) - 1)
        longer = np.uint64((1 << (8 * (order + 1))) - 1)
        short, long = run & mask, run & longer
        at_start = (short >> np.uint64(8 * (order - 1))) == 0
        _, first = np.unique(long, return_index=True)
        by_type, kinds = np.unique(short[first], return_counts=True)
        by_run, plain = _grouped(short, both)
        c = np.where(at_start, _at(by_run, plain, short), _at(by_type, kinds, short)).astype(float)
        grams, one = np.unique(short, return_index=True)
        ctx, total, left = _grouped(grams >> BYTE, c[one], np.minimum(c[one], DISCOUNT))
        i = np.searchsorted(ctx, short >> BYTE)
        lower = (np.maximum(c - DISCOUNT, 0) + left[i] * lower) / total[i]
    ctx, nt, no, lt, lo = _grouped(run >> BYTE, toxic, ordinary, np.minimum(toxic, discount), np.minimum(ordinary, discount))
    i = np.searchsorted(ctx, run >> BYTE)
    return Spelling(run, _logs(toxic, discount, nt[i], lt[i], lower), _logs(ordinary, discount, no[i], lo[i], lower), ctx, _passed(lt, nt), _passed(lo, no))


class Counts(NamedTuple):
    """What one fit is made of: by class (toxic, ordinary), counts of byte runs; of words, with their bytes; of pairs above the discount; by history, of all pairs and of what they pass on."""

    run: np.ndarray
    runs: np.ndarray  # two columns, as all below
    word: np.ndarray
    words: np.ndarray
    total: np.ndarray  # of all words
    left: np.ndarray  # what all words pass on
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    pair: np.ndarray
    pair_history: np.ndarray
    pair_word: np.ndarray
    pairs: np.ndarray
    history: np.ndarray
    histories: np.ndarray
    histories_left: np.ndarray
    discounts: Discounts


def ratios(c: Counts) -> Model:
    """The models of both classes as ratios, without a curve."""
    if not c.total.all():
        return Model()
    d = c.discounts
    s = spelling(c.run, c.runs[:, 0], c.runs[:, 1], d.run)
    key, at = runs(c.data, c.starts, c.ends)
    i = np.searchsorted(s.run, key)
    alone = [np.exp(np.add.reduceat(p[i], at[:-1])) if len(i) else np.empty(0) for p in (s.toxic, s.ordinary)]
    # words and what is passed on below them
    by_class = [_logs(c.words[:, k], d.word, c.total[k], c.left[k], alone[k]) for k in (0, 1)]
    rest = float(np.log(c.left[0] / c.total[0]) - np.log(c.left[1] / c.total[1]))
    above = (c.words > d.word).any(axis=1)
    # pairs and what is passed on below them
    w, h = np.searchsorted(c.word, c.pair_word), np.searchsorted(c.history, c.pair_history)
    pair = [_logs(c.pairs[:, k], d.pair, c.histories[h, k], c.histories_left[h, k], np.exp(by_class[k][w])) for k in (0, 1)]
    passed = [_passed(c.histories_left[:, k], c.histories[:, k]) for k in (0, 1)]
    return Model(
        Table(s.run, s.toxic - s.ordinary), Table(s.context, s.toxic_rest - s.ordinary_rest), Table(c.word[above], (by_class[0] - by_class[1])[above]),
        Table(c.pair, pair[0] - pair[1]), Table(c.history, passed[0] - passed[1]), rest,
    )


def curve(evidence: np.ndarray, label: np.ndarray, weight: float = WEIGHT) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton steps; toxic rows count ``weight`` times, or as often as they are rarer."""
    x, y = design(evidence), label.astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.array([np.log(share / (1 - share)), 0.0, 0.0])
    times = np.where(y == 1, max(1.0, min(weight, (y == 0).sum() / y.sum())), 1.0)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (times * (y - p)) - ridge @ w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample_of(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic): at most about ``sample`` labelled ids, by a hash of the id; an id with several labels is toxic if one says so."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = one.count()
    if n <= sample:
        return one
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * sample / n))


FLAGS = ("t", "o", "kt", "ko")  # seen in toxic, ordinary texts outside the quarter kept back; in such texts within it


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of three words (as hashes) with the flags of the texts that hold them, once for a stretch of rows."""
    for b in batches:
        group = np.where(b.column(1).to_numpy() == 1, 0, 1) + 2 * b.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, h, first in words.pieces(b.column(0), plain=True):
            history = before(h, first)
            pair = words.paired(history, h)
            three = words.paired(before(history, first), pair)
            own = np.repeat(group[lo:hi], np.diff(first))
            three, one, back = np.unique(three, return_index=True, return_inverse=True)
            flags = [pa.array((np.bincount(back, own == g, len(three)) > 0).astype(np.int8)) for g in range(4)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (three, pair[one], history[one], h[one])), *flags], ["three", "pair", "h", "w", *FLAGS])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, bytes) of the words of a stretch of rows."""
    for b in batches:
        for _, _, data, starts, ends, h, _ in words.spelled(b.column(0), plain=True):
            names, one = np.unique(h, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array([data[starts[i] : ends[i]].tobytes() for i in one], pa.binary())], ["w", "bytes"])


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte runs of words with their counts."""
    for b in batches:
        if b.num_rows:
            data, starts, ends = _joined(b.column(0).to_pylist())
            key, at = runs(data, starts, ends)
            key, *n = _grouped(key, *(np.repeat(b.column(1 + i).to_numpy(), np.diff(at)) for i in range(4)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], ["run", *FLAGS])


def _joined(each: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in each], dtype=np.int64)
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends


FITS = (("t", "o"), ("at", "ao"))  # without the quarter kept back, and with it


def counted(rows: DataFrame, wanted: tuple[Discounts, ...] = DISCOUNTS) -> Callable[[int, Discounts], Counts]:
    """Counts from labelled texts (text, toxic, kept), as a function of the fit (0: of those not kept back, 1: of all) and of one of the discounts.

    Distinct runs of three words give the words before a pair, distinct pairs those before a word; everything is summed before it reaches the driver,
    as are byte runs. Pairs that all discounts take whole stay behind. Each table is read once, whatever is made of it.
    """
    each = lambda f, cols=FLAGS: [f(c).alias(c) for c in cols]
    four = ("t", "o", "at", "ao")
    three = rows.mapInArrow(_grams, "three long, pair long, h long, w long, t byte, o byte, kt byte, ko byte").groupBy("three", "pair", "h", "w").agg(*each(F.max))
    three = three.withColumns({"at": F.greatest("t", "kt"), "ao": F.greatest("o", "ko")})
    found = materialize(three.groupBy("pair", "h", "w").agg(*each(F.sum, four)), "toxicity-pairs")
    spelled = rows.mapInArrow(_spelled, "w long, bytes binary").groupBy("w").agg(F.min("bytes").alias("bytes"))
    by_word = found.groupBy("w").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in four])
    by_word = materialize(by_word.join(spelled, "w"), "toxicity-words")
    by_run = by_word.select("bytes", *four).mapInArrow(_runs_of, "run long, t long, o long, kt long, ko long").groupBy("run").agg(*each(F.sum))

    left = lambda c, d: F.sum(F.least(F.col(c).cast("double"), F.lit(d)))
    above = lambda d: (F.col("at") > d) | (F.col("ao") > d)
    least_word, least_pair = min(d.word for d in wanted), min(d.pair for d in wanted)
    pairs = found.where(above(least_pair))
    kept = {(c, d): f"{c}_{k}" for c in four for k, d in enumerate(sorted({d.pair for d in wanted}))}  # what a history passes on at each discount
    histories = found.groupBy("h").agg(*each(F.sum, four), *(left(c, d).alias(n) for (c, d), n in kept.items())).where((F.col("at_0") < F.col("at")) | (F.col("ao_0") < F.col("ao")))
    words_ = by_word.where(above(least_word)).unionByName(by_word.where(~above(least_word)).join(pairs.select("w").distinct(), "w", "left_semi"))
    sums = [(c, d) for c in four for d in sorted({d.word for d in wanted})]
    total = by_word.agg(*(F.coalesce(f, F.lit(0)).cast("double") for f in (*map(F.sum, four), *(left(c, d) for c, d in sums)))).first()
    total = dict(zip([*four, *sums], total, strict=True))
    by_run = by_run.withColumnsRenamed({"kt": "at", "ko": "ao"})
    tables = [(t := df.withColumns({c: F.col(c).cast("int") for c in four}).toArrow()).take(pa.array(np.argsort(_hashes(t, key)))) for df, key in ((words_, "w"), (by_run, "run"), (pairs, "pair"), (histories, "h"))]
    del t
    discard(found, by_word)

    def made(fit: int, d: Discounts) -> Counts:
        t, o = FITS[fit]
        counts = lambda got, *cols: np.column_stack([got[c].to_numpy() for c in cols]).astype(float)
        w, r, p, h = (got.filter(pa.array(counts(got, t, o).any(axis=1))) for got in tables)
        data, starts, ends = _joined(w["bytes"].to_pylist())
        return Counts(
            _hashes(r, "run"), counts(r, t, o), _hashes(w, "w"), counts(w, t, o), np.array([total[t], total[o]]), np.array([total[t, d.word], total[o, d.word]]), data, starts, ends,
            _hashes(p, "pair"), _hashes(p, "h"), _hashes(p, "w"), counts(p, t, o), _hashes(h, "h"), counts(h, t, o), counts(h, kept[t, d.pair], kept[o, d.pair]), d,
        )

    return made


def _hashes(table: pa.Table, column: str) -> np.ndarray:
    return np.ascontiguousarray(table[column].to_numpy()).view(np.uint64)


def loss(evidence: np.ndarray, label: np.ndarray, weights: np.ndarray, weight: float = WEIGHT) -> float:
    """The log-loss that ``curve`` makes small, a row."""
    z = np.where(label == 1, 1, -1) * np.clip(design(evidence) @ weights, -30, 30)
    return float((np.where(label == 1, weight, 1.0) * np.log1p(np.exp(-z))).sum() / max(1, len(label)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, discounts: tuple[Discounts, ...] = DISCOUNTS) -> Model:
    """Models and curve from labelled rows (doc_id, toxic). The sample bounds the broadcast of ids and all that reaches the driver."""
    bounded_batches(docs.sparkSession)
    ids = sample_of(labels, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("kept"))
    rows = materialize(rows.repartition(FILES), "toxicity-sample")  # else a file, and a task in each pass, follow every split of the documents
    best = None
    made = counted(rows, discounts)
    for d in discounts:  # one fit at a time is held
        sent = docs.sparkSession.sparkContext.broadcast(ratios(made(0, d)))

        def weigh(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                e = sent.value.evidence(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), b.column(1)], ["mean", "top", "toxic"])

        seen = rows.where("kept").select("text", "toxic").mapInArrow(weigh, "mean double, top double, toxic int").toArrow()
        sent.destroy()
        seen = seen.sort_by([("toxic", "ascending"), ("mean", "ascending"), ("top", "ascending")])  # in the same order in every run
        evidence, label = np.column_stack([seen["mean"].to_numpy(), seen["top"].to_numpy()]), seen["toxic"].to_numpy()
        weights = curve(evidence, label)
        now = loss(evidence, label, weights)
        if best is None or now < best[0]:
            best = now, d, weights
    discard(rows)
    return ratios(made(1, best[1]))._replace(curve=best[2])


def score(text: Column, model: Model) -> Column:
    """Score of a column of texts, from the text alone."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(sent.value.scores(sent.value.evidence(pa.array(s, pa.large_string(), from_pandas=True))))

    return run(text)


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, mod ``by``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(by))
