"""Katz backoff bigram model of a corpus, trained and evaluated in one pass over its pairs (``katz_tables`` has any order, in stored tables).

P(w | h) = d_r * r / c(h) for a pair seen r times in training, else alpha(h) * P(w); P(w) likewise backs off from counts to one
unknown word. d_r are Good-Turing discounts for r up to ``TOP`` and ``BIG`` above, and alpha(h) makes the probabilities after h
sum to exactly one: alpha(h) = (1 - sum of d_r r / c(h)) / (1 - sum of P(w)), both sums over the words seen after h. A history
never seen has alpha 1.

How it runs. A task turns its texts into (previous word, word) pairs and deals them in compact blocks to buckets by word: all of a word's
occurrences, training or not, meet in one bucket (a block names no more documents than it has pairs), which so holds exact counts c(w) and r and adds up each document's share of the
score. Buckets pass on, by history, what alpha(h) needs, and which documents need alpha(h). Discounts are
a few constants found from counts of counts over all buckets; everything is arranged so that they are applied last. The n-gram tables are
these buckets: they are partitioned by word, then by history, and never whole in one place.

A word or pair that fills a good part of a bucket (an eighth, so the share falls as buckets get more) would make it hot. Such words and pairs are guessed from a
sample (a thousandth of the documents, ``SAMPLE`` at least) and counted exactly in a pass of their own; pairs among them are scored where they are read, and other pairs of
such words are dealt by pair. The guess shifts work only, never a result. There are at most 8 such words and 8 such pairs for each bucket.

Words and pairs are named by 64-bit hashes. Edge cases: null or empty texts are one end token; null ids are not held out; no training
documents give a model of the unknown word alone; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm import words
from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

TOP = 5  # counts up to this are discounted by Good-Turing
BIG = 0.995  # the discount above, so that every history keeps something for unseen words
START, END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)
FLUSH = 1_000_000  # tokens in a batch
BUCKET = 3_000_000  # tokens in a bucket, about
LEAST_BUCKETS = 12
SAMPLE, SAMPLED = 20_000, 1e-3  # documents from which hot words and pairs are guessed: so many, or this share if that is more
HOT_WORD, HOT_PAIR, HOT_LEAST = 1e-3, 2e-4, 200  # share of the sample's tokens (or that of an eighth of a bucket, if less); at least so many there

PAIR, DEALT, LOCAL, HISTORY, REQUEST, STATS, ROWS, ANSWER = range(8)
SCHEMA = "kind int, key long, part int, block binary"
CLASSES = TOP + 2  # 0, 1..TOP, above


def home_of(batch: int, buckets: int) -> int:
    """The part that gathers a batch of documents."""
    return ((batch ^ (batch >> 29)) * 2654435761 >> 7) % buckets


class Hot(NamedTuple):
    """Hot words and pairs with their counts in training texts."""

    word: np.ndarray
    word_count: np.ndarray
    pair: np.ndarray
    pair_count: np.ndarray
    pair_history: np.ndarray
    pair_word_count: np.ndarray


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are among the sorted keys, and their places there (anything where not)."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[i] == x, i


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words with each text's end, the word before each, first token of each row)."""
    for lo, hi, h, first in words.pieces(texts):
        n = hi - lo
        at = first + np.arange(n + 1)
        w = np.full(len(h) + n, END, np.uint64)
        inner = np.ones(len(w), bool)
        inner[at[1:] - 1] = False
        w[inner] = h
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[at[:-1]] = START
        yield lo, hi, w, before, at


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its type and length."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


def unpack(block: pa.Scalar) -> list[np.ndarray]:
    data = block.as_buffer()
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * n)[1:]
    out, at = [], 8 * (1 + 2 * n)
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        out.append(np.frombuffer(data, chr(kind), size, at))
        at += out[-1].nbytes
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def batch_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, key, part, block = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(part, pa.int32()), pa.array(block, pa.binary())], ["kind", "key", "part", "block"])


class Shares:
    """Each document's part of its sums: what ``LOCAL`` blocks hold.

    base: sum of log10(c + 1); katz: sum of log10 r over seen pairs, of log10 c(w) over unseen pairs of frequent words, less log10 c over words as
    histories; known: words with c > 0; seen and unseen: pairs by class of r, and of c(w).
    """

    def __init__(self, docs: int) -> None:
        self.docs = docs
        self.base, self.katz = np.zeros(docs), np.zeros(docs)
        self.known = np.zeros(docs, np.int64)
        self.seen, self.unseen = np.zeros((docs, CLASSES), np.int64), np.zeros((docs, CLASSES), np.int64)

    def add(self, d: np.ndarray, end: np.ndarray, c: np.ndarray, r: np.ndarray) -> None:
        """Occurrences: document, whether the word is the end, counts of word and pair."""
        n = self.docs
        self.base += np.bincount(d, np.log10(c + 1), n)
        self.known += np.bincount(d, c > 0, n).astype(np.int64)
        yes = r > 0
        value = np.where(yes, np.log10(np.maximum(r, 1)), np.where(c > TOP, np.log10(np.maximum(c, 1)), 0.0))
        value -= np.where(end, 0.0, np.log10(np.maximum(c, 1)))
        self.katz += np.bincount(d, value, n)
        for into, which, count in ((self.seen, yes, r), (self.unseen, ~yes, c)):
            into += np.bincount(d[which] * CLASSES + np.minimum(count[which], TOP + 1), minlength=n * CLASSES).reshape(n, CLASSES)

    def block(self, row_of: np.ndarray | None = None) -> bytes:
        """Those of documents that have any; ``row_of``: their rows in the batch, if not all of it is here."""
        rows = np.flatnonzero(self.seen.sum(1) + self.unseen.sum(1))
        counts = [small(np.ascontiguousarray(m[rows, i])) for m in (self.seen, self.unseen) for i in range(CLASSES)]
        return pack(small(rows if row_of is None else row_of[rows]), self.base[rows], self.katz[rows], small(self.known[rows]), *counts)


def deal(docs: DataFrame, held_out: Column, hot: Hot, buckets: int) -> DataFrame:
    """Blocks of pairs by bucket (``DEALT``), of hot pairs' shares (``LOCAL``) and of the documents themselves (``ROWS``) by batch."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def flush(batch: int, ids: list, held: np.ndarray, parts: list) -> Iterator[tuple[int, int, int, bytes]]:
        w, before, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
        parts.clear()
        hot = sent.value
        n = len(held)
        home = home_of(batch, buckets)
        null = np.array([i is None for i in ids])
        yield ROWS, batch, home, pack(np.array([0 if i is None else i for i in ids], np.int64), null, held, np.bincount(d, minlength=n))
        pair = words.paired(before, w)
        is_hot, at = find(hot.pair, pair)
        if is_hot.any():
            own = Shares(n)
            own.add(d[is_hot], w[is_hot] == END, hot.pair_word_count[at[is_hot]], hot.pair_count[at[is_hot]])
            yield LOCAL, batch, home, own.block()
            w, before, d, pair = w[~is_hot], before[~is_hot], d[~is_hot], pair[~is_hot]
        by = np.where(find(hot.word, w)[0], pair, w)
        del pair
        order = np.argsort(by)
        w, before, d, by = w[order], before[order], d[order], by[order]
        del order
        by >>= np.uint64(32)
        by *= np.uint64(buckets)
        by >>= np.uint64(32)
        cuts = np.searchsorted(by, np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            names, back = np.unique(np.concatenate((w[own], before[own])), return_inverse=True)
            wi, hi = back[: cuts[b + 1] - cuts[b]], back[cuts[b + 1] - cuts[b] :]
            o = np.argsort(wi * len(names) + hi)
            own = d[own][o]
            rows, at = np.unique(own, return_inverse=True)
            if 2 * len(rows) > n:  # most documents of the batch: by their rows there, none is named
                rows, at, flags = rows[:0], own, held
            else:
                flags = held[rows]
            yield DEALT, batch, b, pack(names, small(np.bincount(wi, minlength=len(names))), small(hi[o]), small(at), small(rows), np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, parts, size = [], [], [], 0
        for b in batches:
            names, flags = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, w, before, at in tokens(b.column(1)):
                parts.append((w, before, np.repeat(np.arange(len(ids), len(ids) + hi - lo, dtype=np.int32), np.diff(at))))
                ids += names[lo:hi]
                held.append(flags[lo:hi])
                size += len(w)
                if size >= FLUSH:
                    for row in flush(number, ids, np.concatenate(held), parts):
                        yield batch_of([row])
                    ids, held, parts, size, number = [], [], [], 0, number + 1
        if ids:
            for row in flush(number, ids, np.concatenate(held), parts):
                yield batch_of([row])

    return docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held")).mapInArrow(run, SCHEMA)


def score_bucket(blocks: list[tuple[int, list[np.ndarray]]], hot: Hot, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """All that follows from one bucket's pairs."""
    w, before, doc, held, row_of, start = [], [], [], [], [], [0]
    batches = [b for b, _ in blocks]
    for _, (names, count, hi, d, rows, bits) in blocks:
        w.append(np.repeat(names, count))
        before.append(names[hi])
        doc.append(d.astype(np.int32) + np.int32(start[-1]))
        flags = np.unpackbits(bits, count=len(rows) or None).astype(bool)
        held.append(flags)
        row_of.append(rows.astype(np.int32) if len(rows) else np.arange(len(flags), dtype=np.int32))
        start.append(start[-1] + len(flags))
    blocks.clear()
    w, before, doc, held, row_of = np.concatenate(w), np.concatenate(before), np.concatenate(doc), np.concatenate(held), np.concatenate(row_of)
    train = ~held[doc]
    names, which = np.unique(w, return_inverse=True)
    c_of = np.bincount(which[train], minlength=len(names))
    is_hot, at = find(hot.word, names)
    c_of[is_hot] = hot.word_count[at[is_hot]]
    own = c_of[~is_hot]
    which, end, pair = which.astype(np.int32), w == END, words.paired(before, w)
    del w
    _, one, by_pair = np.unique(pair, return_index=True, return_inverse=True)
    del pair
    r_of = np.bincount(by_pair[train], minlength=len(one))
    r = r_of[by_pair]
    del by_pair, train
    c = c_of[which]
    del which

    # counts of counts: words (hot ones are counted elsewhere), pairs; words known
    tally = lambda x: np.bincount(np.minimum(x[x > 0], TOP + 2), minlength=TOP + 3)
    yield STATS, 0, 0, pack(tally(own), tally(r_of), np.array([(own > 0).sum()]))

    for i, batch in enumerate(batches):
        a, b = np.searchsorted(doc, (start[i], start[i + 1]))
        shares = Shares(start[i + 1] - start[i])
        shares.add(doc[a:b].astype(np.int64) - start[i], end[a:b], c[a:b], r[a:b])
        yield LOCAL, batch, home_of(batch, buckets), shares.block(row_of[start[i] : start[i + 1]])

    # by history: pairs by class of r, the sum of larger r, words by class of c, the sum of larger c
    seen = np.flatnonzero(r_of > 0)
    h, rs, cs = before[one[seen]], r_of[seen], c[one[seen]]
    del c, end, seen, one, r_of
    yield from histories(h, rs, cs, buckets)

    need = np.flatnonzero(r == 0)
    part = ((before[need] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.lexsort((doc[need], part))
    need, part = need[order], part[order]
    cuts = np.searchsorted(part, np.arange(buckets + 1, dtype=np.uint64))
    first = np.array(start)
    batches = np.array(batches, np.int64)
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        x = need[cuts[p] : cuts[p + 1]]
        source = np.searchsorted(first, doc[x], "right") - 1
        yield REQUEST, 0, p, pack(before[x], batches[np.unique(source)], small(np.bincount(source, minlength=len(batches))[np.unique(source)]), small(row_of[doc[x]]))


def histories(h: np.ndarray, r: np.ndarray, c: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``HISTORY`` blocks of seen pairs (history, r, c of the word), by the history's part."""
    order = np.argsort(h)
    h, r, c = h[order], r[order], c[order]
    del order
    lowest = ((np.arange(buckets, dtype=np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets) << np.uint64(32)  # hash of each part
    cuts = np.append(np.searchsorted(h, lowest), len(h))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[p], cuts[p + 1])
        names, back = np.unique(h[own], return_inverse=True)
        columns = []
        for x in (r[own], c[own]):
            columns += [np.bincount(back[x == k], minlength=len(names)) for k in range(1, TOP + 1)]
            columns.append(np.bincount(back, np.where(x > TOP, x, 0), len(names)).astype(np.int64))
        yield HISTORY, 0, p, pack(names, *map(small, columns))


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts d_1..d_TOP from counts of counts n[r]; where Good-Turing gives none between 0 and 1 (too little data), 1 - 1/(2r)."""
    d = np.array([1 - 0.5 / r for r in range(1, TOP + 1)])
    if n[1] > 0:
        a = (TOP + 1) * n[TOP + 1] / n[1]
        for r in range(1, TOP + 1):
            if n[r] > 0 and a < 1:
                x = ((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a)
                if 0.01 < x < 0.999:
                    d[r - 1] = x
    return d


class Constants(NamedTuple):
    total: int  # training tokens
    kinds: int  # different training tokens
    docs: int  # training documents
    pair: np.ndarray  # discounts of pairs
    word: np.ndarray  # discounts of words
    unknown: float  # probability of the unknown word

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) by count."""
        d = np.concatenate(([0.0], self.word, [BIG]))
        return np.where(c > 0, d[np.minimum(c, TOP + 1)] * c / max(self.total, 1), self.unknown)


def constants(words_n: np.ndarray, words_big: int, pairs_n: np.ndarray, kinds: int, docs: int) -> Constants:
    """From counts of counts, the tokens of words above TOP, and numbers of different words and of documents."""
    r = np.arange(1, TOP + 1)
    total = int((words_n[1 : TOP + 1] * r).sum() + words_big)
    d = good_turing(words_n)
    left = ((1 - d) * r * words_n[1 : TOP + 1]).sum() + (1 - BIG) * words_big
    return Constants(total, kinds, docs, good_turing(pairs_n), d, float(left / total) if total else 1.0)


def answer(stats: list[list[np.ndarray]], requests: list[list[np.ndarray]], k: Constants, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """log10 of c(h) * alpha(h) for the documents that ask, summed by document."""
    if not requests or not stats:
        return
    names, back = np.unique(np.concatenate([s[0] for s in stats]), return_inverse=True)
    column = lambda i: np.bincount(back, np.concatenate([s[i] for s in stats]).astype(float), len(names))
    free, taken = np.zeros(len(names)), np.zeros(len(names))
    for i in range(TOP):
        free += (1 - k.pair[i]) * (i + 1) * column(1 + i)
        taken += k.word[i] * (i + 1) * column(TOP + 2 + i)
    free += (1 - BIG) * column(TOP + 1)
    taken += BIG * column(2 * TOP + 2)
    value = np.log10(free) - np.log10(1 - taken / k.total)
    for h, batches, sizes, d in requests:
        known, at = find(names, h)
        sums = np.where(known, value[at], 0.0)
        ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        for i, b in enumerate(batches.tolist()):
            own = slice(ends[i], ends[i + 1])
            rows, where = np.unique(d[own], return_inverse=True)
            yield ANSWER, b, home_of(b, buckets), pack(rows, np.bincount(where, sums[own], len(rows)))


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple[int, int, list[np.ndarray]]]]:
    """Runs of rows of equal column ``by`` as (kind, key, arrays)."""
    groups, at = [[]], None  # the last one is taken out of the list, so only its reader holds it
    for b in batches:
        for x, kind, key, block in zip(b.column(by).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if groups[0] and x != at:
                yield groups.pop()
                groups.append([])
            at = x
            groups[0].append((kind, key, [a.copy() for a in unpack(block)]))
    if groups[0]:
        yield groups.pop()


def _hot(docs: DataFrame, training: Column) -> tuple[Hot, int, int]:
    """Hot words and pairs with exact counts, guessed from a sample; training documents; tokens of all."""
    n = docs.count()
    share = min(1.0, max(SAMPLE / max(n, 1), SAMPLED))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * share)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w, before, _ in tokens(b.column(0)):
                pair = words.paired(before, w)
                keys, one, count = np.unique(pair, return_index=True, return_counts=True)
                few = count >= 2  # a hot pair stands several times in most stretches of this size
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys[few], w[one[few]], before[one[few]])] + [pa.array(count[few]), pa.array([len(w)] * int(few.sum()), pa.int64())], ["pair", "w", "h", "n", "tokens"])

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t[2]) for t in tokens(b.column(0)))], pa.int64())], ["n"])

    sample = docs.where(part).select("text")
    size = sample.mapInArrow(count_tokens, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    of_bucket = BUCKET / 8 / max(size / share, 1)
    hot_word, hot_pair = min(HOT_WORD, of_bucket), min(HOT_PAIR, of_bucket)
    seen = sample.mapInArrow(guess, "pair long, w long, h long, n long, tokens long").groupBy("pair", "w", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, hot_pair * size))
    found = seen.orderBy(F.desc("n"), "pair").limit(int(1 / hot_pair)).toArrow()
    pair, w, h = (found[c].to_numpy().view(np.uint64) for c in ("pair", "w", "h"))
    by_word = sample.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, hot_word * size))
    hot_words = np.union1d(by_word.orderBy(F.desc("n"), "w").limit(int(1 / hot_word)).toArrow()["w"].to_numpy().view(np.uint64), w)
    order = np.argsort(pair)
    pair, w, h = pair[order], w[order], h[order]

    # exact counts over all training documents; the last row holds their number and tokens of all documents
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = b.column(1).to_numpy(zero_copy_only=False)
            nw, np_, tokens_ = np.zeros(len(hot_words), np.int64), np.zeros(len(pair), np.int64), 0
            for lo, hi, x, before, at in tokens(b.column(0)):
                tokens_ += len(x)
                keep = np.repeat(flags[lo:hi], np.diff(at))
                x, before = x[keep], before[keep]
                yes, i = find(hot_words, x)
                nw += np.bincount(i[yes], minlength=len(hot_words))
                if len(pair):
                    yes, i = find(pair, words.paired(before[yes], x[yes]))
                    np_ += np.bincount(i[yes], minlength=len(pair))
            n = np.concatenate((nw, np_, [flags.sum(), tokens_]))
            keep = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(n[keep])], ["i", "n"])

    rows = docs.select("text", training.alias("t")).mapInArrow(exact, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(hot_words) + len(pair) + 2, np.int64)
    n[rows["i"].to_numpy()] = rows["n"].to_numpy()
    nw, np_ = n[: len(hot_words)], n[len(hot_words) : -2]
    keep = nw > TOP + 1
    hot_words, nw = hot_words[keep], nw[keep]
    ok, at = find(hot_words, w)
    ok &= np_ > TOP + 1
    return Hot(hot_words, nw, pair[ok], np_[ok], h[ok], nw[at[ok]]), int(n[-2]), int(n[-1])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, w, _, _ in tokens(b.column(0)):
            names, n = np.unique(w, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[n > 1].view(np.int64)), pa.array(n[n > 1])], ["w", "n"])


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_backoff long, novelty double"


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_backoff, novelty) of every document; training is on those not held out.

    n_backoff: tokens whose pair training lacks. novelty: share of tokens whose pair no other occurrence in training vouches for; a
    training document's own occurrence is not counted, so a text that stands there twice has 0, and one of unseen pairs 1.

    ``docs`` (doc_id, text) is read three times and a sample of it twice: it should be a stored table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = F.coalesce(held_out, F.lit(False))
    hot, train_docs, size = _hot(docs, ~held_out)
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    sent = spark.sparkContext.broadcast(hot)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2):
            rest = [r for r in rows if r[0] != DEALT]
            if rest:
                yield batch_of([(kind, key, home_of(key, buckets), pack(*arrays)) for kind, key, arrays in rest])
            dealt = [(key, arrays) for kind, key, arrays in rows if kind == DEALT]
            del rows
            if dealt:
                for row in score_bucket(dealt, sent.value, buckets):
                    yield batch_of([row])

    met = deal(docs, held_out, hot, buckets).repartitionById(buckets, "part").sortWithinPartitions("part").mapInArrow(meet, SCHEMA)
    met = materialize(met, "katz-buckets")

    words_n, pairs_n, kinds = _tallies(met)
    train_tokens = _train_tokens(met)
    kinds += len(hot.word)
    in_classes = int((words_n[1 : TOP + 1] * np.arange(1, TOP + 1)).sum())
    k = constants(words_n, train_tokens - in_classes, pairs_n, kinds, train_docs)
    hot_rows = list(histories(hot.pair_history, hot.pair_count, hot.pair_word_count, buckets))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2):
            found = list(answer([a for kind, _, a in rows if kind == HISTORY], [a for kind, _, a in rows if kind == REQUEST], k, buckets))
            if found:
                yield batch_of(found)

    asked = met.where(F.col("kind").isin(HISTORY, REQUEST))
    if hot_rows:
        asked = asked.unionByName(spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in hot_rows], SCHEMA))
    answers = asked.repartitionById(buckets, "part").sortWithinPartitions("part").mapInArrow(ask, SCHEMA)
    home = met.where(F.col("kind").isin(LOCAL, ROWS)).unionByName(answers)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            yield _final(rows, k)

    out = materialize(home.repartitionById(buckets, "part").sortWithinPartitions("part", "key").mapInArrow(finish, OUT), "katz-scores")
    discard(met)
    return out


def _tallies(met: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of counts of words and of pairs, and the number of different words, summed over the buckets by the tasks."""
    width = TOP + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width + 1, np.int64)
        for b in batches:
            for block in b.column(0):
                total += np.concatenate(unpack(block))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "n"])

    rows = met.where(F.col("kind") == STATS).select("block").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(2 * width + 1, np.int64)
    n[rows["i"].to_numpy()] = rows["n"].to_numpy()
    return n[:width], n[width : 2 * width], int(n[-1])


def _train_tokens(met: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for block in b.column(0):
                _, _, held, size = unpack(block)
                n += int(size[~held].sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return met.where(F.col("kind") == ROWS).select("block").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def _final(rows: list[tuple[int, int, list[np.ndarray]]], k: Constants) -> pa.RecordBatch:
    """Scores of one batch of documents."""
    ids, null, held, size = next(a for kind, _, a in rows if kind == ROWS)
    n = len(ids)
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    unseen, once = np.zeros(n, np.int64), np.zeros(n, np.int64)
    d_pair = np.log10(np.concatenate(([1.0], k.pair, [BIG])))
    # an unseen pair's word: its whole log-probability, or (frequent words) what its count leaves open
    lower = np.log10(np.concatenate(([k.unknown], k.word * np.arange(1, TOP + 1) / max(k.total, 1), [BIG / max(k.total, 1)])))
    for kind, _, a in rows:
        if kind == LOCAL:
            at = a[0]
            base[at] += a[1]
            score[at] += a[2] + np.column_stack(a[4 : 4 + CLASSES]) @ d_pair + np.column_stack(a[4 + CLASSES :]) @ lower
            known[at] += a[3].astype(np.int64)
            unseen[at] += sum(x.astype(np.int64) for x in a[4 + CLASSES :])
            once[at] += a[5]
        elif kind == ANSWER:
            score[a[0]] += a[1]
    base -= size * np.log10(k.total + k.kinds + 1)
    if k.docs:
        score -= np.log10(k.docs)  # the first word's history
    novelty = (unseen + np.where(held, 0, once)) / size
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, mask=null), pa.array(held), pa.array(size), pa.array(known), pa.array(np.full(n, k.total, np.int64)), pa.array(base), pa.array(score), pa.array(unseen), pa.array(novelty)],
        [c.split()[0] for c in OUT.split(", ")],
    )
