"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (case and punctuation aside). Runs of ``SEED`` words
found on both sides by Karp-Rabin hashes are the seeds; only pairs of a document and an item whose seeds can cover enough of the item go
on. Of such a pair the longest match of free words is marked, again and again, down to ``SEED`` words: the longest length is found by halving, with
running Karp-Rabin hashes of all free stretches of a length, and all matches of that length are marked in one walk, the first in the document first. The
share of the item's words that end up marked is its coverage; since tiles may lie in any order, reordered passages are caught too.

A seed counts once for a document and once for an item, however often it stands there, and no pairs of places are listed, so
texts of a few words over and over take time and memory by their length.

The benchmark goes to the executors as a sorted index of about ``BLOCK_WORDS`` words at most; a larger one goes in blocks, each a pass
over the documents whose result is stored before the next. Documents are not shuffled, so no source or passage can make a hot spot.

Edge cases: null or empty texts match nothing; items of fewer than ``SEED`` words have no seeds and are
never reported; repeated documents and items are reported each (items of one text are one text of the index, so
copies of an item neither fill a block nor are matched again); ids may be of any type, null ones too; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm import words
from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import materialize

SEED = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
FILTER_BITS = 20
HITS = 1_000_000  # hits of seeds looked at together, about


class Index:
    """One block of the benchmark: its words, and its seeds sorted by hash, each once for an item with the times it stands there."""

    def __init__(self, ids: list[list], texts: list[str], seed: int) -> None:
        self.ids, self.texts, self.seed = ids, range(len(texts)), seed  # ids: of all items with a text
        all_words, lengths, hashes, items = [], [np.zeros(0, np.int64)], [], []
        for lo, _, h, first in words.pieces(pa.array(texts, pa.large_string()), plain=True):
            start, row = _starts(first, seed)
            all_words.append(h)
            lengths.append(np.diff(first))
            hashes.append(words.window(words.running(h), start, start + seed))
            items.append(row + lo)
        self.lengths = np.concatenate(lengths)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.word = np.concatenate(all_words) if all_words else np.empty(0, np.uint64)
        key = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.concatenate(items).astype(np.int64) if items else np.empty(0, np.int64)
        self.key, self.item, self.times = _counted(key, item)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.key >> np.uint64(64 - FILTER_BITS)] = True

    def pairs(self, h: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, item, starts of shared seeds in the row) where the shared seeds may cover enough of the item."""
        start, row = _starts(first, self.seed)
        key = words.window(words.running(h), start, start + self.seed)
        near = np.flatnonzero(self.maybe[key >> np.uint64(64 - FILTER_BITS)])
        near = near[np.isin(key[near], self.key)]
        if not len(near):
            return
        near = near[np.lexsort((near, key[near], row[near]))]
        new = np.ones(len(near), bool)
        new[1:] = (key[near][1:] != key[near][:-1]) | (row[near][1:] != row[near][:-1])
        one = np.flatnonzero(new)  # each seed of a row once
        end = np.append(one[1:], len(near))
        lo, hi = (np.searchsorted(self.key, key[near[one]], side) for side in ("left", "right"))
        n, of_row = hi - lo, row[near[one]]
        upto = np.cumsum(n)
        at = 0
        while at < len(one):
            # whole rows, of about HITS hits together
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HITS)), at + 1)
            to = int(np.searchsorted(of_row, of_row[to - 1], "right"))
            m = n[at:to]
            seed = np.repeat(np.arange(at, to), m)
            posting = np.arange(m.sum()) + np.repeat(lo[at:to] - (np.cumsum(m) - m), m)
            item = self.item[posting]
            order = np.lexsort((item, of_row[seed]))
            seed, item, times = seed[order], item[order], self.times[posting[order]]
            cut = np.flatnonzero((np.diff(of_row[seed]) != 0) | (np.diff(item) != 0)) + 1
            begin = np.concatenate(([0], cut))
            most = np.add.reduceat(times, begin) * self.seed  # no tiling covers more
            for i in np.flatnonzero(most >= coverage * self.lengths[item[begin]]).tolist():
                own = seed[begin[i] : begin[i + 1] if i + 1 < len(begin) else len(seed)]
                size = end[own] - one[own]
                places = near[np.arange(size.sum()) + np.repeat(one[own] - (np.cumsum(size) - size), size)]
                yield int(of_row[own[0]]), int(item[begin[i]]), np.sort(start[places])
            at = to


def _counted(key: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of key, then item, and how often each stands."""
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
    one = np.flatnonzero(new)
    return key[one], item[one], np.diff(np.append(one, len(key)))


def _starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of k words within a row begin, and their rows."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    at = np.concatenate(([0], np.cumsum(count)))
    return np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count), np.repeat(np.arange(len(count)), count)


class _Side:
    """A word sequence with free and marked words."""

    def __init__(self, word: np.ndarray, free: np.ndarray) -> None:
        self.sums, self.free = words.running(word), free
        self.refresh()

    def refresh(self) -> None:
        self.busy = np.concatenate(([0], np.cumsum(~self.free)))
        edge = np.flatnonzero(~self.free)
        self.longest = int(np.diff(np.concatenate(([-1], edge, [len(self.free)]))).max()) - 1

    def stretches(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all stretches of n free words."""
        start = np.flatnonzero(self.busy[n:] == self.busy[:-n])
        return start, words.window(self.sums, start, start + n)


def tiles(doc: np.ndarray, item: np.ndarray, seed: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in document, place in item) of two word sequences; ``free``: the document's words that may match."""
    d, t = _Side(doc, np.ones(len(doc), bool) if free is None else free.copy()), _Side(item, np.ones(len(item), bool))
    out = []
    top = min(d.longest, t.longest)
    while top >= seed:
        low, high, best = seed, top, 0
        while low <= high:  # a common stretch of n words holds one of n - 1
            n = (low + high) // 2
            if np.isin(d.stretches(n)[1], t.stretches(n)[1]).any():
                low, best = n + 1, n
            else:
                high = n - 1
        if not best:
            break
        (a, ha), (b, hb) = d.stretches(best), t.stretches(best)
        keep = np.isin(ha, hb)
        a, ha = a[keep], ha[keep]
        order = np.argsort(hb, kind="stable")
        b, hb = b[order], hb[order]
        lo, hi = np.searchsorted(hb, ha, "left").tolist(), np.searchsorted(hb, ha, "right").tolist()
        ahead: dict[int, int] = {}  # places in the item that are taken stay so
        done = 0
        for x, i, end in zip(a.tolist(), lo, hi, strict=True):
            if x < done:
                continue
            j = ahead.get(i, i)
            while j < end and not (t.free[b[j]] and t.free[b[j] + best - 1]):
                j += 1
            ahead[i] = j
            if j < end:
                out.append((best, x, int(b[j])))
                done = x + best
                d.free[x:done] = False
                t.free[b[j] : b[j] + best] = False
        d.refresh()
        t.refresh()
        top = min(best - 1, d.longest, t.longest)
    return out


def contaminated(texts: pa.Array, index: Index, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, words matched, tiles) of the pairs that reach ``coverage``."""
    for lo, _, h, first in words.pieces(texts, plain=True):
        for row, item, start in index.pairs(h, first, coverage):
            # only words under a shared seed can match
            under = np.zeros(int(start[-1] - start[0]) + index.seed + 1, np.int64)
            np.add.at(under, start - start[0], 1)
            np.add.at(under, start - start[0] + index.seed, -1)
            free = np.cumsum(under[:-1]) > 0
            size = int(index.lengths[item])
            found = tiles(h[start[0] : start[-1] + index.seed], index.word[index.first[item] : index.first[item + 1]], index.seed, free)
            n = sum(t[0] for t in found)
            if n >= coverage * size:
                yield lo + row, item, n / size, n, len(found)


def _texts(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each text of the benchmark once, with the ids of its items (as structs, so null ids stay)."""
    return benchmark.groupBy(F.coalesce(text_col, F.lit("")).alias("text")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"))).alias("ids"))


def _blocks(benchmark: DataFrame, text_col: str) -> int:
    total = benchmark.select(text_col).distinct().agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n")).first().n
    return -(-total // (6 * BLOCK_WORDS))


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, seed: int, blocks: int) -> Iterator[Index]:
    """Blocks of the benchmark's different texts, of about ``BLOCK_WORDS`` words."""
    rows = _texts(benchmark, id_col, text_col)
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()
        yield Index([[x.id for x in r.ids] for r in part], [r.text for r in part], seed)


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, tiles) for every document and item with at least ``coverage``."""
    bounded_batches(docs.sparkSession)
    kind, item_type = dict(benchmark.dtypes)[item_col], to_arrow_type(benchmark.schema[item_col].dataType)
    own = dict(docs.dtypes)[id_col]
    schema = T._parse_datatype_string(f"doc_id {own}, item_id {kind}, coverage double, matched_words long, tiles int")
    out = None
    blocks = _blocks(benchmark, "text")
    for index in _indexes(benchmark, item_col, "text", seed, blocks):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(contaminated(b.column(1), sent.value, coverage))
                if rows:
                    r, i, c, n, t = zip(*rows, strict=True)
                    each = pa.array(np.repeat(np.arange(len(rows)), [len(sent.value.ids[x]) for x in i]))  # a row for each item with the text
                    item = pa.array([x for k in i for x in sent.value.ids[k]], item_type)
                    found = [pa.array(x, kind).take(each) for x, kind in ((r, pa.int64()), (c, pa.float64()), (n, pa.int64()), (t, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(found[0]), item, *found[1:]], ["doc_id", "item_id", "coverage", "matched_words", "tiles"])

        part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
        if blocks > 1:
            part = materialize(part, "tiling")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the documents that cover an item."""
    bounded_batches(docs.sparkSession)
    blocks = _blocks(benchmark, "text")
    if blocks > 1:  # by text, as equal texts are judged alike
        found = find(docs.withColumn("_text_sha2", F.sha2(text_col, 256)), benchmark, coverage, seed, "_text_sha2", text_col, item_col)
        found = materialize(found.select(F.col("doc_id").alias("_text_sha2")).distinct(), "tiling")
        return docs.withColumn("_text_sha2", F.sha2(text_col, 256)).join(found, "_text_sha2", "left_anti").select(*docs.columns)
    for index in _indexes(benchmark, item_col, "text", seed, blocks):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stay = np.ones(b.num_rows, bool)
                for row, *_ in contaminated(b.column(b.schema.get_field_index(text_col)), sent.value, coverage):
                    stay[row] = False
                yield b.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
