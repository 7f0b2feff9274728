"""Alignment of two tokenizers by merge-path partitioning.

A text is encoded twice: by a byte-level BPE (A), which gets a space and the text, and by a SentencePiece model (B), which adds that space
itself. Token ends, as byte offsets, are two rising sequences. The texts of a batch are laid one after another, so both sequences rise over the whole
batch, and their merge is cut into pieces of equal work: a binary search on each diagonal says how many ends of A and of B lie before
it (ends of A first where equal). Each piece merges its own ends and emits overlaps: (A token, B token, first byte, end byte), an A and a B token that share
those bytes. Where an end of A closes one piece and the same end of B opens a later one, they are stitched. Offsets at which both end cut the tokens into
groups. A long document is so merged in as many pieces as it needs, a short one shares a piece.

Corpus counts: links (an A and a B token that end together) are kept as packed id pairs beside their document, in a table written once, so texts are
encoded once. Each task adds up its own pairs before they are shuffled by pair. Documents are scored from the counts: up to ``SENT_PAIRS`` pairs go to
all tasks (12 bytes each and 8 for each B id); beyond, distinct (document, pair) rows meet the counts by a shuffle.

The tokenizers' files are read by the driver and sent to the tasks (a few MB). The byte-level BPE runs on tiktoken, with ids as ranks: its JSON file lists merges in
the order of their ids, which is checked; special tokens are not taken from it, so their strings in a text are ordinary text.

Edge cases: null and empty texts, and texts whose joined A or B bytes differ from the space and the text (such as texts with U+2581), have no tokens: zeros and ''.
Rows are scored each, whatever their ids, null and repeated ones too; repeated rows count as often as they stand there. Empty tables give no rows. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level BPE cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 16  # ends merged in a piece
BATCH_BYTES = 1 << 19  # of text encoded and merged together, about
PAIR_BITS = 32
HELD_PAIRS = 1 << 21  # distinct pairs that a task adds up before it sends them
SENT_PAIRS = 4_000_000


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """The two tokenizers, from the bytes of their files; opened where first used."""

    byte_bpe: bytes
    piece_bpe: bytes

    def __getstate__(self) -> tuple[bytes, bytes]:
        return self.byte_bpe, self.piece_bpe

    def __setstate__(self, files: tuple[bytes, bytes]) -> None:
        self.byte_bpe, self.piece_bpe = files

    @cached_property
    def _ranks(self) -> dict[bytes, int]:
        of, spec = _byte_of(), json.loads(self.byte_bpe)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if [spec["model"]["vocab"][m] for m in merges] != list(range(len(ranks) - len(merges), len(ranks))):
            raise ValueError("ids do not follow the order of merges")
        return ranks

    @cached_property
    def a(self):
        import tiktoken

        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=self._ranks, special_tokens={})

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.piece_bpe)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        out = [b""] * (max(self._ranks.values()) + 1)
        for token, i in self._ranks.items():
            out[i] = token
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        ids = range(self.b.get_piece_size())
        return [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(self.b.id_to_piece, ids), strict=True)]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids by A and by B of each text; none where bytes do not come back."""
        some = [i for i, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for i, b in zip(some, self.b.encode([texts[i] for i in some], num_threads=1) if some else (), strict=True):
            whole = " " + texts[i]
            a = self.a.encode_ordinary(whole)
            want = whole.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want:
                out[i] = (a, b)
        return out


def tokenizers(folder: str = TOKENIZERS, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Tokenizers:
    with open(f"{folder}/{byte_bpe}", "rb") as a, open(f"{folder}/{piece_bpe}", "rb") as b:
        return Tokenizers(a.read(), b.read())


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the merge of two rising sequences into pieces of at most ``piece`` ends: how many of a and of b lie before each (of a first where equal)."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        i, j = mid[open_], (d - 1 - mid)[open_]
        more = np.zeros(len(d), bool)
        more[open_] = a[i] <= b[j]
        low, high = np.where(open_ & more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, d - low


def merged(a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece: (end, A token, B token, whether both end there) of its overlaps; a and b: the piece's ends, a0 and b0: how many lie before."""
    end = np.concatenate((a, b))
    order = np.argsort(end, kind="stable")  # two rising runs: one merge, ends of a first
    end, of_a = end[order], np.cumsum(order < len(a))
    last = np.flatnonzero(np.append(end[1:] != end[:-1], len(end) > 0)[: len(end)])
    before = np.concatenate(([-1], last[:-1]))
    i = np.concatenate(([0], of_a[last[:-1]])) if len(last) else last  # ends of a before each end
    return end[last], a0 + i, b0 + before + 1 - i, last - before == 2


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of two token sequences by their ends, pieces stitched: (end, A token, B token, whether both end there)."""
    i, j = diagonals(a, b, piece)
    parts = [merged(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k]) for k in range(len(i) - 1)]
    if not parts:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool))
    end, at, bt, both = (np.concatenate(x) for x in zip(*parts, strict=True))
    again = np.flatnonzero(end[1:] == end[:-1])  # an end of A that closed a piece, then B's
    both[again] = True
    stay = np.ones(len(end), bool)
    stay[again + 1] = False
    return end[stay], at[stay], bt[stay], both[stay]


@cache
def _digits(n: int) -> np.ndarray:
    """The digits of the numbers below n, a row each, with room for a sign after them (zeros)."""
    text = np.array([str(i) for i in range(n)], "S10")
    return text.view(np.uint8).reshape(n, -1)


@dataclass
class Batch:
    """Encoded texts laid one after another."""

    a: np.ndarray  # ids of A
    b: np.ndarray
    a_at: np.ndarray  # each text's first token and the end
    b_at: np.ndarray
    end: np.ndarray  # overlaps: end byte, A token, B token, whether both end there
    at: np.ndarray
    bt: np.ndarray
    both: np.ndarray

    @classmethod
    def of(cls, ids: list[tuple[list[int], list[int]]], lengths: tuple[np.ndarray, np.ndarray], piece: int = PIECE) -> Batch:
        out = []
        for k in (0, 1):
            first = np.concatenate(([0], np.cumsum([len(x[k]) for x in ids], dtype=np.int64)))
            own = np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64, int(first[-1]))
            out.append((own, first, np.cumsum(lengths[k][own])))
        (a, a_at, a_end), (b, b_at, b_end) = out
        return cls(a, b, a_at, b_at, *overlaps(a_end, b_end, piece))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) that end together; the last ones of each group."""
        return self.at[self.both], self.bt[self.both]

    def digests(self) -> list[str]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``, hashed; '' for a text without tokens."""
        if not len(self.a):
            return [""] * (len(self.a_at) - 1)
        la, lb = self.links()
        own = lambda end: np.diff(end, prepend=-1)  # noqa: E731  tokens in each group
        at_a = np.arange(len(self.a)) + np.repeat(np.concatenate(([0], lb[:-1] + 1)), own(la))  # after B's of earlier groups
        at_b = np.arange(len(self.b)) + np.repeat(la + 1, own(lb))  # after A's of its own group too
        ids = np.empty(len(at_a) + len(at_b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        after = np.full(len(ids), ord(","), np.uint8)  # what follows each id
        after[at_a[la]], after[at_b[lb]] = ord("|"), ord(";")
        digits = _digits(1 << int(ids.max()).bit_length())[ids]
        size = np.count_nonzero(digits, axis=1)
        digits[np.arange(len(ids)), size] = after
        text = digits[digits != 0]
        start = np.concatenate(([0], np.cumsum(size + 1)))
        cut = start[self.a_at + self.b_at]
        data = text.tobytes()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _stretches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Rows of about BATCH_BYTES together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def alignments(docs: DataFrame, models: Tokenizers, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, a_ids, b_ids, overlaps, groups) of each row: overlaps as (a, b, start, end), groups as (a_start, a_end, b_start, b_end, start, end); tokens by number, bytes by offset in the space and the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(models)
    kind = docs.schema[id_col].dataType
    struct = lambda names: f"array<struct<{', '.join(f'{n}: bigint' for n in names)}>>"
    own, grouped = ("a", "b", "start", "end"), ("a_start", "a_end", "b_start", "b_end", "start", "end")
    schema = f"id {kind.simpleString()}, a_ids array<int>, b_ids array<int>, overlaps {struct(own)}, groups {struct(grouped)}"

    def rows(names: tuple[str, ...], values: list[np.ndarray], cut: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], list(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _stretches(texts):
                x = Batch.of(tok.encode(texts[lo:hi]), tok.lengths, piece)
                cut = np.searchsorted(x.at, x.a_at)  # each text's first overlap
                zero = np.repeat(np.concatenate(([0], x.end))[cut[:-1]], np.diff(cut))  # where its bytes begin
                a0, b0 = (np.repeat(first[:-1], np.diff(cut)) for first in (x.a_at, x.b_at))
                start = np.concatenate(([0], x.end))[:-1]
                # groups: between ends of both
                g = np.flatnonzero(x.both)
                row = np.searchsorted(cut, g, "right") - 1
                new = np.ones(len(g), bool)
                new[1:] = row[1:] != row[:-1]
                before = lambda v, g=g, new=new: np.where(new, 0, np.concatenate(([0], v[:-1])))
                ga, gb, ge = x.at[g] + 1 - a0[g], x.bt[g] + 1 - b0[g], x.end[g] - zero[g]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        *(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())) for first, ids in ((x.a_at, x.a), (x.b_at, x.b))),
                        rows(own, [x.at - a0, x.bt - b0, start - zero, x.end - zero], cut),
                        rows(grouped, [before(ga), ga, before(gb), gb, before(ge), ge], np.searchsorted(g, cut)),
                    ],
                    ["id", "a_ids", "b_ids", "overlaps", "groups"],
                )

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def _linked(docs: DataFrame, models: Tokenizers, piece: int) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, groups_sha256, pairs) of each row, stored; pairs: the packed ids of its links."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, row = sent.value, TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _stretches(texts):
                x = Batch.of(tok.encode(texts[lo:hi]), tok.lengths, piece)
                la, lb = x.links()
                cut = np.searchsorted(la, x.a_at)
                pair = (x.b[lb] << PAIR_BITS) | x.a[la]
                small = np.ascontiguousarray(pair.astype("<i8"))
                pairs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(small.tobytes())])
                numbers = [np.arange(row, row + hi - lo), np.diff(x.a_at), np.diff(x.b_at), np.diff(cut)]
                row += hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(numbers[0]), b.column(0).slice(lo, hi - lo), *map(pa.array, numbers[1:]), pa.array(x.digests(), pa.string()), pairs], ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    out = docs.mapInArrow(run, f"row long, id {kind.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary")
    return materialize(out, "alignment")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, links) over the corpus; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            new, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64), return_counts=True)
            every, at = np.unique(np.concatenate((held, new)), return_inverse=True)
            held, times = every, np.bincount(at, np.concatenate((times, n)), len(every)).astype(np.int64)
            if len(held) >= HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], ["pair", "links"])
                held, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for lo in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[lo : lo + (1 << 16)]), pa.array(times[lo : lo + (1 << 16)])], ["pair", "links"])

    return linked.select("pairs").mapInArrow(run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))


def scores(docs: DataFrame, models: Tokenizers, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    linked = _linked(docs.select(id_col, text_col), models, piece)
    counts = materialize(pair_counts(linked), "alignment-pairs")
    if counts.count() <= sent_pairs:
        out = _scored(spark, linked, counts)
        discard(counts)
        return out
    top = counts.groupBy(F.shiftright("pair", PAIR_BITS).alias("b")).agg(F.max("links").alias("most"))
    named = counts.withColumn("b", F.shiftright("pair", PAIR_BITS)).join(top, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pair, n = np.unique(np.frombuffer(data.as_buffer(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row)), pa.array(pair), pa.array(n)], ["row", "pair", "n"])

    met = linked.where("n_groups > 0").select("row", "pairs").mapInArrow(pairs, "row long, pair long, n long").join(named, "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    out = linked.join(sums, "row", "left").withColumns({"n_links": F.col("n_groups"), "n_best": F.coalesce("n_best", F.lit(0)), "count_sum": F.coalesce("count_sum", F.lit(0))})
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _scored(spark: SparkSession, linked: DataFrame, counts: DataFrame) -> DataFrame:
    """The same with all counts sent to every task."""
    table = counts.orderBy("pair").toArrow()
    pair, links = (table[c].to_numpy() for c in ("pair", "links"))
    most = np.zeros(int(pair[-1] >> PAIR_BITS) + 1 if len(pair) else 0, np.int64)
    np.maximum.at(most, pair >> PAIR_BITS, links)
    sent = spark.sparkContext.broadcast((pair, links, most))
    id_type = linked.schema["id"].dataType
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, most = sent.value
        for b in batches:
            data = b.column(5)
            own = np.frombuffer(b"".join(data.to_pylist()), np.int64)
            cut = np.concatenate(([0], np.cumsum([len(x.as_buffer()) // 8 for x in data], dtype=np.int64)))
            c = links[np.searchsorted(pair, own)]
            best = np.concatenate(([0], np.cumsum(c == most[own >> PAIR_BITS])))
            total = np.concatenate(([0], np.cumsum(c)))
            n = b.column(3)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(kind), b.column(1), b.column(2), n, n, pa.array(np.diff(best[cut])), pa.array(np.diff(total[cut])), b.column(4)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return linked.select("id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs").mapInArrow(run, schema)
