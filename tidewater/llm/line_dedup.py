"""Removal of lines that many documents share.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least ``CHARS`` code points that stand in at least ``DOCUMENTS``
documents lose their lines everywhere but in the document of the largest id that holds them.

Two Bloom filters say which keys may stand in more than one document: one takes every key's hash, the other each hash that the first has already. Only
lines in the second are shuffled by key for exact counts and the choice of the document that keeps them. The filters are cut into segments
by hash, so neither is ever whole in one place, and nothing about them goes through the driver or is broadcast:

1. Each task writes blocks of its lines (digest of the key, document) once, to a table bucketed by block.
2. A block asks each segment with 4 bytes a line. A segment takes its requests one after another through the two filters, then answers
   with a bit for each line that it was asked for.
3. Answers go back to their blocks, which read the bucketed table where it is, without a shuffle, and send on the suspected lines.

Segments grow in number with the lines (``SEGMENT_LINES`` each), so memory and the rate of false alarms stay the same at every size. A line that a third of all
documents holds is asked for at most twice a block, and later counted by (key, document), then summed before it meets by key.

Keys are compared by 128-bit digests (MD5). Confirmed keys go to all tasks where they are at most ``SENT_KEYS``; more meet their documents by a shuffle.

Edge cases: a null or empty text is one empty line and comes back as the empty text. Rows with the same id are one document; rows with a null id are one
document too, the smallest. A key that a document holds several times keeps all its lines there or none. Tables without rows give none.
``text`` is replaced; columns named n_lines or n_dropped in the input are replaced as well; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.session import bounded_batches
from tidewater.llm.words import SPACES, mixed
from tidewater.sources.layout import bucketed_scratch
from tidewater.sources.scratch import discard, materialize

CHARS, DOCUMENTS = 40, 5
BLOCK_LINES = 1 << 19  # lines in a block, about
SEGMENT_LINES = 1 << 24  # requests that a segment takes
BITS = 16  # of each filter, a request
SENT_KEYS = 1_000_000
WHITE = SPACES.decode()


def key_of(line: str, chars: int = CHARS) -> bytes | None:
    """The digest of a line's key; None if that is short."""
    own = line.strip(WHITE)
    return hashlib.md5(own.encode().lower()).digest() if len(own) >= chars else None  # of bytes, so A-Z only


def _blocks(chars: int):
    """Blocks of a task: the ids of its documents, and each line's document and key, a key once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, ids, counts, keys = TaskContext.get().partitionId() << 32, 0, [], [], []

        def block() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([owner.tobytes()], pa.binary()), pa.array([b"".join(keys)], pa.binary())], ["block", "n", "ids", "owner", "keys"])

        for b in batches:
            kind = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {k for line in (text or "").split("\n") if (k := key_of(line, chars)) is not None}
                if own:
                    ids.append(i)
                    counts.append(len(own))
                    keys += own
                if len(keys) >= BLOCK_LINES:
                    yield block()
                    made, ids, counts, keys = made + 1, [], [], []
        if keys:
            yield block()

    return run


def _places(keys: bytes, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each key, and 32 bits of its hash for the places in the segment's filters."""
    h = mixed(np.frombuffer(keys, np.uint64)[::2])
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32), h.astype(np.uint32)


def _requests(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                segment, place = _places(keys.as_buffer(), segments)
                order = np.argsort(segment, kind="stable")
                used, at = np.unique(segment[order], return_index=True)
                place = place[order]
                parts = []
                for p in np.split(place, at[1:]):
                    value, times = np.unique(p, return_counts=True)
                    parts.append(np.concatenate((value, value[times > 1])).tobytes())  # what stands here more than once is asked for twice
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), block)), pa.array(parts, pa.binary())], ["segment", "block", "places"])

    return run


class Filters:
    """A filter of hashes seen, and one of those seen again; two places for each hash."""

    def __init__(self, requests: int) -> None:
        self.mask = np.uint32((1 << max(10, int(BITS * requests - 1).bit_length())) - 1)
        self.once, self.again = (np.zeros(int(self.mask) + 1, bool) for _ in range(2))

    def _at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return place & self.mask, (mixed(place.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) & self.mask

    def add(self, place: np.ndarray) -> None:
        """Hashes of a block, those that stand twice in it two times."""
        value, times = np.unique(place, return_counts=True)
        a, b = self._at(value)
        seen = (times > 1) | (self.once[a] & self.once[b])
        self.again[a[seen]] = self.again[b[seen]] = True
        self.once[a] = self.once[b] = True

    def suspects(self, place: np.ndarray) -> np.ndarray:
        a, b = self._at(place)
        return self.again[a] & self.again[b]


def _answer(table: pa.Table) -> pa.Table:
    """A segment's requests through its filters: the suspected places of each block."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["places"]]
    filters = Filters(sum(map(len, parts)))
    for p in parts:
        filters.add(p)
    found = []
    for p in parts:
        p = np.unique(p)
        found.append(p[filters.suspects(p)].tobytes())
    return pa.table([table["segment"], table["block"], pa.array(found, pa.binary())], ["segment", "block", "places"])


def _suspected(segments: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, owner, keys, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                segment, place = _places(keys.as_buffer(), segments)
                full = segment.astype(np.uint64) << np.uint64(32) | place
                asked = [np.frombuffer(a["places"], np.uint32).astype(np.uint64) | np.uint64(a["segment"]) << np.uint64(32) for a in answers]
                hit = np.flatnonzero(np.isin(full, np.concatenate(asked)))
                key = np.frombuffer(keys.as_buffer(), "V16")[hit]
                own = np.frombuffer(owner.as_buffer(), np.int32)[hit]
                for lo in range(0, len(hit), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key[lo : lo + (1 << 16)]], pa.binary()), pa.array([ids[i] for i in own[lo : lo + (1 << 16)].tolist()], kind)], ["key", "id"])

    return run


def suspects(docs: DataFrame, chars: int = CHARS, segment_lines: int = SEGMENT_LINES) -> DataFrame | None:
    """(key, id) once each, of the lines that may stand in several documents, stored; none that does is missing. ``docs``: (id, text)."""
    spark = docs.sparkSession
    id_type = docs.schema[0].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.mapInArrow(_blocks(chars), f"block long, n long, ids array<{id_type.simpleString()}>, owner binary, keys binary")
    lines = bucketed_scratch(lines, "line-blocks", parts, "block")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if not total:
        discard(lines)
        return None
    segments = max(parts, -(-total // segment_lines))
    asked = lines.select("block", "keys").mapInArrow(_requests(segments), "segment int, block long, places binary")
    answers = asked.groupBy("segment").applyInArrow(_answer, "segment int, block long, places binary").where(F.length("places") > 0)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("segment", "places")).alias("answers"))  # bounded by the block's lines
    met = lines.join(answers, "block").select("ids", "owner", "keys", "answers")
    found = met.mapInArrow(_suspected(segments, to_arrow_type(id_type)), f"key binary, id {id_type.simpleString()}")
    found = materialize(found.distinct(), "line-suspects")
    discard(lines)
    return found


def repeated(suspected: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(key, last) of the keys in at least so many documents, with the largest id."""
    return suspected.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("id").alias("last")).where(F.col("c") >= documents).select("key", "last")


def _cleaned(text: str | None, dropped, chars: int) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    stay = [line for line in lines if (k := key_of(line, chars)) is None or not dropped(k)]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, documents: int = DOCUMENTS, sent_keys: int = SENT_KEYS, segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """``docs`` with the shared lines out of ``text_col``, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = suspects(docs.select(id_col, text_col), chars, segment_lines)
    keys = None
    if found is not None:
        keys = materialize(repeated(found, documents), "line-keys")
    plain = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema[text_col].nullable = True
    at, id_at = plain.columns.index(text_col), plain.columns.index(id_col)

    def rows(b: pa.RecordBatch, out: list[tuple[str, int, int]], width: int) -> pa.RecordBatch:
        text, n, k = ([x[i] for x in out] for i in range(3))
        columns = list(b.columns[:width])
        columns[at] = pa.array(text, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(k, pa.int64())], [*b.schema.names[:width], "n_lines", "n_dropped"])

    if keys is None or keys.count() <= sent_keys:
        table = keys.toArrow() if keys is not None else None
        known = dict(zip(table["key"].to_pylist(), table["last"].to_pylist(), strict=True)) if table is not None else {}
        if keys is not None:
            discard(found, keys)
        sent = spark.sparkContext.broadcast(known)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = sent.value
            for b in batches:
                out = [_cleaned(t, lambda k, i=i: k in last and last[k] != i, chars) for i, t in zip(b.column(id_at).to_pylist(), b.column(at).to_pylist(), strict=True)]
                yield rows(b, out, b.num_columns)

        return plain.mapInArrow(apply, schema)

    gone = found.join(keys, "key").where(F.col("id").isNull() | (F.col("id") != F.col("last")))
    gone = materialize(gone.groupBy("id").agg(F.collect_list("key").alias("_gone")).withColumnRenamed("id", "_gone_id"), "line-gone")  # bounded by the document's lines
    discard(found, keys)
    met = plain.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")), "left").select(*plain.columns, "_gone")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.num_columns - 1
            out = [_cleaned(t, set(g or ()).__contains__, chars) for t, g in zip(b.column(at).to_pylist(), b.column(width).to_pylist(), strict=True)]
            yield rows(b, out, width)

    return met.mapInArrow(drop, schema)
