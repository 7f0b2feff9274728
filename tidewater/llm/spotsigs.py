"""Document fingerprints by SpotSigs.

A signature is an anchor (a common word, or the start of the text) and the chain of the next ``CHAIN`` content words after it, words without case and
punctuation. Signatures are 64-bit hashes; a document's fingerprint is the set of their upper halves, sorted, in hex. Near copies are found by the whole
hashes, which different chains do not share by chance, however many documents there are. Boilerplate
has few common words, so it hardly counts; a moved paragraph keeps its signatures.

A text in which no common word has a full chain (a table, a list, code, other languages) is signed whole: by the
chains that begin at each of its content words. One with few common words is signed at those and its start only.

A text with words but no full chain has one signature of all its words; one without words, of its characters;
the empty text has none. Two empty fingerprints are alike (1), an empty and another are not (0). Equal texts
have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from tidewater.llm import words
from tidewater.llm.jaccard_join import Sets, as_sets, named_classes
from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

CHAIN = 3
PART_BYTES = 1 << 27  # bytes of text in a range of documents
QUANTILES = 100_000
PACK = "zstd"
START = 0x5851F42D4C957F2D  # stands for the start of a text among the anchors
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were which will with "
    "als am auf aus bei das dem den der des die du ein eine einem einen einer er es für im ist mit nicht sich sie sind und von war wie zu zum zur "
    "au aux avec ce cette dans de elle en est et il la le les leur mais ou par pas pour plus que qui se ses son sont sur un une "
    "al como con del el ella entre fue ha las lo los más no o para pero por se sin sobre son su sus una y"
)


@cache
def _anchors() -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(words.hashed(sorted(set(ANCHORS.split())), plain=True))
    maybe = np.zeros(1 << 16, bool)
    maybe[key >> np.uint64(48)] = True
    return key, maybe


def _is_anchor(h: np.ndarray) -> np.ndarray:
    key, maybe = _anchors()
    out = maybe[h >> np.uint64(48)]
    near = np.flatnonzero(out)
    out[near] = np.isin(h[near], key)
    return out


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted, distinct 64-bit signatures of each text."""
    out: list[np.ndarray] = []
    for lo, hi, h, first in words.pieces(texts, plain=True):
        anchor = _is_anchor(h)
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        ends = np.searchsorted(content, first)  # each row's first content word and the end
        row = np.searchsorted(first, spots, "right") - 1
        begin = np.searchsorted(content, spots)  # the first content word after the anchor
        full = begin + chain <= ends[row + 1]  # within the text
        row, name, begin = row[full], h[spots[full]], begin[full]
        # each text's start is an anchor too; where it is the only one with a full chain, so is every place
        count = np.where(np.bincount(row, minlength=hi - lo) > 0, 1, np.diff(ends) - chain + 1)
        count = np.where(np.diff(ends) >= chain, count, 0)
        at = np.cumsum(count) - count
        row = np.concatenate((np.repeat(np.arange(hi - lo), count), row))
        name = np.concatenate((np.full(count.sum(), START, np.uint64), name))
        begin = np.concatenate((np.arange(count.sum()) + np.repeat(ends[:-1] - at, count), begin))
        order = np.argsort(row, kind="stable")
        row, name, begin = row[order], name[order], begin[order]
        s = words.running(h[content])
        sig = words.mixed(words.window(s, begin, begin + chain) ^ name)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        whole = None
        for i in range(hi - lo):
            own = sig[cut[i] : cut[i + 1]]
            if not len(own):
                if first[i + 1] > first[i]:
                    whole = words.running(h) if whole is None else whole
                    own = words.mixed(words.window(whole, first[i : i + 1], first[i + 1 : i + 2]))
                elif t := texts[lo + i].as_py():
                    own = np.frombuffer(hashlib.md5(t.encode()).digest()[:8], np.uint64)
            out.append(np.unique(own))
    return out


def print_of(sig: np.ndarray) -> np.ndarray:
    """The fingerprint of sorted signatures: their upper halves, distinct."""
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def text_of(prints: np.ndarray) -> str:
    return prints.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 without looking when their lengths alone put it under ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, chain: int = CHAIN, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (hex of the sorted signatures) and ``signatures`` (their number)."""

    @F.pandas_udf("string")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([text_of(print_of(x)) for x in signatures(pa.array(s, pa.large_string(), from_pandas=True), chain)], dtype=object)

    out = docs.drop("fingerprint", "signatures").withColumn("fingerprint", make(F.col(text_col)))
    return out.withColumn("signatures", F.call_function("div", F.length("fingerprint"), F.lit(8)))


def signed(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(doc_id, text) with each text's signatures in its place, packed, stored: texts are signed once, whatever reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in signatures(b.column(1), chain)], pa.binary())], ["doc_id", "text"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text binary")
    return materialize(rows, "spotsigs-signed")


def stored_sets(packed: pa.Array) -> Iterator[tuple[int, int, Sets]]:
    """Packed signatures as sets for the join."""
    found = [np.frombuffer(x.as_buffer(), np.uint64) for x in packed]
    yield 0, len(found), _as_sets(found)


def _as_sets(found: list[np.ndarray]) -> Sets:
    at = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
    return as_sets(np.concatenate(found) if found else np.empty(0, np.uint64), at)


def near_classes(docs: DataFrame, percent: int = 80, chain: int = CHAIN) -> DataFrame:
    """(doc_id, signatures, v, near_class) of every document, stored: v names the fingerprint's set; near_class is the smallest doc_id that near copies lead to.

    Two fingerprints are near where their Jaccard similarity is at least ``percent`` in a hundred. Equal fingerprints are one from the start, whatever
    their ids; the others meet over their first signatures, common ones last, only where their lengths allow a link (by ranges of
    length in the nodes of a tree), and are compared in full. No list of all pairs is made.
    """
    every = signed(docs, chain)
    out = named_classes(every, stored_sets, percent)
    discard(every)
    return out.withColumnsRenamed({"n": "signatures", "component_id": "near_class"})


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long"


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are about to move; their sizes first."""
    for b in batches:
        texts = [t.encode() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t).to_bytes(8, "little") + pa.compress(t, PACK, asbytes=True) for t in texts], pa.binary())], ["doc_id", "_tie", "packed"])


def _unpacked(data: bytes) -> str:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), PACK, asbytes=True).decode()


def with_next(docs: DataFrame, near: DataFrame, parts: int) -> DataFrame:
    """Rows (_part, _tail, _kind, doc_id, packed, v, near_class) such that within a part, in order, each row of kind 1 with _tail 0 is followed by the next document's.

    Parts are ranges of doc_id, cut at its quantiles by a sketch that tells ``QUANTILES`` of them apart (fixed by this call). The first document of each range is
    added to the range before it as a tail, and the very first to the last range. The texts are shuffled once, compressed. Rows of kind 0 are
    those of ``near`` (doc_id, v, near_class) and stand before the documents of their id.
    """
    parts = min(parts, QUANTILES)
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted({float(c) for c in docs.agg(F.percentile_approx("doc_id", steps, QUANTILES).alias("c")).first().c or ()}) if steps else []

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double"))
        if cuts:
            rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_part").transform(rows)
        else:
            rows = rows.withColumn("_part", F.lit(0))
        return rows.withColumn("_part", F.col("_part").cast("int")).drop("_at")

    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    firsts = dealt(docs.select("doc_id")).groupBy("_part").agg(F.min(id_).alias("_first"))  # one row a part
    order = Window.orderBy("_part")
    to = firsts.select("_first", F.coalesce(F.lag("_part").over(order), F.max("_part").over(Window.partitionBy())).alias("_part"))
    text = F.coalesce("text", F.lit(""))
    packed = lambda rows: rows.select("doc_id", F.xxhash64(text).alias("_tie"), text.alias("text")).mapInArrow(_packed, "doc_id long, _tie long, packed binary")
    none = {"v": F.lit(None).cast("long"), "near_class": F.lit(None).cast("long"), "_kind": F.lit(1)}
    out = dealt(packed(docs)).withColumns({"_tail": F.lit(0), **none})
    heads = packed(docs.join(F.broadcast(to.select("_first")), id_ == F.col("_first"), "left_semi"))
    tails = heads.join(F.broadcast(to), id_ == F.col("_first")).select("doc_id", "_tie", "packed", "_part")
    out = out.unionByName(tails.withColumns({"_tail": F.lit(1), **none}))
    names = dealt(near.select("doc_id", "v", "near_class")).withColumns({"_tie": F.lit(0).cast("long"), "packed": F.lit(None).cast("binary"), "_tail": F.lit(0), "_kind": F.lit(0)})
    out = out.unionByName(names).repartitionById(max(parts, 1), "_part")
    return out.sortWithinPartitions("_part", "_tail", F.col("doc_id").asc_nulls_first(), "_kind", "_tie").select("_part", "_tail", "_kind", "doc_id", "packed", "v", "near_class")


def edit_likeness(docs: DataFrame, chain: int = CHAIN, percent: int = 80) -> DataFrame:
    """Each document against its edited text and the next document (after the last: the first), by ascending doc_id (nulls first); and its class of near copies."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, signatures, class) that waits for its next document
        own, classes_of = None, {}  # classes of the documents of one id, by the name of their set
        for b in batches:
            part, tail, kind, ids, data, name, near = (b.column(i).to_pylist() for i in range(7))
            some = [i for i, k in enumerate(kind) if k]
            texts = [_unpacked(data[i]) for i in some]
            sigs = signatures(pa.array(texts, pa.large_string()), chain)
            names = iter(zip(texts, map(print_of, sigs), _as_sets(sigs).name.view(np.int64).tolist(), strict=True))
            todo = []
            for p, is_tail, k, i, v, c in zip(part, tail, kind, ids, name, near, strict=True):
                if (p, i) != own:
                    own, classes_of = (p, i), {}
                if not k:
                    classes_of[v] = c
                    continue
                t, s, v = next(names)
                if held is not None and held[0] == p:
                    todo.append((*held[1:], edited(held[2], t), s))
                held = None if is_tail else (p, i, t, s, classes_of.get(v, i))
            if not todo:
                continue
            new = list(map(print_of, signatures(pa.array([x[4] for x in todo], pa.large_string()), chain)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in todo], pa.int64()),
                    pa.array([len(x[1]) for x in todo], pa.int64()),
                    pa.array([hashlib.sha256(x[4].encode("utf-8", "surrogatepass")).hexdigest() for x in todo]),
                    pa.array([text_of(x[2]) for x in todo], pa.string()),
                    pa.array([text_of(n) for n in new], pa.string()),
                    pa.array([likeness(x[2], n) for x, n in zip(todo, new, strict=True)], pa.float64()),
                    pa.array([likeness(x[2], x[5]) for x in todo], pa.float64()),
                    pa.array([x[3] for x in todo], pa.int64()),
                ],
                [c.split()[0] for c in ROW.split(", ")],
            )

    near = near_classes(docs, percent, chain).where(~F.col("doc_id").eqNullSafe(F.col("near_class"))).select("doc_id", "v", "near_class").distinct()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return with_next(docs, near, parts).mapInArrow(run, ROW)
