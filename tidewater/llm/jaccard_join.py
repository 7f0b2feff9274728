"""Exact n-gram Jaccard join by signature trees, and its connected components.

A document's set is its distinct runs of ``k`` words. Documents of equal sets are one vertex from the start. Two sets as
similar as asked share an element among the first n - ceil(t*n) + 1 of each, in any fixed order of elements; the order
puts elements known to be common last, so few sets meet under one element. The sets under an element are compared
in two rounds:

1. each set with the leading set of the elements it shares most: this ties copies into components in
   a number of comparisons that grows with the sets, not with the pairs;
2. by signature trees: sets under one element that are still in different components become the leaves of trees, whose
   nodes hold the OR of the token bitmaps below and the range of set sizes. Two trees are walked together; a pair of nodes
   is dropped when sizes or the largest overlap that the bitmaps allow rule out a link, or when
   both are of one component. What is left is compared in full.

Groups are cut into blocks, and pairs of blocks are the units of work: sets of
the largest component (all linked already) meet only those outside it. A set so stands in as many units as there are blocks outside that component. Where these are more than
the set has first elements, its group is split instead: sets that link share not one but as many elements as one likes to ask for (and the sets have), if as many more of the
first are looked at, so they are grouped anew by that element and a second one, then a third, up to ``DEPTH``. Sets that have but one phrase in common part there. Only
sets that share ``DEPTH`` of their first elements without being linked remain pairs of blocks in unbounded number.

A set is named by 64 bits of its digest and elements by 64-bit hashes; a wrong answer needs a collision of either.
Edge cases: null or empty texts have the empty set and link with nothing; ids may be null or repeated;
a text of fewer than k words is one element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm import words
from tidewater.llm.components import components
from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

K, PERCENT = 5, 80
COMMON = 1_000_000  # elements that the order of elements lists as common; which ones does not change results
COMMON_IN_TASK, COUNTED = 3, 4_000_000  # listed if so many of about 10,000 documents read together have it
BLOCK = 256  # sets in a block
LEAF = 16
SENT = 1_000_000  # roles of sets in comparisons that are sent to every task; more meet their sets by a shuffle
PER_TASK = 200  # comparisons with one leading set in a task
DEPTH = 4  # elements that large groups are split by, at most

NARROW = np.uint64(0x9E3779B97F4A7C15)


class Sets(NamedTuple):
    """Sets of a stretch of rows: sorted distinct elements, where each row's begin, and its digest."""

    element: np.ndarray
    at: np.ndarray
    name: np.ndarray


Maker = Callable[[pa.Array], Iterator[tuple[int, int, Sets]]]  # (first row, end row, sets) of stretches of texts


def as_sets(e: np.ndarray, at: np.ndarray) -> Sets:
    """Sets from each row's elements, which may repeat and are sorted in place."""
    for i in range(len(at) - 1):
        e[at[i] : at[i + 1]].sort()
    new = np.ones(len(e), bool)
    new[1:] = e[1:] != e[:-1]
    new[at[:-1][at[:-1] < len(e)]] = True
    count = np.concatenate(([0], np.cumsum(new)))
    e, at = e[new], count[at]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mixed(e ^ NARROW))))
    return Sets(e, at, words.mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))


def sets_of(texts: pa.Array, k: int | Maker) -> Iterator[tuple[int, int, Sets]]:
    """Sets of runs of ``k`` words; or what another maker of sets gives."""
    if callable(k):
        yield from k(texts)
        return
    for lo, hi, h, first in words.pieces(texts):
        yield lo, hi, as_sets(*words.shingles(h, first, k))


def _common(docs: DataFrame, k: int | Maker) -> np.ndarray:
    """Elements that many documents share, rarest first: a list of bounded length, to order elements by."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent() -> pa.RecordBatch:
            e, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            e, n = e[n >= COMMON_IN_TASK], n[n >= COMMON_IN_TASK]
            return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n, pa.int64())], ["element", "n"])

        for b in batches:
            for _, _, s in sets_of(b.column(0), k):
                held.append(s.element)
                size += len(s.element)
            if size > COUNTED:
                yield frequent()
                held, size = [], 0
        yield frequent()

    found = docs.select("text").mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "element").limit(COMMON).toArrow()
    return np.ascontiguousarray(top["element"].to_numpy()[::-1]).view(np.uint64)


class Order:
    """Elements by hash, listed common ones behind all others."""

    def __init__(self, common: np.ndarray) -> None:
        self.rank = np.argsort(common, kind="stable")
        self.key = common[self.rank]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.key >> np.uint64(44)] = True

    def heads(self, s: Sets, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``need`` elements of each set (or all), in this order, and where each set's begin."""
        e, at = s.element, s.at
        late = self.maybe[e >> np.uint64(44)]
        near = np.flatnonzero(late)
        late[near] = np.isin(e[near], self.key)
        early = np.concatenate(([0], np.cumsum(~late)))
        nth = early[:-1] - np.repeat(early[at[:-1]], np.diff(at))
        take = np.flatnonzero(~late & (nth < np.repeat(need, np.diff(at))))
        have = early[at[1:]] - early[at[:-1]]
        count = np.minimum(have, need)
        short = np.flatnonzero((have < need) & (have < np.diff(at)))
        if not len(short):
            return e[take], np.concatenate(([0], np.cumsum(count)))
        parts, done, cut = [], 0, np.concatenate(([0], np.cumsum(count)))
        for i in short:  # common ones follow, rarest first
            own = np.arange(at[i], at[i + 1])[late[at[i] : at[i + 1]]]
            own = own[np.argsort(self.rank[np.searchsorted(self.key, e[own])], kind="stable")][: need[i] - have[i]]
            parts += [take[done : cut[i + 1]], own]
            done = cut[i + 1]
            count[i] += len(own)
        return e[np.concatenate([*parts, take[done:]])], np.concatenate(([0], np.cumsum(count)))


def prefix(n, percent: int):
    """How many first elements of a set of n must hold one of any set that links with it."""
    return n - (percent * n + 99) // 100 + 1


def bitmap(e: np.ndarray) -> bytes:
    """Bits of the elements' low parts, 4 to 8 times as many as there are elements."""
    width = max(64, 1 << int(4 * len(e) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(e & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def signed(docs: DataFrame, order: Order, k: int | Maker, percent: int) -> DataFrame:
    """(doc_id, n, v, head, bits) of every document: its set's size, name, first elements in order (``DEPTH`` - 1 more than a link needs) and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, s in sets_of(b.column(1), k):
                n = np.diff(s.at)
                need = np.where(n > 0, prefix(n, percent) + DEPTH - 1, 0)
                head, cut = sent.value.heads(s, need)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(s.name.view(np.int64)),
                        pa.array([head[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()),
                        pa.array([bitmap(s.element[s.at[i] : s.at[i + 1]]) for i in range(hi - lo)], pa.binary()),
                    ],
                    ["doc_id", "n", "v", "head", "bits"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, v long, head binary, bits binary")


def postings(every: DataFrame, order: Order, percent: int) -> DataFrame:
    """(element, v, n, place) of the first elements that more than one set has; place: where it stands in the set's order.

    One shuffle by element. Listed common elements need no test, so their sets are spread over tasks.
    """
    sent = every.sparkSession.sparkContext.broadcast(order.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, one = np.unique(b.column(0).to_numpy(), return_index=True)
            heads = b.column(2).take(pa.array(one)).to_pylist()
            n = b.column(1).to_numpy()[one]
            count = prefix(n, percent)
            element = np.frombuffer(b"".join(x[: 8 * c] for x, c in zip(heads, count.tolist(), strict=True)), np.uint64)
            place = np.arange(len(element)) - np.repeat(np.cumsum(count) - count, count)
            v, n = np.repeat(v, count), np.repeat(n, count)
            spread = np.where(np.isin(element, sent.value), (v.view(np.uint64) >> np.uint64(54)).astype(np.int32) + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(v), pa.array(n), pa.array(place.astype(np.int32)), pa.array(spread.astype(np.int32))], ["element", "v", "n", "place", "spread"])

    rows = every.where("n > 0").select("v", "n", "head").mapInArrow(run, "element long, v long, n long, place int, spread int")
    w = Window.partitionBy("element", "spread")
    rows = rows.withColumns({"lo": F.min("v").over(w), "hi": F.max("v").over(w)}).where((F.col("spread") > 0) | (F.col("lo") < F.col("hi")))
    return rows.select("element", "v", "n", "place").distinct()


def linked(na, nb, both, percent: int):
    return 100 * both >= percent * (na + nb - both)


def _same_size(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes may link; false if there is no other set."""
    return F.coalesce(F.least(a, b) * 100 >= F.greatest(a, b) * percent, F.lit(False)) & a.isNotNull() & b.isNotNull()


def verify(docs: DataFrame, names: DataFrame, pairs: DataFrame, k: int | Maker, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose full sets link, stored. ``names``: (v, least), each set's smallest document.

    Sets of the names that occur are taken from the texts again and go straight to where they are compared. All pairs of one ``a`` meet its
    set in as many tasks as it has ``PER_TASK`` pairs, so no set gathers an unbounded number of others.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "jaccard-pairs")
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("tasks"))
    right = pairs.join(tasks, "a").select(F.col("b").alias("v"), "a", F.pmod(F.xxhash64("b"), F.col("tasks")).alias("salt"), F.lit(1).alias("other"))
    left = tasks.select(F.col("a").alias("v"), "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("salt"), F.lit(0).alias("other"))
    roles = materialize(right.unionByName(left).join(names, "v"), "jaccard-roles")
    discard(pairs)
    sends = roles.count() <= SENT
    table = roles.orderBy("v").toArrow() if sends else None
    sent = docs.sparkSession.sparkContext.broadcast(table and tuple(table[c].to_numpy(zero_copy_only=False) if c != "least" else table[c].to_pylist() for c in ("v", "a", "salt", "other", "least")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, _, s in sets_of(b.column(1), k):
                name, out = s.name.view(np.int64), []
                full = np.diff(s.at) > 0
                if sent.value is None:
                    out = [(None, None, None, name[i], i, ids[lo + i]) for i in np.flatnonzero(full)]
                else:
                    v, a, salt, other, least = sent.value
                    first, end = np.searchsorted(v, name, "left"), np.searchsorted(v, name, "right")
                    for i in np.flatnonzero(full & (end > first)):
                        if ids[lo + i] == least[first[i]]:
                            out += [(a[j], salt[j], other[j], name[i], i, None) for j in range(first[i], end[i])]
                elements = pa.array([s.element[s.at[x[4]] : s.at[x[4] + 1]].tobytes() for x in out], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in out], pa.int64()) for c in (0, 1, 2, 3)), pa.array([x[5] for x in out], kind), elements], ["a", "salt", "other", "b", "id", "elements"])

    id_type = docs.schema["doc_id"].dataType
    kind = to_arrow_type(id_type)
    rows = docs.select("doc_id", "text").mapInArrow(sets, f"a long, salt long, other long, b long, id {id_type.simpleString()}, elements binary")
    if not sends:  # too many roles to send: sets meet them by a shuffle
        rows = rows.select("b", "id", "elements").join(roles.withColumnRenamed("v", "b"), "b").where(F.col("id").eqNullSafe(F.col("least")))
    rows = rows.select("a", "salt", "other", "b", "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int]] = []
            for x, role, y, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                other = np.frombuffer(e.as_buffer(), np.uint64)
                if not role:
                    own = other.copy()
                else:
                    at = np.searchsorted(own, other)
                    both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                    if linked(len(own), len(other), both, percent):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").select("a", "other", "b", "elements")
    found = materialize(rows.mapInArrow(compare, "a long, b long"), "jaccard-links")
    discard(roles)
    return found


class Node:
    """A stretch of leaves: size range, OR of bitmaps (folded to the narrowest below), component if there is but one."""

    __slots__ = ("bits", "component", "hi", "kids", "lo", "most", "spare", "tree", "least")

    def __init__(self, tree: Tree, lo: int, hi: int) -> None:
        self.tree, self.lo, self.hi = tree, lo, hi
        own = slice(lo, hi)
        self.least, self.most = int(tree.n[lo]), int(tree.n[hi - 1])
        comps = tree.comp[own]
        self.component = int(comps[0]) if (comps == comps[0]).all() else None
        width = min(len(b) for b in tree.bits[own])
        self.bits = np.bitwise_or.reduce([fold(b, width) for b in tree.bits[own]])
        self.spare: dict[int, int] = {}
        self.kids: list[Node] = []
        if hi - lo > LEAF:
            step = -(-(hi - lo) // 4)
            self.kids = [Node(tree, a, min(a + step, hi)) for a in range(lo, hi, step)]

    def slack(self, width: int) -> int:
        """The most elements that a set below has beyond its bits at this width."""
        if width not in self.spare:
            self.spare[width] = max(int(self.tree.n[i]) - int(np.bitwise_count(fold(self.tree.bits[i], width)).sum()) for i in range(self.lo, self.hi))
        return self.spare[width]


class Tree:
    def __init__(self, v: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes]) -> None:
        order = np.lexsort((comp, n))
        self.v, self.n, self.comp = v[order], n[order], comp[order]
        self.bits = [np.frombuffer(bits[i], np.uint8) for i in order]
        self.root = Node(self, 0, len(v))


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller power of two of bytes: bits of equal low part fall together."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def walk(x: Tree, y: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of leaves of two trees (or one) that sizes, components and bitmaps do not rule out."""
    todo = [(x.root, y.root)]
    while todo:
        a, b = todo.pop()
        if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least or a.component is not None and a.component == b.component:
            continue
        width = min(len(a.bits), len(b.bits))
        shared = int(np.bitwise_count(fold(a.bits, width) & fold(b.bits, width)).sum())
        if (100 + percent) * (min(a.slack(width), b.slack(width)) + shared) < percent * (a.least + b.least):
            continue
        if a.kids or b.kids:
            left, right = a.kids or [a], b.kids or [b]
            todo += [(p, q) for i, p in enumerate(left) for j, q in enumerate(right) if a is not b or i <= j]
            continue
        for i in range(a.lo, a.hi):
            for j in range(i + 1 if a is b else b.lo, b.hi):
                na, nb = int(x.n[i]), int(y.n[j])
                if x.comp[i] == y.comp[j] or 100 * min(na, nb) < percent * max(na, nb):
                    continue
                w = min(len(x.bits[i]), len(y.bits[j]))
                p, q = fold(x.bits[i], w), fold(y.bits[j], w)
                most = min(na - int(np.bitwise_count(p & ~q).sum()), nb - int(np.bitwise_count(q & ~p).sum()))
                if (100 + percent) * most >= percent * (na + nb):
                    yield int(x.v[i]), int(y.v[j])


def tree_pairs(units: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """Units (element, kind, i, j, side, v, n, component), with bitmaps from ``every`` (v, bits), to candidate pairs (a, b): side 0 against side 1, or against itself without a side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list) -> pa.RecordBatch:
            side = np.array([r[1] for r in rows])
            trees = []
            for s in (0, 1):
                own = [r for r, i in zip(rows, side, strict=True) if i == s]
                if own:
                    trees.append(Tree(np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.array([r[4] for r in own]), [r[5] for r in own]))
            # a unit of two sides needs both; a unit within a block has side 0 only
            alone = rows[0][6]
            found = [] if not trees or len(trees) < 2 and not alone else list(walk(trees[0], trees[-1], percent))
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

        held: list = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if held and held[0][0] != r[0]:
                    yield emit(held)
                    held = []
                held.append(r)
        if held:
            yield emit(held)

    bits = every.select("v", "bits").join(units.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"])
    units = units.join(bits, "v").select(F.concat_ws(":", "element", "i", "j").alias("unit"), "side", "v", "n", "component", "bits", (F.col("kind") == 0).alias("alone"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def deeper(rows: DataFrame, every: DataFrame, percent: int, level: int) -> DataFrame:
    """Rows (element, v, n, component, place) under keys of ``level`` elements to rows under those and each later one among the set's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, v, n, component, place = (b.column(i).to_numpy() for i in range(5))
            heads = [x[8 * (p + 1) : 8 * c] for x, p, c in zip(b.column(5).to_pylist(), place.tolist(), (prefix(n, percent) + level).tolist(), strict=True)]
            count = np.array([len(x) // 8 for x in heads], np.int64)
            key, v, n, component, place = (np.repeat(x, count) for x in (key, v, n, component, place))
            nth = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            key = words.paired(key.view(np.uint64), np.frombuffer(b"".join(heads), np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(v), pa.array(n), pa.array(component), pa.array((place + 1 + nth).astype(np.int32))], ["element", "v", "n", "component", "place"])

    heads = every.select("v", "head").join(rows.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"])
    met = rows.join(heads, "v").select("element", "v", "n", "component", "place", "head")
    return met.mapInArrow(run, "element long, v long, n long, component long, place int")


def spanning(rows: DataFrame, percent: int, level: int) -> DataFrame:
    """Rows of elements whose sets are of several components, with ``lead``, the component of most of them, and ``large``, whether the others make more
    blocks than the sets have further elements to be split by.

    A pair is looked for under its first shared elements only: what stands before them in a set is not in the other. So a set of n whose last
    element of the key has ``place`` shares at most n - place + level - 1 elements, and links with none larger than ``reach``. The smaller set of a pair must reach its
    own size; where none under an element does (texts of one template, each with enough words of its own), no pair is left, and other
    sets stay only if those that do could link with them.
    """
    shares = (F.col("n") - F.col("place") + level - 1) * (100 + percent)
    rows = rows.withColumn("reach", F.call_function("div", shares, F.lit(percent)) - F.col("n"))
    able = F.col("reach") >= F.col("n")
    by = rows.groupBy("element", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.min(F.when(able, F.col("n"))).alias("least"), F.max(F.when(able, F.col("reach"))).alias("most"))
    by = by.groupBy("element").agg(F.count(F.lit(1)).alias("components"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "component")).alias("top"), F.min("least").alias("least"), F.max("most").alias("most"))
    further = F.col("n") / F.col("c") * (1 - percent / 100) + level
    large = F.col("c") - F.col("top.c") > BLOCK * further
    met = rows.join(by.where((F.col("components") > 1) & F.col("least").isNotNull()).select("element", "c", "least", "most", F.col("top.component").alias("lead"), large.alias("large")), "element")
    return met.where(able | (F.col("least") <= F.col("reach")) & (F.col("n") <= F.col("most"))).drop("reach", "least", "most")


def _units(shared: DataFrame, labels: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks, for every group of sets under one element that spans components; large groups are split by further elements first."""
    rows = shared.join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))
    stored, units = [], []
    for level in range(1, DEPTH + 1):
        rows = materialize(spanning(rows, percent, level), "jaccard-groups")
        stored.append(rows)
        large = rows.where("large")
        split = level < DEPTH and large.limit(1).count() > 0
        units.append(_blocks(rows.where("not large") if split else rows, percent))
        if not split:
            break
        rows = deeper(large, every, percent, level)
    out = units[0]
    for u in units[1:]:
        out = out.unionByName(u)
    out = materialize(out, "jaccard-units")
    discard(*stored)
    return out


def _blocks(tagged: DataFrame, percent: int) -> DataFrame:
    # sizes alone leave no partner to a set whose neighbours in size, under the element, are too far; the sets
    # of large groups all have near ones, so only groups of one block are looked at
    w = Window.partitionBy("element", F.when(F.col("c") > BLOCK, F.col("v")).otherwise(0)).orderBy("n")
    near = lambda m: _same_size(F.col("n"), m(F.col("n")).over(w), percent)
    tagged = tagged.withColumn("near", (F.col("c") > BLOCK) | near(F.lag) | near(F.lead)).where("near").drop("near", "c")
    # of elements with the same sets, one will do
    groups = tagged.groupBy("element", "lead").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("v")).alias("x1"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("x2"),
    )
    groups = groups.where("c1 < c2").groupBy("size", "x1", "x2").agg(F.min("element").alias("element"))
    rows = tagged.join(groups.select("element"), "element").withColumn("minor", F.col("component") != F.col("lead"))
    sizes = rows.groupBy("element").agg(F.ceil(F.count_if("minor") / BLOCK).alias("minors"), F.ceil(F.count_if(~F.col("minor")) / BLOCK).alias("majors"))
    rows = rows.join(sizes, "element")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("v", F.lit(7)), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("bigint"), F.col(n)), lambda i: i < F.col(n))
    one = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    block = F.col("block")
    # minor blocks with themselves (0), each other (1), and blocks of the leader's component (2)
    own = F.array(one(0, block, block, 0))
    later = F.transform(F.filter(upto("minors"), lambda t: t > block), lambda t: one(1, block, t, 0))
    former = F.transform(F.filter(upto("minors"), lambda t: t < block), lambda t: one(1, t, block, 1))
    cross = F.transform(upto("majors"), lambda t: one(2, block, -t - 1, 0))
    major = F.transform(upto("minors"), lambda t: one(2, t, -block - 1, 1))
    units = rows.withColumn("u", F.explode(F.when(F.col("minor"), F.concat(own, later, former, cross)).otherwise(major)))
    return units.select("element", "u.*", "v", "n", "component")


def link(docs: DataFrame, k: int | Maker = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, v) of every document, and (v, component) of the sets that link with another, both stored.

    ``docs`` (doc_id, text) is read four times: it should be a stored table.
    """
    bounded_batches(docs.sparkSession)
    order = Order(_common(docs, k))
    every = materialize(signed(docs, order, k, percent), "jaccard-signed")
    names = materialize(every.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("least")), "jaccard-names")
    shared = materialize(postings(every, order, percent), "jaccard-shared")
    # the leading set of an element is the one that meets most others over all its elements
    size = shared.groupBy("element").agg(F.count(F.lit(1)).alias("c"))
    weight = shared.join(size, "element").groupBy("v").agg(F.sum("c").alias("weight"))
    lead = shared.join(weight, "v").groupBy("element").agg(F.max(F.struct("weight", "v", "n")).alias("lead")).select("element", F.col("lead.v").alias("lead"), F.col("lead.n").alias("lead_n"))
    close = shared.join(lead, "element").where((F.col("v") != F.col("lead")) & _same_size(F.col("n"), F.col("lead_n"), percent))
    best = close.groupBy("v", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("v").agg(F.max(F.struct("c", "lead")).alias("x"))
    first = verify(docs, names, best.select(F.col("x.lead").alias("a"), F.col("v").alias("b")), k, percent)
    labels = components(first)
    units = _units(shared, labels, every, percent)
    more = verify(docs, names, tree_pairs(units, every, percent), k, percent)
    narrow = materialize(every.select("doc_id", "n", "v"), "jaccard-documents")
    found = components(first.union(more))
    discard(every, shared, units, names, labels, first, more)
    return narrow, found


def named_classes(docs: DataFrame, k: int | Maker = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, v, component_id) of every document, stored: its set's size and name, and the smallest doc_id that links lead to, itself included."""
    every, labels = link(docs, k, percent)
    # a set's smallest id first: all copies of a text are one row from here on
    nodes = every.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("v", "component_id")
    out = every.join(named, "v", "left")
    out = out.select("doc_id", "n", "v", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = materialize(out, "jaccard-classes")
    discard(every, labels)
    return out


def classes(docs: DataFrame, k: int | Maker = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    return named_classes(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, k: int | Maker = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component (smallest id, then set name; null ids last); empty texts all stay.

    The decisions are narrow rows; the texts are shuffled once, to meet them.
    """
    every, labels = link(docs, k, percent)
    text_id = lambda: F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = every.where("n > 0").join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))
    keep = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "v")).alias("k")).select("k.doc_id", "k.v")
    keep = materialize(keep.select(text_id().alias("_keep_id"), F.col("v").alias("_keep_v")), "jaccard-kept")
    discard(every, labels)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(s.name.view(np.int64), np.diff(s.at)) for _, _, s in sets_of(b.column(b.schema.get_field_index("text")), k)]
            v, n = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v), pa.array(n)], [*b.schema.names, "_keep_v", "_keep_n"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_keep_v", T.LongType()), T.StructField("_keep_n", T.LongType())])
    named = docs.mapInArrow(name, schema).withColumn("_keep_id", text_id())
    met = named.join(keep.withColumn("_keep", F.lit(True)), ["_keep_id", "_keep_v"], "left").where(F.col("_keep") | (F.col("_keep_n") == 0))
    met = met.withColumn("_keep_row", F.when(F.col("_keep_n") == 0, F.monotonically_increasing_id()))
    return met.dropDuplicates(["_keep_id", "_keep_v", "_keep_row"]).select(*docs.columns)
