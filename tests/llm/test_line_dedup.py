"""Line dedup against a plain dictionary of lines."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidewater.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, key string, id string"
WHITE = " \t\n\x0b\x0c\r"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, chars=40, documents=5):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[lowered(line.strip(WHITE))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            k = lowered(line.strip(WHITE))
            ids = holders[k]
            gone = len(k) >= chars and len(ids) >= documents and i != max(x for x in ids if x is not None)
            if not gone:
                keep.append(line)
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def check(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    out = line_dedup.deduplicated(df.repartition(parts) if rows else df, **kw)
    assert out.columns == ["doc_id", "text", "key", "id", "n_lines", "n_dropped"]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


LONG = "a line of more than forty code points, number {} of the lot"


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(12)):
            line = LONG.format(rng.randrange(25)) if rng.random() < 0.6 else LONG.format(rng.random())
            line = line.upper() if rng.random() < 0.3 else line
            lines.append(rng.choice(["", " ", "\t", "\r"]) + line + rng.choice(["", "  ", "\x0b\r"]) if rng.random() < 0.8 else rng.choice(["", "short", "  "]))
        out.append((i if rng.random() < 0.9 else rng.choice([None, 3, 5]), "\n".join(lines) if lines or rng.random() < 0.5 else None))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_a_dictionary(spark, seed):
    rows = corpus(seed)
    got = check(spark, rows)
    assert sum(r[3] for r in got) > 20


def test_keys_that_are_not_sent_meet_documents_by_a_shuffle(spark):
    rows = corpus(7)
    assert check(spark, rows) == check(spark, rows, sent_keys=0)


def test_more_segments_and_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(8)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    check(spark, rows, 5, segment_lines=4)


def test_edges(spark):
    line = LONG.format(1)
    check(spark, [])
    check(spark, [(1, None), (2, ""), (None, None)])
    check(spark, [(i, "\n") for i in range(6)])
    check(spark, [(i, line) for i in range(4)])  # four documents are too few
    assert sum(r[3] for r in check(spark, [(i, line) for i in range(5)])) == 4
    check(spark, [(7, line)] * 6)  # one id is one document
    check(spark, [(None, line)] * 6)
    check(spark, [(None, line)] * 3 + [(i, line + "\n" + line) for i in range(4)])  # null is the fifth document; repeats in one stay together
    check(spark, [(i, "x" * 39) for i in range(6)] + [(i, "é" * 40 + "\n" + "É" * 40) for i in range(6)])
    check(spark, [(i, (line + " " + str(i)) * 5000 + "\n" + line) for i in range(6)])  # very long lines
    check(spark, [(0, "\n".join([line] * 3000))] + [(i, line.upper()) for i in range(1, 6)])


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    blocks = [np.unique(rng.integers(0, 5000, 300).astype(np.uint32)) for _ in range(40)]
    filters = line_dedup.Filters(sum(map(len, blocks)))
    for b in blocks:
        filters.add(b)
    value, times = np.unique(np.concatenate(blocks), return_counts=True)
    assert filters.suspects(value[times > 1]).all()
    few = line_dedup.Filters(100_000)
    lone = rng.permutation(1 << 20)[:100_000].astype(np.uint32)
    for part in np.split(lone, 20):
        few.add(part)
    assert few.suspects(lone).mean() < 0.02  # lines seen once are seldom suspected
    few = line_dedup.Filters(10)
    few.add(np.array([5, 5, 6], np.uint32))  # twice in one block
    assert few.suspects(np.array([5, 6], np.uint32)).tolist() == [True, False]


def test_only_suspected_lines_are_shuffled_by_key(spark):
    rows = [(i, "\n".join(LONG.format(f"{i} {j}") for j in range(50))) for i in range(100)] + [(i, LONG.format(1)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.suspects(df)
    assert 6 <= found.count() < 300  # of 5006
