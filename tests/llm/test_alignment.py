"""Alignment against byte sets, and the JSON tokenizer itself."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.TOKENIZERS), reason="tokenizers are not here")
SCHEMA = "doc_id long, text string, row string, id string, pairs string"
ODD = [
    None, "", " ", "  leading and trailing  ", "\n\n\ttabs\r\n", "a", "word", "<|endoftext|> and <s> </s> <unk> <0x41>", "under▁score", "naïve café – “quotes” … 日本語 한국어 😀👍🏽 ‍", "\x00\x01 nul", "é combining",
    "ab" * 3000, "1234567890" * 50, "it's we'll they've I'D can'T", "a b　c d", "﻿bom �", "x" + " " * 500 + "y", "\U000e0001\U0010ffff", "don't  stop   now", "فارسی עברית हिन्दी",
]


@pytest.fixture(scope="module")
def models():
    return alignment.tokenizers()


def prose(seed, n):
    rng = random.Random(seed)
    words = ["data", "stream", "Tokenizer", "whether", "und", "größer", "l'été", "x9", "merge-path", "antidisestablishment", "\n", "42", "the", "of", ";"]
    return " ".join(rng.choice(words) for _ in range(n))


def brute(rows, models, hf):
    """Digest columns by sets of byte offsets; A by the JSON file's own library."""
    parts = []
    for i, t in rows:
        a = b = []
        if t:
            a = hf.encode(" " + t, add_special_tokens=False).ids
            b = models.b.encode(t)
            want = (" " + t).encode()
            if b"".join(models.a_bytes[x] for x in a) != want or b"".join(models.b_bytes[x] for x in b) != want:
                a = b = []
        ends = []
        for ids, of in ((a, models.a_bytes), (b, models.b_bytes)):
            pos, out = 0, []
            for x in ids:
                pos += len(of[x])
                out.append(pos)
            ends.append(out)
        common = set(ends[0]) & set(ends[1])
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y in [dict(zip(ends[1], b, strict=True)).get(e)] if e in common]
        groups = [[[], []] for _ in common]
        rank = sorted(common)
        for k, ids in enumerate((a, b)):
            for x, e in zip(ids, ends[k], strict=True):
                groups[next(g for g, c in enumerate(rank) if e <= c)][k].append(str(x))
        text = ";".join(",".join(g[0]) + "|" + ",".join(g[1]) for g in groups)
        parts.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    count = Counter(x for p in parts for x in p[4])
    most = Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    return [(i, na, nb, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha) for i, na, nb, g, links, sha in parts]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTE_BPE}")
    t.encode_special_tokens = True
    return t


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def result(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_scores_against_brute_force(spark, models, hf):
    rows = list(enumerate(ODD)) + [(100 + i, prose(i, 40)) for i in range(12)] + [(None, "null id"), (None, None), (3, "again"), (3, "again"), (200, prose(99, 1500))]
    want = sorted(brute(rows, models, hf), key=str)
    assert sum(w[1] > 0 for w in want) >= 25 and sum(w[1] == 0 for w in want) >= 4
    df = table(spark, rows).repartition(3)
    assert result(alignment.scores(df, models)) == want
    assert result(alignment.scores(df, models, piece=7)) == want  # many pieces, ends cut between A's and B's
    assert result(alignment.scores(df, models, sent_pairs=0)) == want  # counts met by a shuffle


def test_encodes_as_the_json_file_does(models, hf):
    rng = random.Random(4)
    ranges = [(32, 127), (160, 0x250), (0x370, 0x600), (0x900, 0xE00), (0x2000, 0x2C00), (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F700), (9, 14)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    texts += [t for t in ODD if t]
    for t in texts:
        assert models.a.encode_ordinary(" " + t) == hf.encode(" " + t, add_special_tokens=False).ids


def test_empty_table(spark, models):
    assert result(alignment.scores(table(spark, []), models)) == []
    assert result(alignment.scores(table(spark, []), models, sent_pairs=-1)) == []
    assert result(alignment.scores(table(spark, [(1, None), (2, "")]), models)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_of_any_size_merge_alike():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = (np.cumsum(rng.integers(1, 6, rng.integers(1, 60))) for _ in range(2))
        want = [(e, int(np.searchsorted(a, e)), int(np.searchsorted(b, e)), e in a and e in b) for e in sorted({*a.tolist(), *b.tolist()})]
        for piece in (1, 2, 3, 10, 1000):
            end, at, bt, both = alignment.overlaps(a, b, piece)
            assert list(zip(end.tolist(), at.tolist(), bt.tolist(), both.tolist(), strict=True)) == want
            i, j = alignment.diagonals(a, b, piece)
            assert (np.diff(i + j) <= piece).all() and i[-1] + j[-1] == len(a) + len(b)
    assert all(len(x) == 0 for x in alignment.overlaps(np.empty(0, np.int64), np.empty(0, np.int64)))


def test_alignments_give_overlaps_and_groups(spark, models):
    texts = ["antidisestablishment größer", "", "the data", None, "naïve 😀"]
    got = {r.id: r for r in alignment.alignments(table(spark, list(enumerate(texts))), models, piece=4).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        (a, b), whole = models.encode([t])[0], (" " + (t or "")).encode()
        assert (list(r.a_ids), list(r.b_ids)) == (a, b)
        if not t:
            assert not r.overlaps and not r.groups
            continue
        assert [o.start for o in r.overlaps] == [0, *(o.end for o in r.overlaps)][:-1] and r.overlaps[-1].end == len(whole)
        for o in r.overlaps:  # both tokens share the bytes
            a0 = sum(len(models.a_bytes[x]) for x in a[: o.a])
            b0 = sum(len(models.b_bytes[x]) for x in b[: o.b])
            assert max(a0, b0) == o.start and min(a0 + len(models.a_bytes[a[o.a]]), b0 + len(models.b_bytes[b[o.b]])) == o.end
        assert (r.groups[0].a_start, r.groups[0].b_start) == (0, 0) and (r.groups[-1].a_end, r.groups[-1].b_end) == (len(a), len(b))
        for g in r.groups:
            assert b"".join(models.a_bytes[x] for x in a[g.a_start : g.a_end]) == b"".join(models.b_bytes[x] for x in b[g.b_start : g.b_end]) == whole[g.start : g.end]
