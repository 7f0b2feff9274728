"""Katz backoff by plain dictionaries, for tests."""

from collections import Counter, defaultdict
from math import log10
import re
import zlib

from tidewater.llm.katz import BIG, TOP, good_turing

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs):
    """docs: list of (doc_id, text); rows as the query gives them."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seq = [(i, WORD.findall(lower(t or "")) + [None]) for i, t in docs]
    c, pair = Counter(), Counter()
    n_docs = 0
    for i, ws in seq:
        if not held(i):
            n_docs += 1
            c.update(ws)
            pair.update(zip(["<s>", *ws[:-1]], ws))
    hist = Counter()
    follow = defaultdict(list)
    for (h, w), r in pair.items():
        hist[h] += r
        follow[h].append(w)
    tally = lambda x: np.bincount(np.minimum(np.array(list(x.values()), int), TOP + 2), minlength=TOP + 3) if x else np.zeros(TOP + 3, int)
    dw, dp = good_turing(tally(c)), good_turing(tally(pair))
    disc = lambda d, r: d[r - 1] if r <= TOP else BIG
    total, kinds = sum(c.values()), len(c)
    unknown = sum((1 - disc(dw, x)) * x for x in c.values()) / total if total else 1.0
    p1 = lambda w: disc(dw, c[w]) * c[w] / total if c[w] else unknown
    alpha = {}

    def p2(h, w):
        if not hist[h]:
            return p1(w)
        if r := pair[h, w]:
            return disc(dp, r) * r / hist[h]
        if h not in alpha:
            alpha[h] = (1 - sum(disc(dp, pair[h, x]) * pair[h, x] for x in follow[h]) / hist[h]) / (1 - sum(p1(x) for x in follow[h]))
        return alpha[h] * p1(w)

    out = []
    for i, ws in seq:
        base = sum(log10((c[w] + 1) / (total + kinds + 1)) for w in ws)
        own = list(zip(["<s>", *ws[:-1]], ws))
        score = sum(log10(p2(h, w)) for h, w in own)
        new = sum(pair[x] <= (not held(i)) for x in own) / len(ws)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), total, base, score, sum(not pair[x] for x in own), new))
    return out, p2, c


def brute_order(texts, order):
    """P(w | history) of a model of any order, by recursion over dictionaries; history: a tuple of words, None at the start."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        ws = ["<s>"] * (order - 1) + WORD.findall(lower(t or "")) + [None]
        for i in range(order - 1, len(ws)):
            for n in range(1, order + 1):
                counts[n][tuple(ws[i - n + 1 : i + 1])] += 1
    tally = lambda x: np.bincount(np.minimum(np.array(list(x.values()), int), TOP + 2), minlength=TOP + 3) if x else np.zeros(TOP + 3, int)
    discount = [None] + [good_turing(tally(c)) for c in counts[1:]]
    kept = lambda n, r: (discount[n][r - 1] if r <= TOP else BIG) * r
    total = sum(counts[1].values())
    unknown = sum(r - kept(1, r) for r in counts[1].values()) / total if total else 1.0
    follow = defaultdict(list)
    for n in range(2, order + 1):
        for g in counts[n]:
            follow[g[:-1]].append(g[-1])

    def p(h, w):
        n = len(h) + 1
        r = counts[n].get((*h, w), 0)
        if n == 1:
            return kept(1, r) / total if r else unknown
        seen = follow.get(h, ())
        c = sum(counts[n][(*h, x)] for x in seen)
        if not c:
            return p(h[1:], w)
        if r:
            return kept(n, r) / c
        return (1 - sum(kept(n, counts[n][(*h, x)]) for x in seen) / c) / (1 - sum(p(h[1:], x) for x in seen)) * p(h[1:], w)

    def score(text):
        ws = ["<s>"] * (order - 1) + WORD.findall(lower(text or "")) + [None]
        return len(ws) - order + 1, sum(log10(p(tuple(ws[i - order + 1 : i]), ws[i])) for i in range(order - 1, len(ws)))

    return p, score, [w for (w,) in counts[1]]
