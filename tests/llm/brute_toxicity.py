"""Class-conditional Kneser-Ney models by plain dictionaries, for tests."""

import re
from collections import Counter, defaultdict

from tidewater.llm import toxicity

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
END = b" "


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


class Brute:
    """Probabilities by class (1 toxic, 0 ordinary) of a word after a word, of a word's spelling, of a byte after bytes of a word."""

    def __init__(self, texts, labels, discounts):
        self.discounts = discounts
        three = {c: set() for c in (0, 1)}
        for t, y in zip(texts, labels):
            ws = [None, None, *words_of(t)]
            three[y] |= {(ws[i - 2], ws[i - 1], ws[i]) for i in range(2, len(ws))}
        self.pair = {c: Counter((h, w) for _, h, w in three[c]) for c in (0, 1)}
        self.word = {c: Counter(w for _, w in self.pair[c]) for c in (0, 1)}
        self.run = {c: Counter() for c in (0, 1)}
        for c in (0, 1):
            for w, n in self.word[c].items():
                for i in range(len(w) + 1):
                    self.run[c][(w + END)[max(0, i - toxicity.ORDER + 1) : i + 1]] += n
        # below the highest order: different bytes before, or plain counts of runs from a word's start
        both = self.run[0] + self.run[1]
        self.starts, self.lower = set(), []
        starting = {(w + END)[: i + 1] for c in (0, 1) for w in self.word[c] for i in range(len(w) + 1) if i + 1 < toxicity.ORDER}
        for order in range(1, toxicity.ORDER):
            plain, kinds = Counter(), defaultdict(set)
            for r, n in both.items():
                if len(r) < order:
                    plain[r] += n
                else:
                    kinds[r[-order:]].add(r[-order - 1 : -order] if len(r) > order else None)
            self.lower.append((plain, {k: len(v) for k, v in kinds.items()}))

    def _mixed(self, counts, discount, key, rest):
        """counts: of this context's continuations; nothing counted passes everything on."""
        n = sum(counts.values())
        if not n:
            return rest
        return (max(counts.get(key, 0) - discount, 0) + sum(min(discount, x) for x in counts.values()) * rest) / n

    def byte(self, c, before, x):
        """Of byte x after all bytes before it in the word."""
        p = 1 / 256
        run = (before + x)[-toxicity.ORDER :]
        for order, (plain, kinds) in enumerate(self.lower, 1):
            short = run[-order:]
            table = plain if len(run) < order else kinds
            p = self._mixed({k[-1:]: n for k, n in table.items() if k[:-1] == short[:-1] and len(k) == len(short)}, toxicity.DISCOUNT, x, p)
        return self._mixed({k[-1:]: n for k, n in self.run[c].items() if k[:-1] == run[:-1]}, self.discounts.run, x, p)

    def spelling(self, c, w):
        p = 1.0
        for i in range(len(w) + 1):
            p *= self.byte(c, w[:i], (w + END)[i : i + 1])
        return p

    def alone(self, c, w):
        return self._mixed(self.word[c], self.discounts.word, w, self.spelling(c, w))

    def after(self, c, h, w):
        return self._mixed({x: n for (a, x), n in self.pair[c].items() if a == h}, self.discounts.pair, w, self.alone(c, w))
