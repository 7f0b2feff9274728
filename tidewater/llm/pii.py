"""Personal data: fixed patterns, and terms that give protected values away.

Protected entities are the values that the patterns find (an address, a number) and what several values share and one party
holds: an email domain, the start of a phone number, a network, a card's issuer. Over the whole corpus, the terms of the
documents that name an entity are counted with it, wherever they stand. A term discloses an entity when knowing the term
removes most of what was unknown: PMI(term, entity) / IC(entity) >= ``DISCLOSURE``, where IC(entity) = -log p(entity) and
PMI = log p(entity | term) - log p(entity), in documents. Copies say nothing new, so at least ``SUPPORT`` documents
that are not near copies of each other must hold the pair; and a rare term may meet a common entity by chance, so a
pair counts only where under ``MISTAKES`` such pairs are to be expected among all terms and entities. Disclosing terms are marked
everywhere, and generalised or removed.

Edge cases: null text is empty; spans are in code points, end exclusive; a term that touches a pattern's span
is not marked again; an empty corpus discloses nothing; null or repeated ids only repeat rows (documents
are counted by row). Documents of very many entities are bounded by their classes (see ``disclosing_terms``).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run is tried from its start only: what fails there fails further in too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")

DISCLOSURE = 0.9
SUPPORT = 3
ALIKE = 0.5  # documents that share more than this part of their terms and pairs of neighbouring terms are near copies
MARKS = 64  # hashes kept of a document to compare it
MISTAKES = 0.05  # pairs of a term and an entity expected by chance, at most
SENT_TERMS = 200_000  # up to so many disclosing terms are sent to every task; more meet their texts by a shuffle
SALTS = 16  # parts of the rows of one entity, or of one text

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, but each run of characters before an @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _outside(text: str, spans: list[Span]) -> list[str]:
    """The text's terms in order, but those that touch a span."""
    taken = sorted((a, b) for _, a, b in spans)
    out, i = [], 0
    for m in TERM.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            out.append(m[0].lower())
    return out


def entities_of(text: str, spans: list[Span]) -> set[tuple[str, str]]:
    """(kind, value) of the values in a text, and of what values of one party share."""
    out = set()
    for kind, a, b in spans:
        if kind == "email":
            value = text[a:b].lower()
            shared = value.rpartition("@")[2]
        else:
            value = re.sub(r"[^0-9.+]", "", text[a:b])
            shared = ".".join(value.split(".")[:2]) if kind == "ip" else value[: 6 if kind == "card" else 5]
        out |= {(kind, value), (f"{kind} of", shared)}
    return out


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that name entities: equal terms in order have equal places; marks are the smallest hashes of terms and pairs of neighbours."""
    for b in batches:
        rows = []
        for row, text in zip(b["row"], b["text"], strict=True):
            spans = base_spans(text) if text else []
            terms = _outside(text, spans) if spans else []
            if terms:
                marks = heapq.nsmallest(MARKS, {*map(_key, terms), *map(_key, terms, terms[1:])})
                rows.append((row, sorted(_key(*e) for e in entities_of(text, spans)), _key(*terms), marks, sorted({*terms})))
        yield pd.DataFrame(rows, columns=["row", "entities", "place", "marks", "terms"])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each term with the documents of the batch that hold it."""
    for b in batches:
        n: Counter[str] = Counter()
        for t in b["text"]:
            n.update({w.lower() for w in TERM.findall(t)} if t else ())
        yield pd.DataFrame({"term": pd.Series(list(n), dtype=object), "docs": pd.Series(list(n.values()), dtype="int64")})


def _shared(a: str, b: str) -> Column:
    """The part that two sets share, 2|a and b| / (|a| + |b|), from their smallest hashes; exact under ``MARKS`` of them."""
    both, full = F.array_sort(F.array_union(a, b)), (F.size(a) >= MARKS) | (F.size(b) >= MARKS)
    seen = F.when(full, F.slice(both, 1, MARKS)).otherwise(both)  # the smallest of the union are known in both
    j = F.size(F.array_intersect(F.array_intersect(a, b), seen)) / F.size(seen)
    return 2 * j / (1 + j)


def _varied(held: DataFrame, marks: DataFrame, support: int) -> DataFrame:
    """(entity, term) of ``held`` (entity, term, place) with at least ``support`` places that are not near copies. ``marks``: (place, marks).

    A pair's leader is its first place; places like it are dropped, and the first of the rest is the next leader. The rows are
    narrow: each place is compared once with each of its leaders, however many terms they share.
    """
    marks = materialize(marks.join(held.select("place").distinct(), "place", "left_semi").dropDuplicates(["place"]), "pii-marks")
    rounds = [held]
    for _ in range(support - 1):
        each = rounds[-1]
        leader = each.groupBy("entity", "term").agg(F.min("place").alias("leader"))
        each = materialize(each.join(leader, ["entity", "term"]), "pii-led")
        met = each.select("place", "leader").distinct().join(marks, "place")
        met = met.join(marks.select(F.col("place").alias("leader"), F.col("marks").alias("lead_marks")), "leader")
        alike = materialize(met.where(_shared("marks", "lead_marks") > ALIKE).select("place", "leader"), "pii-alike")
        rounds.append(materialize(each.join(alike, ["place", "leader"], "left_anti").drop("leader"), "pii-varied"))
        discard(each, alike)
    out = materialize(rounds[-1].select("entity", "term").distinct(), "pii-varied")
    discard(marks, *rounds[1:])
    return out


def _chance(both: Column, term_docs: Column, share: Column) -> Column:
    """Log of an upper bound (Chernoff's) of the chance that so many of a term's documents name an entity that this share of all name."""
    p = both / term_docs
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return F.when(p > share, -term_docs * (p * F.log(p / share) + rest)).otherwise(0.0)


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, mistakes: float = MISTAKES) -> DataFrame:
    """(term, degree): terms whose strongest disclosure of any entity reaches the threshold, from the whole corpus.

    Entities that the same documents name are one class: they have the same counts with every term. A class of k documents is counted only with terms of
    ``support`` to k * (n / k) ** (1 - disclosure) documents, as others cannot reach the threshold. So a document of thousands of addresses
    that its copies share is one class, common words meet common entities only, and most terms meet none.

    ``docs`` is read twice: it should be a stored table.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    named = texts.withColumn("row", F.monotonically_increasing_id()).mapInPandas(_contexts, "row long, entities array<long>, place long, marks array<long>, terms array<string>")
    named = materialize(named, "pii-named")
    counts = texts.mapInPandas(_counted, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("term_docs"))
    counts = materialize(counts.withColumn("key", F.xxhash64("term")), "pii-terms")
    n = F.lit(float(max(docs.count(), 2)))
    share = F.least(F.col("entity_docs").cast("double"), n - 0.5) / n

    each = named.select("row", "place", F.explode("entities").alias("entity"))
    rows = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))  # noqa: E731  names the set of an entity's documents
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"), F.count_distinct("place").alias("places"), rows(1).alias("x"), rows(2).alias("y")).where(F.col("places") >= support)
    entities = materialize(entities.select("entity", "entity_docs", "x", "y"), "pii-counts")
    tried = float(max(counts.count(), 1) * max(entities.count(), 1))
    classes = entities.groupBy("entity_docs", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "entity_docs")
    # an entity may be in a third of all rows: they are dealt to SALTS tasks
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, ["entity", "salt"])
    each = materialize(each.select("row", "place", "entity", "entity_docs", (F.col("entity_docs") * share ** (disclosure - 1) * (1 + 1e-9)).alias("most")), "pii-entities")

    held = named.join(each.groupBy("row").agg(F.max("most").alias("most")), "row").select("row", "most", F.explode("terms").alias("term"))
    held = held.join(counts.where(F.col("term_docs") >= support), "term").where(F.col("term_docs") <= F.col("most"))
    held = materialize(held.select("row", "key", "term_docs"), "pii-held-terms")
    pairs = each.select("row", "entity", "entity_docs", "most").join(held, "row").where(F.col("term_docs") <= F.col("most"))
    pairs = pairs.groupBy("entity", "key", "entity_docs", "term_docs").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    degree = 1 + F.log(F.col("both") / F.col("term_docs")) / -F.log(share)
    pairs = pairs.withColumn("degree", degree).where(F.col("degree") >= disclosure)
    pairs = pairs.where(_chance(F.col("both"), F.col("term_docs"), share) + F.log(F.lit(tried)) <= F.log(F.lit(mistakes)))
    pairs = materialize(pairs.select("entity", "key", "degree"), "pii-pairs")
    if pairs.isEmpty():
        discard(named, counts, entities, each, held, pairs)
        return docs.sparkSession.createDataFrame([], "term string, degree double")
    places = each.select("row", "place", "entity").join(pairs.select("entity", "key"), "entity").join(held.select("row", "key"), ["row", "key"])
    places = materialize(places.select("entity", F.col("key").alias("term"), "place").distinct(), "pii-held")
    varied = _varied(places, named.select("place", "marks"), support).withColumnRenamed("term", "key")
    found = pairs.join(varied, ["entity", "key"], "left_semi").groupBy("key").agg(F.max("degree").alias("degree"))
    out = materialize(found.join(counts.select("key", "term"), "key").select("term", "degree"), "pii-disclosing")
    discard(named, counts, entities, each, held, pairs, places)
    return out


def _marked(text: str | None, terms: dict[str, float]) -> tuple:
    """Numbers by kind, base spans and terms' spans, the number of terms, their highest degree and the number of entities of one text, in one walk over both."""
    text = text or ""
    base = base_spans(text)
    more: list[Span] = []
    degree = None
    if terms and text:
        busy, i = sorted((a, b) for _, a, b in base), 0
        for m in TERM.finditer(text):
            while i < len(busy) and busy[i][1] <= m.start():
                i += 1
            if (d := terms.get(m[0].lower())) is not None and (i == len(busy) or busy[i][0] >= m.end()):
                more.append(("term", *m.span()))
                degree = d if degree is None else max(d, degree)
    return *(sum(k == kind for k, _, _ in base) for kind in KINDS), joined(base), joined(base + more), len(more), degree, len(entities_of(text, base))


MADE = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_term", "degree", "n_entity")
MARKED = T.StructType([T.StructField(c, T.StringType() if "spans" in c else T.DoubleType() if c == "degree" else T.LongType()) for c in MADE])


def find(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_spans, spans (those and the terms'), n_term, and what stands behind them: degree (the highest of its terms; null without any) and n_entity (protected entities it names)."""
    bounded_batches(docs.sparkSession)
    terms = (disclosing_terms(docs) if terms is None else terms).groupBy("term").agg(F.max("degree").alias("degree"))
    out = docs.drop(*MADE)
    given = out.columns
    first = terms.limit(SENT_TERMS + 1).collect()
    if len(first) <= SENT_TERMS:
        known = docs.sparkSession.sparkContext.broadcast({r.term: r.degree for r in first})

        @F.pandas_udf(MARKED)
        def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield _frame([_marked(t, known.value) for t in texts])

        out = out.withColumn("_pii", mark(F.col("text")))
    else:
        out = _with_own_terms(out, terms).withColumn("_pii", _mark_own("text", "_pii_terms", "_pii_degrees")).drop("_pii_terms", "_pii_degrees")
    return out.select(*given, *(F.col(f"_pii.{c}").alias(c) for c in MADE))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(MADE))
    return out.assign(degree=out["degree"].astype("float64"))


@F.pandas_udf(MARKED)
def _mark_own(texts: pd.Series, terms: pd.Series, degrees: pd.Series) -> pd.DataFrame:
    return _frame([_marked(t, {} if own is None else dict(zip(own, d, strict=True))) for t, own, d in zip(texts, terms, degrees, strict=True)])


def _with_own_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` with ``_pii_terms`` and ``_pii_degrees``, the disclosing terms that the text holds, brought to it by a shuffle. Copies of one text are dealt to SALTS tasks."""
    key = F.sha2("text", 256)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, w) for k, t in zip(b["key"], b["text"], strict=True) for w in ({x.lower() for x in TERM.findall(t)} if t else ())]
            yield pd.DataFrame(rows, columns=["key", "term"])

    hits = docs.select(key.alias("key"), "text").mapInPandas(explode, "key string, term string").join(terms, "term")
    hits = hits.groupBy("key").agg(F.collect_set(F.struct("term", "degree")).alias("hits")).select("key", F.col("hits.term").alias("_pii_terms"), F.col("hits.degree").alias("_pii_degrees"))
    hits = hits.withColumn("_pii_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))).withColumnRenamed("key", "_pii_key")
    other = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    docs = docs.withColumns({"_pii_key": key, "_pii_salt": F.pmod(F.xxhash64(*other), F.lit(SALTS))})
    return docs.join(hits, ["_pii_key", "_pii_salt"], "left").drop("_pii_key", "_pii_salt")


def _replace(text: str, spans: str, generalise: bool) -> str:
    out, at = [], 0
    for k, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{k.upper()}]" if generalise else ""]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, terms: DataFrame | None = None, generalise: bool = True) -> DataFrame:
    """``docs`` as from ``find``, with the text's spans generalised to their kind (or removed)."""

    def swap(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _replace(t, s, generalise) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return find(docs, terms).withColumn("text", F.pandas_udf(swap, "string")("text", "spans"))
