"""Operators on single texts: personal data, HTML, URLs, tiling, fingerprints, toxicity."""

import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute_toxicity import Brute, words_of
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, html_text, pii, spotsigs, toxicity, url_filter, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, toxicity string, _row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOCS)


EDGES = [(None, None), (None, ""), (1, ""), (1, ""), (2, "word"), (2, "word"), (3, " \n\t "), (4, "a " * 50000), (5, "é" * 3000 + " " + "x" * 70000), (6, None)]


# words


def test_words_are_hashed_alike():
    texts = ["Ab cD\x0bab", None, "", "  ", "ab", "cd é É " + "x" * 3000, "\u00a0ab"]
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    seen, back = {}, {}
    for size in (1, 8, 1 << 20):
        for arrow in (pa.string(), pa.large_string()):
            got = [[] for _ in texts]
            for lo, hi, h, first in words.pieces(pa.array([None, *texts], arrow).slice(1), size=size):
                for r in range(lo, hi):
                    got[r] = h[first[r - lo] : first[r - lo + 1]].tolist()
            for t, h in zip(texts, got, strict=True):
                ws = pattern.findall(lower(t or ""))
                assert len(ws) == len(h)
                for w, x in zip(ws, h, strict=True):
                    assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


# op1

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    luhn = lambda d: sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for alphabet in ("a1.@-_+ ()é4", "012 .-", "@a.b", "+12() 3"):
        for _ in range(4000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(s) == brute_spans(s), s
    assert pii.base_spans("card 4111 1111-1111 1111, a@b.co")[0][0] == "email"
    assert pii.base_spans("1" * 100000 + " " + "a" * 100000 + "@") == []


def test_disclosing_terms(spark):
    rng = random.Random(1)
    filler = [a + b + c for a in ("ka", "lo", "mi", "ter", "su") for b in ("ren", "sto", "na", "li") for c in ("vor", "da", "pel", "ock")]
    say = lambda: " ".join(rng.choice(filler) for _ in range(6))
    rows = [(i, f"{say()} zorbulon {say()} kim@corp.example {say()}") for i in range(6)]
    rows += [(100 + i, say()) for i in range(200)] + [(400 + i, "unique copy text quibblex mail ann@corp.example stays") for i in range(9)]
    near = "a long text of which there are near copies only and glimmerk next to joe@corp.example as all of them have it".split()
    rows += [(450 + i, " ".join(w if j != i else say() for j, w in enumerate(near))) for i in range(9)]
    rows += [(500, "here is zorbulon alone"), *EDGES]
    df = docs(spark, rows)
    assert [r.term for r in pii.disclosing_terms(df).collect()] == ["zorbulon"]  # copies say nothing about quibblex, nor near copies about glimmerk
    found = {r.doc_id: r for r in pii.find(df).collect() if r.doc_id is not None}
    assert found[500].spans == "term:8:16" and found[500].n_term == 1
    assert found[0].base_spans.startswith("email:") and found[0].spans.startswith(found[0].base_spans + ",term:")
    assert found[100].spans == "" and found[1].n_email == 0 or found[1].spans is not None
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[500] == "here is [TERM] alone" and "[EMAIL]" in clean[0] and clean[6] is None
    gone = {r.doc_id: r.text for r in pii.sanitise(df, generalise=False).collect()}
    assert gone[500] == "here is  alone"
    assert pii.find(docs(spark, [])).count() == 0
    assert pii.find(df).count() == len(rows)


def test_near_copies_do_not_hide_other_surroundings(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    near = [word() for _ in range(20)]
    rows = [(i, " ".join([*near[:10], "bob@corp.example", *near[10:]]).replace(near[i % 20], word())) for i in range(100)]
    rows += [(100 + i, " ".join([*(word() for _ in range(6)), "zorbulon", "bob@corp.example", *(word() for _ in range(8))])) for i in range(20)]
    rows += [(200 + i, " ".join(word() for _ in range(12))) for i in range(400)] + [(900, "here is zorbulon alone")]
    assert [r.term for r in pii.disclosing_terms(docs(spark, rows)).collect()] == ["zorbulon"]


def test_one_long_document_discloses_nothing(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    said = lambda *at: " ".join([*(word() for _ in range(8)), *at, *(word() for _ in range(9))])
    archive = " ".join(said("zorbulon", "pat@corp.example") if i % 2 else said("pat@corp.example") for i in range(50))
    rows = [(1, archive)] + [(10 + i, said("zorbulon")) for i in range(20)] + [(100 + i, said()) for i in range(400)]
    assert pii.disclosing_terms(docs(spark, rows)).collect() == []
    rows += [(1, said("glimmerk", "lee@corp.example")) for i in range(3)]  # repeated ids are documents of their own
    assert [r.term for r in pii.disclosing_terms(docs(spark, rows)).collect()] == ["glimmerk"]


def test_terms_far_from_the_value_count(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    said = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"zorbulon {said(200)} please write to us at our usual mail address moe@corp.example any time of the day") for i in range(6)]
    rows += [(100 + i, said(20) + " please write to us at our usual mail address any time of the day") for i in range(100)] + [(300, "here is zorbulon alone")]
    assert [r.term for r in pii.disclosing_terms(docs(spark, rows)).collect()] == ["zorbulon"]


def test_shared_part_of_terms(spark):
    rng = random.Random(8)
    pick = lambda n: sorted(rng.sample(range(-1000, 1000), n))
    rows = [(sorted({*c, *pick(rng.randint(0, 20))}), sorted({*c, *pick(rng.randint(1, 20))})) for c in (pick(rng.randint(0, 20)) for _ in range(50))]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", pii._shared("a", "b").alias("s")).collect()
    assert all(r.s == pytest.approx(2 * len({*r.a} & {*r.b}) / (len(r.a) + len(r.b))) for r in got)


@pytest.mark.parametrize("sent", [0, 100])
def test_terms_meet_their_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "SENT_TERMS", sent)
    terms = spark.createDataFrame([("bbb", 0.91), ("aaa", 0.92), ("ccc", 0.95), ("ccc", 0.9)], "term string, degree double")
    df = docs(spark, [(11, "ccc aaa x bbb aaa"), (12, "Aaa a@b.co"), *EDGES])
    got = {r.doc_id: r for r in pii.find(df, terms).collect()}
    assert got[11].spans == "term:0:3,term:4:7,term:10:13,term:14:17" and (got[11].n_term, got[11].degree, got[11].n_entity) == (4, 0.95, 0)
    assert (got[12].degree, got[12].n_entity, got[6].degree, got[6].n_entity) == (0.92, 2, None, 0)
    assert got[12].spans == "email:4:10,term:0:3" and got[12].base_spans == "email:4:10" and got[6].spans == ""
    assert pii.find(df, terms).count() == 2 + len(EDGES) and pii.find(df, terms).columns[: len(df.columns)] == df.columns


def brute_disclosing(texts, disclosure=0.9, support=3, mistakes=0.05):
    """Degrees of terms by counting over all pairs of a term and an entity."""
    n, held, named, seen = max(len(texts), 2), {}, {}, {}
    for i, t in enumerate(texts):
        spans = pii.base_spans(t)
        for w in {w.lower() for w in pii.TERM.findall(t)}:
            held.setdefault(w, set()).add(i)
        outside = [m[0].lower() for m in pii.TERM.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        if spans and outside:
            seen[i] = (pii._key(*outside), set(outside) | set(zip(outside, outside[1:])), set(outside))
            for e in pii.entities_of(t, spans):
                named.setdefault(e, set()).add(i)
    named = {e: rows for e, rows in named.items() if len({seen[i][0] for i in rows}) >= support}
    out = {}
    for rows in named.values():
        p = min(len(rows), n - 0.5) / n
        for w in set().union(*(seen[i][2] for i in rows)):
            both, m = [i for i in rows if w in seen[i][2]], len(held[w])
            q = len(both) / m
            degree = 1 + math.log(q) / -math.log(p)
            chance = math.exp(-m * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))) if q > p else 1
            places = sorted({seen[i][0]: seen[i][1] for i in both}.items())
            groups = 0
            while places:  # the first place and all like it are one
                groups += 1
                lead = places[0][1]
                places = [x for x in places if 2 * len(x[1] & lead) / (len(x[1]) + len(lead)) <= 0.5]
            if len(both) >= support and degree >= disclosure and chance * len(held) * len(named) <= mistakes and groups >= support:
                out[w] = max(out.get(w, 0), degree)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_degrees_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 5))))
    parties = [("acme", lambda: f"{word()}@acme.example"), ("orb", lambda: f"+44 20 7{rng.randint(100, 999)} {rng.randint(1000, 9999)}"), ("netz", lambda: f"10.7.{rng.randint(0, 255)}.{rng.randint(0, 255)}"), ("pat", lambda: "pat@x.org")]
    texts = []
    for _ in range(250):
        ws = [word() for _ in range(rng.randint(4, 12))]
        if rng.random() < 0.3:
            name, value = rng.choice(parties)
            ws += [value(), name] if rng.random() < 0.9 else [value()]
        elif rng.random() < 0.02:
            ws.append(rng.choice(parties)[0])
        rng.shuffle(ws)
        texts += [" ".join(ws)] * rng.choice((1, 1, 1, 3))
    want = brute_disclosing(texts)
    got = {r.term: r.degree for r in pii.disclosing_terms(docs(spark, list(enumerate(texts)))).collect()}
    assert got == pytest.approx(want) and len(want) >= 2  # of one party each, though values differ
    marked = sum(r.n_term for r in pii.find(docs(spark, list(enumerate(texts)))).collect())
    assert marked >= sum(any(w in want for w in t.split()) for t in texts) > 0


def test_documents_of_many_shared_entities(spark):
    """Four texts that share thousands of addresses: time and rows follow their size, not its square."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))

    def took(n):
        shared = [f"p{i}@corp{i}.example" for i in range(n)]
        texts = [" ".join(x for a in shared for x in (a, word())) + " zorbulon" for _ in range(4)]
        texts += [word() for _ in range(300)]
        df = docs(spark, list(enumerate(texts)))
        began = time.perf_counter()
        assert {r.term for r in pii.disclosing_terms(df).collect()} == ({"zorbulon"} if n < 100 else set())  # among so many pairs it may be chance
        return time.perf_counter() - began

    took(50)
    assert took(5000) < 3 * took(1000) + 5


def test_time_grows_with_the_text():
    def took(n):
        text = " ".join(f"a{i}@b.co word" for i in range(n))
        began = time.perf_counter()
        assert pii._marked(text, {"word": 0.9})[-3:] == (n, 0.9, n + 1)
        assert len(pii._outside(text, pii.base_spans(text))) == n
        return time.perf_counter() - began

    took(2000)
    assert took(32000) < 8 * took(8000) + 0.05


# op2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("just <b>bold</b>\n text", "just bold text"), ("<div>" * 3000 + "deep", "deep"),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One,<br>two<p>Three &lt;3</article><footer>F</footer>", "T & U\nOne, two\nThree <3"),
        ("<header><h1>Site</h1></header><div class=cookie-notice>We use cookies, yes.</div><div id=content><p>Para one, with commas, and length.<p>Para two.</div><div class=sidebar><p>Side, side, side.</div><section id=comments><p>Great, great, great post of great length, really.</section>", "Para one, with commas, and length.\nPara two."),
        ("<main><article><section><p>A.</section><section><ul><li>one<li>two</ul></section></article><aside>no</aside></main>", "A.\none\ntwo"),
        ("<article><p>Cut <b>of", "Cut of"), ("<script>var a='<p>no</p>';</script><p>Yes</p><style>p{}</style>", "Yes"),
        ("<article><p>a</p><!-- <p>no</p> --><form><p>Sign</form><p>b&nbsp;c</article>", "a\nb c"),
        ("<article><h1>T</h1><p>One, two, three.<p class=share-price>Shares fell to nine.<p class='notice-period'>Three months.<p class=share-links><a href=x>Tweet</a><p class=notice>We use cookies.</article>", "T\nOne, two, three.\nShares fell to nine.\nThree months."),
        ("<article><p>Text, of some length, as it is.</p><h2>Sources</h2><ul><li><a href=a>Smith</a><li><a href=b>Jones</a><li><a href=c>Brown</a></ul></article><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Shop</a></ul>", "Text, of some length, as it is.\nSources\nSmith\nJones\nBrown"),
        ("<div id=content><div class=social-history><p>The guilds, the markets, and the roads of the town grew together for a long time.</div><p>Then, after the war, all of it was gone.</div><div class=social-icons-row><p>Like us, follow us, and tell all of your friends about it, please do, thank you.</div>", "The guilds, the markets, and the roads of the town grew together for a long time.\nThen, after the war, all of it was gone."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def random_page(rng, depth=0):
    """A tree of elements as (tag, class, children) and (leaf tag, text, linked text)."""
    words_ = lambda n: " ".join(rng.choice(("uno", "due,", "tre", "quattro,", "cinque")) for _ in range(n))
    if depth and (depth > 4 or rng.random() < 0.4):
        return (rng.choice(("p", "p", "p", "li", "h2")), words_(rng.randint(1, 60)), words_(rng.randint(1, 12)) if rng.random() < 0.3 else "")
    tag = rng.choice(("div", "div", "div", "section", "article", "ul", "table", "aside", "nav")) if depth else "body"
    return (tag, rng.choice(("", "", "x", "content", "sidebar")) if tag == "div" else "", [random_page(rng, depth + 1) for _ in range(rng.randint(1, 4))])


def as_html(x):
    if isinstance(x[2], str):
        return f"<{x[0]}>{x[1]}" + (f" <a href='y'>{x[2]}</a>" if x[2] else "") + f"</{x[0]}>"
    return f"<{x[0]} class='{x[1]}'>" + "".join(map(as_html, x[2])) + f"</{x[0]}>"


def brute_main_text(page):
    """Tree scoring as its words say, by walking every ancestor of every paragraph."""
    whole = lambda x: not isinstance(x[2], str) and (x[0] == "article" or any(map(whole, x[2])))
    dropped = lambda x: x[0] in ("aside", "nav") or x[0] == "div" and x[1] == "sidebar" and not whole(x)
    boxes, leaves = [("#root", "", ())], []  # (tag, class, path), (text, linked, tag, path)

    def read(x, path):
        if dropped(x):
            return
        if isinstance(x[2], str):
            leaves.append((" ".join(t for t in x[1:] if t), len(x[2]), x[0], path))
            boxes.append((x[0], "", path))
        else:
            boxes.append((x[0], x[1], path))
            for i, c in enumerate(x[2]):
                read(c, (*path, i))

    read(page, (0,))
    under = lambda leaf, path: leaf[3][: len(path)] == path
    size = lambda p: sum(len(b[0]) for b in leaves if under(b, p))
    link = lambda p: sum(b[1] for b in leaves if under(b, p))

    def score(box):
        tag, cls, path = box
        points = sum((1 + b[0].count(",") + min(len(b[0]) / 100, 3)) * (1 - b[1] / len(b[0])) / 2 ** (len(b[3]) - 1 - len(path)) for b in leaves if under(b, path) and len(b[3]) > len(path) and path)
        points += {"article": 40, "section": 3, "div": 3}.get(tag, 0) + 15 * (cls == "content") - (tag in ("#root", "body"))
        return points * (1 - link(path) / max(size(path), 1))

    if not leaves:
        return ""
    able = [b for b in boxes if b[0] == "#root" or size(b[2]) and b[0] != "p"]
    best = max(able, key=score)
    top = score(best)
    keep = [best[2]]
    for b in boxes:
        if best[2] and b[2] and len(b[2]) == len(best[2]) and b[2][:-1] == best[2][:-1] and b[2] != best[2] and size(b[2]):
            density = link(b[2]) / size(b[2])
            if b[0] == "p" and (size(b[2]) > 80 and density < 0.25 or density == 0) or b[0] == best[0] and score(b) >= max(10, top / 5) and density < 0.25:
                keep.append(b[2])
    own = [b[2] for b in boxes if b[0] == "article"]
    menus = [b[2] for b in boxes if not any(b[2][: len(a)] == a for a in own) and b[0] in ("ul", "div", "table", "section") and sum(x[1] > 0 for x in leaves if under(x, b[2])) >= 3 and link(b[2]) > 0.5 * size(b[2]) and b != best]
    kept = lambda leaf: any(under(leaf, k) and not any(under(leaf, m) and m[: len(k)] == k for m in menus) for k in keep)
    return "\n".join(b[0] for b in leaves if kept(b))


def test_main_text_equals_brute_force():
    rng = random.Random(12)
    pages = [random_page(rng) for _ in range(600)]
    bad = [p for p in pages if html_text.main_text(as_html(p)) != brute_main_text(p)]
    assert not bad, (as_html(bad[0]), html_text.main_text(as_html(bad[0])), brute_main_text(bad[0]), len(bad))


def test_time_grows_with_the_page():
    def took(n):
        began = time.perf_counter()
        html_text.main_text("<div>x, y " * n)
        html_text.main_text("<p><table><tr><td>" + "<div><li>x, y" * n)
        html_text.main_text("<a " * n + '"')
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 8 * took(8_000) + 0.2


def test_extract_column(spark):
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, None), (2, None)], "page_id long, html string")
    assert sorted(r[0] for r in df.select(html_text.extract(F.col("html"))).collect()) == ["", "", "x"]


# op3


def test_host_path_and_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.com/en/1?x#y", "x://www.example.com/en/", "http://h.net/es", "http://h.net/es/1", "ftp://com", "http://com/", "http://È.com?q/", "a://b://c/d", "http://n\new.com/\np"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "id long, good int")
    got = {r.page_id: r for r in url_filter.judge(df, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("h.net", "/es", None, "allow"), ("h.net", "/es/1", "net/es/", "block"),
        ("com", "", None, "allow"), ("com", "/", "com/", "allow"), ("È.com", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("n\new.com", "/\np", "com/", "allow"),
    ]


def test_reputation_blocks_bad_hosts_and_shrinks(spark):
    rows = [(f"good{h}.a.org", int(i % 10 > 0)) for h in range(8) for i in range(40)] + [("bad.b.org", int(i % 20 == 0)) for i in range(60)] + [("new.b.org", None), ("one.a.org", 0), ("", None)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["bad.b.org"].blocked and not got["good0.a.org"].blocked
    assert not got["one.a.org"].blocked  # one bad page is not enough against its domain's record
    assert got["new.b.org"].blocked  # without pages of its own, the record of its domain decides
    assert got["one.a.org"]["mean"] < got["good0.a.org"]["mean"] and got["new.b.org"]["mean"] < got["one.a.org"]["mean"]
    assert url_filter.reputation(spark.createDataFrame([], "host string, good int")).count() == 0


def test_repeated_pages_and_a_long_url(spark):
    pages = [(1, "http://a.org/x"), (1, "http://a.org/y"), (2, "http://a.org/" + "p" * 300_000), (None, "http://b.org/"), (3, "http://" + "h" * 100_000 + ".org/z")]
    df = spark.createDataFrame([(*p, "q", 0.5) for p in pages], "page_id long, url string, verdict string, good_rate double")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 0)], "id long, good int")
    got = url_filter.judge(df, labels).collect()
    assert len(got) == len(pages) and sorted(len(r.path) for r in got) == [1, 2, 2, 2, 300_001]
    by = {r.host: r.good_rate for r in got}
    assert by["a.org"] > 0.5 and len(by) == 3 and all(0 < r.good_rate < r.good_upper and r.verdict == "allow" for r in got)
    assert url_filter.judge(df.limit(0), labels).count() == 0


# op4


def brute_tiles(d, b, k):
    """Greedy string tiling by trying every pair of places."""
    md, mb, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(d)):
            for j in range(len(b)):
                n = 0
                while i + n < len(d) and j + n < len(b) and d[i + n] == b[j + n] and i + n not in md and j + n not in mb:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return total
        total += best[0]
        md |= set(range(best[1], best[1] + best[0]))
        mb |= set(range(best[2], best[2] + best[0]))


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for k in range(400):
        letters = "ab" if k % 4 == 0 else "abcdef"
        item = [rng.choice(letters) for _ in range(rng.randint(5, 24))]
        parts = [item[i : i + 7] for i in range(0, len(item), 7)]
        rng.shuffle(parts)
        doc = [rng.choice(letters + "xyz") for _ in range(5)] + sum(parts, []) + [rng.choice("abc") for _ in range(6)]
        index = decontaminate.Index([0], [" ".join(item)], 3)
        got = list(decontaminate.contaminated(pa.array(["other text", " ".join(doc)]), index, 0.01))
        want = brute_tiles(doc, item, 3)
        assert [g[3] for g in got] == ([want] if want else []), (doc, item)


def brute_find(rows, items, k, coverage):
    plain = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    out = []
    for i, t in rows:
        for j, b in items:
            d, w = plain(t), plain(b)
            n = brute_tiles(d, w, k)
            if n and n >= coverage * len(w):
                out.append((i, j, n))
    return sorted(out)


@pytest.mark.parametrize("hits", [1, 1_000_000])
def test_find_equals_brute_force(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(11)
    word = lambda: rng.choice(("aa", "bb", "cc", "dd", "ee", "ff", "gg"))
    common = [word() for _ in range(8)]
    items = [(j, " ".join((common if j % 3 == 0 else []) + [word() for _ in range(rng.randint(3, 25))])) for j in range(12)]
    rows = []
    for i in range(40):
        ws = [word() for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            cut = rng.randint(0, len(own))
            ws += own[cut:] + own[:cut]
        rows.append((i, " ".join(ws)))
    bench = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.matched_words) for r in decontaminate.find(docs(spark, rows), bench).collect())
    assert got == brute_find(rows, items, decontaminate.SEED, decontaminate.COVERAGE) and len(got) > 10


def test_words_over_and_over():
    def took(n):
        began = time.perf_counter()
        index = decontaminate.Index([[0]], ["w " * n], decontaminate.SEED)
        assert [g[1:4] for g in decontaminate.contaminated(pa.array(["w " * n]), index, 0.5)] == [(0, 1.0, n)]
        text = ("u v " * n, ("v u " * 50 + "x ") * (n // 50))
        index = decontaminate.Index([[0]], [text[1]], decontaminate.SEED)
        assert len(list(decontaminate.contaminated(pa.array([text[0]]), index, 0.5))) == 1
        return time.perf_counter() - began

    took(1000)
    tracemalloc.start()
    took(30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 28 and took(32_000) < 10 * took(8_000) + 0.1


@pytest.mark.parametrize(("kind", "ids"), [("int", "1, 2"), ("smallint", "1, 2"), ("date", "'2024-01-01', '2024-01-02'"), ("string", "'a', 'b'"), ("decimal(5,1)", "1.5, 2.5"), ("timestamp", "'2024-01-01', '2024-01-02'"), ("array<int>", "array(1), array(2)")])
def test_ids_of_any_type(spark, kind, ids):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.sql(f"SELECT CAST(i AS {kind}) AS item_id, t AS text FROM (SELECT explode(array({ids})) AS i) CROSS JOIN (SELECT '{item}' AS t)").unionByName(spark.sql(f"SELECT CAST(NULL AS {kind}) AS item_id, '{item} more' AS text"))
    found = decontaminate.find(docs(spark, [(1, item), (None, item)]), bench)
    assert dict(found.dtypes)["item_id"] == kind
    want = sorted([*(str(r.item_id) for r in bench.collect())] * 2)
    assert sorted(str(r.item_id) for r in found.collect()) == want and len(want) == 6


def test_repeated_items_are_one_text_of_the_index(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)] * 40 + [(i, item) for i in range(2, 9)] + [(9, "other words " * 5)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    sizes = [len(index.texts) for index in decontaminate._indexes(bench, "item_id", "text", 5, decontaminate._blocks(bench, "text"))]
    assert sum(sizes) == 2
    found = decontaminate.find(docs(spark, [(5, item)]), bench)
    assert sorted(r.item_id for r in found.collect()) == [1] * 40 + list(range(2, 9))


def test_decontamination(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(40))
    ws = item.split()
    moved = " ".join(ws[20:] + ["between"] + ws[:20])
    rows = [(1, "Before. " + item.upper() + "! after"), (2, moved), (3, " ".join(ws[:15])), (4, "clean text only here"), *EDGES]
    bench = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (10, "other text that nobody has in any document at all")], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = sorted((r.doc_id, r.item_id, r.coverage, r.tiles) for r in decontaminate.find(docs(spark, rows), bench).collect())
        assert got == [(1, 7, 1.0, 1), (2, 7, 1.0, 2)]
        kept = decontaminate.clean(docs(spark, rows), bench)
        assert kept.count() == len(rows) - 2 and kept.columns == docs(spark, []).columns
    assert decontaminate.find(docs(spark, []), bench).count() == 0
    assert decontaminate.find(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)


# op6


def test_fingerprints(spark):
    text = "The cat sat on the mat and the dog ran to a house with many old red doors"
    a, b, c = spotsigs.signatures(pa.array([text, text.upper() + "!", "Nothing shared here at all between these"]))
    assert (a == b).all() and spotsigs.likeness(a, b) == 1.0 and spotsigs.likeness(a, c) == 0.0
    assert len(a) == len(set(a.tolist())) >= 4
    df = docs(spark, [(1, text), (2, text), (3, text + " and then the cat left for good"), (4, "quite different words of an other sort in this"), *EDGES])
    prints = spotsigs.fingerprints(df)
    assert prints.count() == 4 + len(EDGES)
    found = {r.doc_id: r.near_class for r in spotsigs.near_classes(df.where("doc_id in (1, 2, 3, 4) and n_chars is null and length(text) > 10"), 50).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_texts_without_anchors_are_signed_whole(spark):
    table = [f"kilo{i} wert{i * 7}" for i in range(40)]
    half = table[:20] + [f"neu{i} zahl{i}" for i in range(20)]
    texts = [" ".join(table), " ".join(half), " ".join(table[:2] + half[20:]), " ".join([*table, "the", "end"]), " ".join(half) + " of"]
    a, b, c, d, e = spotsigs.signatures(pa.array(texts))
    assert len(a) == len(b) == 78 and len(d) == 79 and (e == b).all()  # all chains of content words; anchors at the end have none
    assert spotsigs.likeness(a, b) == 38 / 118 and spotsigs.likeness(a, c) == 2 / len(set(a.tolist()) | set(c.tolist())) and spotsigs.likeness(a, d) == 78 / 79
    rows = [(1, texts[0]), (2, texts[2]), (3, "the cat sat on the mat and the dog ran")]
    got = {r.doc_id: (r.near_edited, r.near_next) for r in spotsigs.edit_likeness(docs(spark, rows)).collect()}
    assert got[1][0] < 0.5 and got[1][1] < 0.1


def brute_near(rows, sets, percent):
    """The class of each row by comparing all pairs of fingerprints."""
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] if sets[i] else d for i, (d, _) in enumerate(rows)]


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(4)
    words_ = [a + b for a in ("ka", "lo", "mi", "ter", "su", "ven") for b in ("ren", "sto", "na", "li", "dor")] + ["the", "of", "and", "a"] * 6
    texts = ["", "!?", None]
    for _ in range(12):
        t = [rng.choice(words_) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(words_)
    rows = [(i // 2 if i > 20 else i, t) for i, t in enumerate(texts)]  # ids that stand twice
    sets = [set(x.tolist()) for x in spotsigs.signatures(pa.array(texts, pa.string()))]
    for percent in (50, 80):
        want = sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, brute_near(rows, sets, percent), strict=True))
        got = spotsigs.near_classes(docs(spark, rows), percent).select("doc_id", "signatures", "near_class")
        assert sorted(map(tuple, got.collect())) == want
        found = spotsigs.edit_likeness(docs(spark, rows), percent=percent)
        assert sorted((r.doc_id, len(r.fingerprint) // 8, r.near_class) for r in found.collect()) == want


def brute_signatures(text):
    """Signatures as tuples of words."""
    ws = words_of(text)
    anchors = {w.encode() for w in spotsigs.ANCHORS.split()}
    content = [i for i, w in enumerate(ws) if w not in anchors]
    after = lambda i: tuple(ws[c] for c in content if c > i)[: spotsigs.CHAIN]
    found = {(ws[i], after(i)) for i in range(len(ws)) if i not in content and len(after(i)) == spotsigs.CHAIN}
    if len(content) >= spotsigs.CHAIN:
        found |= {(None, after(-1))} if found else {(None, after(i - 1)) for i in content if len(after(i - 1)) == spotsigs.CHAIN}
    return found or ({("all", *ws)} if ws else {("characters", text)} if text else set())


def test_edited_and_next_equal_brute_force(spark):
    import hashlib

    rng = random.Random(13)
    say = lambda n: " ".join(rng.choice(("the", "of", "und", "für", "die", "cat", "Dog", "red", "große", "old", "door", "run")) for _ in range(n))
    rows = [(i * 7 % 101, rng.choice(("", "! ", "x")) + say(rng.choice((0, 1, 2, 3, 9, 40)))) for i in range(60)] + [(500, None), (501, "?"), (502, "é" * 50), (503, say(2000))]
    got = {r.doc_id: r for r in spotsigs.edit_likeness(docs(spark, rows)).collect()}
    ids, text = sorted(dict(rows)), {i: t or "" for i, t in rows}
    alike = lambda a, b: float(len(a) == len(b)) if not a or not b else len(a & b) / len(a | b)
    prints = {}
    for k, i in enumerate(ids):
        t, following = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        r, own = got[i], brute_signatures(t)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(own) and len(r.edited_fingerprint) == 8 * len(brute_signatures(e))
        assert r.near_edited == pytest.approx(alike(own, brute_signatures(e))) and r.near_next == pytest.approx(alike(own, brute_signatures(following)))
        assert prints.setdefault(frozenset(own), r.fingerprint) == r.fingerprint
    near = brute_near([(i, None) for i in ids], [brute_signatures(text[i]) for i in ids], 80)
    assert [got[i].near_class for i in ids] == near
    assert len(set(prints.values())) == len(prints)


def test_edited_and_next(spark):
    rows = [(10, "abcdefg"), (20, "xy"), (5, ""), (7, "the quick brown fox jumps over the lazy dog"), *EDGES]
    assert spotsigs.edit_likeness(docs(spark, rows)).count() == len(rows)
    assert spotsigs.edit_likeness(docs(spark, [])).count() == 0
    one = spotsigs.edit_likeness(docs(spark, [(1, "only this text")])).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("parts", ["1", "3", "9"])
def test_next_does_not_depend_on_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i * i % 101, f"text {i} of the kind that the others are too") for i in range(40)]
        rows = list(dict(rows).items())
        got = {r.doc_id: r.edited_sha256 for r in spotsigs.edit_likeness(docs(spark, rows)).collect()}
        import hashlib

        ids, text = sorted(dict(rows)), dict(rows)
        for i, d in enumerate(ids):
            e = spotsigs.edited(text[d], text[ids[(i + 1) % len(ids)]])
            assert got[d] == hashlib.sha256(e.encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# op7


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    base = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tes") for b in ("r", "nd", "st") for c in ("en", "o", "a")]
    bad = [f"grox{e}" for e in ("", "er", "ish", "ly", "s", "ing", "ed")]
    rows, labels = [], []
    for i in range(400):
        ws = [rng.choice(base) for _ in range(rng.randint(20, 60))]
        if i % 5 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 5 == 0)))
    train = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1] + [(None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    df = docs(spark, rows + EDGES)
    model = toxicity.fit(df, train)
    got = df.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.s <= 1 for r in got)
    held = [(dict(labels)[r.doc_id], r.s) for r in got if r.doc_id is not None and r.text and len(r.text) < 2000 and r.doc_id in dict(rows) and dict(rows)[r.doc_id] == r.text and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([s >= 0.7 for y, s in held if y]) > 0.8 and np.mean([s >= 0.7 for y, s in held if not y]) < 0.05
    again = toxicity.fit(df.repartition(5), train)
    assert np.allclose(again.curve, model.curve)


def small_corpus(seed):
    rng = random.Random(seed)
    vocab = ["ab", "abc", "abd", "b", "ba", "bab", "xyz", "xy", "é", "aé", "grox", "groxer", "a1"]
    texts = [" ".join(rng.choice(vocab[: 11 if i % 3 else 13]) for _ in range(rng.randint(0, 12))) + ("!! The end" if i % 5 == 0 else "") for i in range(60)]
    return texts, [int(i % 3 == 0) for i in range(60)]


def test_kneser_ney_probabilities_sum_to_one():
    d = toxicity.Discounts(3.0, 2.0, 1.5)
    b = Brute(*small_corpus(1), d)
    for c in (0, 1):
        for ctx in (b"", b"a", b"ab", b"grox", b"groxe", b"groxgroxer", b"q", b"\xc3", b"never"):
            assert sum(b.byte(c, ctx, bytes([x])) for x in range(256)) == pytest.approx(1)
        vocab = set(b.word[0]) | set(b.word[1])
        unseen = 1 - sum(b.spelling(c, w) for w in vocab)  # of all other spellings
        passed = lambda counts, d: sum(min(d, n) for n in counts.values()) / sum(counts.values()) if counts else 1.0
        for h in (None, b"ab", b"grox", b"never"):
            of_h = {w: n for (x, w), n in b.pair[c].items() if x == h}
            rest = passed(of_h, d.pair) * passed(b.word[c], d.word) * unseen
            assert sum(b.after(c, h, w) for w in vocab) + rest == pytest.approx(1)


def test_ratios_equal_brute_force(spark):
    texts, labels = small_corpus(2)
    kept = [i % 4 == 1 for i in range(60)]
    rows = spark.createDataFrame(list(zip(texts, labels, kept)), "text string, toxic int, kept boolean").repartition(3)
    new = ["never seen groxish abé", "abq ab ab grox grox b", "the END x"]
    wanted = [toxicity.Discounts(3.0, 2.0, 6.0), toxicity.Discounts(0.75, 1.5, 1.0)]
    make = toxicity.counted(rows, tuple(wanted))
    made = [(make(fit, d), d, some) for d in wanted for fit, some in enumerate(([i for i in range(60) if not kept[i]], range(60)))]
    for counts, d, some in made:  # tables are read once for all discounts and both fits
        model = toxicity.ratios(counts)
        b = Brute([texts[i] for i in some], [labels[i] for i in some], d)
        assert any((np.abs(model.pair.ratio) > 0).tolist()) or d.pair > 1
        assert len(model.word.key)
        for t in [*new, *texts[:20]]:
            want = [math.log(b.after(1, h, w)) - math.log(b.after(0, h, w)) for h, w in zip([None, *words_of(t)], words_of(t))]
            got = [model.by_word(data, st, en, h, first).tolist() for _, _, data, st, en, h, first in words.spelled(pa.array([t]), plain=True)]
            assert sum(got, []) == pytest.approx(want)
            e = model.evidence(pa.array([None, t, ""]))
            assert e[1].tolist() == pytest.approx([np.mean(want), max(want)] if want else [0, 0]) and not e[[0, 2]].any()


def test_discounts_are_chosen_on_training_rows(spark):
    texts, labels = small_corpus(5)
    df = docs(spark, list(enumerate(texts)))
    train = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    few, many = toxicity.Discounts(0.75, 0.75, 0.75), toxicity.Discounts(50.0, 50.0, 50.0)  # the second leaves nothing to tell classes by
    want = toxicity.fit(df, train, discounts=(few,))
    for both in ((few, many), (many, few)):
        got = toxicity.fit(df, train, discounts=both)
        assert np.allclose(got.curve, want.curve) and len(got.word.key) == len(want.word.key)


def test_files_of_the_sample_do_not_follow_the_documents_splits(spark, monkeypatch):
    texts, labels = small_corpus(6)
    df = docs(spark, list(enumerate(texts)))
    train = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    want = toxicity.fit(df.coalesce(1), train)
    stored, write = [], toxicity.materialize

    def seen(df, name):
        out = write(df, name)
        if name == "toxicity-sample":
            stored.append((len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(toxicity, "materialize", seen)
    got = toxicity.fit(df.repartition(60), train)
    assert [n for _, n in stored] == [60] and stored[0][0] <= toxicity.FILES
    assert np.allclose(got.curve, want.curve) and all(np.array_equal(g.key, w.key) and np.allclose(g.ratio, w.ratio) for g, w in zip(got[:5], want[:5]))


def test_without_labels(spark):
    df = docs(spark, [(1, "some words"), (2, None)])
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r[0] for r in df.select(toxicity.score(F.col("text"), model)).collect()] == [0.5, 0.5]
