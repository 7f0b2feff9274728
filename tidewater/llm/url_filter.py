"""URL filter: rules first, then host reputation by empirical Bayes.

Labelled page outcomes (good or bad) are counted by host. The rate of good pages is shrunk
through beta-binomial priors: suffix towards all pages, registered domain towards its suffix, host
towards its domain. The weight of each prior comes from how much rates differ between siblings beyond
chance (moments over all labelled pages). A host is blocked when even the upper bound of
its posterior lies under ``min_good``; hosts without labels have their domain's prior.

Edge cases: null urls or urls without '://' have an empty host and path; a host of one label
is its own domain and suffix; ports do not count for reputation; no labels at all give even
priors, so nothing is blocked; several labels for a page count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.sources.scratch import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The production rules: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MIN_GOOD, Z = 0.5, 1.645
LEAST, MOST = 2.0, 1e6  # limits of a prior's weight, in pages


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent of it and starts the path; null if none. A rule list is small: it is part of the expression."""
    best = None
    for text, _ in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        best = F.when(fits, text) if best is None else best.when(fits, text)
    return best if best is not None else F.lit(None).cast("string")


def _domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def reputation(outcomes: DataFrame, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """(host, good: 1, 0 or null for an unlabelled page) to (host, mean, upper, blocked), one row a host.

    Everything is sums by host, domain and suffix with partial aggregation, so a host with a third of the pages is no
    hot spot. The host table is stored once; the domain and suffix tables are sums of it, and all else is read from it.
    """
    counts = lambda: (F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    hosts = outcomes.groupBy("host").agg(*counts())
    bare = F.regexp_replace("host", r":[0-9]*$", "")
    hosts = materialize(hosts.withColumn("domain", _domain(bare)).withColumn("suffix", F.regexp_extract("domain", r"[^.]*$", 0)), "hosts")
    sums = lambda: (F.sum("n").alias("n"), F.sum("g").alias("g"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums()), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*sums()).withColumn("all", F.lit(0)), "suffixes")
    every = suffixes.groupBy("all").agg(*sums()).withColumn("prior", (F.col("g") + 1) / (F.col("n") + 2))

    s = _shrunk(suffixes, every, "all")
    d = _shrunk(domains, s, "suffix")
    h = _shrunk(hosts, d, "domain", last=True)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    h = h.withColumn("mean", mean).withColumn("upper", mean + F.lit(z) * sd).select("host", "mean", "upper", (F.col("upper") < min_good).alias("blocked"))
    h = materialize(h, "reputation")
    discard(hosts, domains, suffixes)
    return h


def _shrunk(children: DataFrame, parents: DataFrame, key: str, last: bool = False) -> DataFrame:
    """Children with ``prior``, the posterior mean that is the prior of their own children; or, at the last level, a and b."""
    p = parents.select(F.col(key), F.col("n").alias("pn"), F.col("g").alias("pg"), "prior")
    c = children.join(p, key)
    rate, of_parent = F.col("g") / F.nullif(F.col("n"), F.lit(0)), F.col("pg") / F.nullif(F.col("pn"), F.lit(0))
    seen = c.where("n > 0").withColumns({"dev": F.col("n") * (rate - of_parent) * (rate - of_parent), "noise": of_parent * (1 - of_parent), "own": F.col("n") * F.col("n") / F.col("pn")})
    level = seen.agg(
        F.coalesce(F.sum("dev"), F.lit(0.0)).alias("dev"), F.coalesce(F.sum(F.col("noise") * (1 - F.col("n") / F.col("pn"))), F.lit(0.0)).alias("expected"),
        F.coalesce(F.sum(F.col("n") - F.col("own")), F.lit(0.0)).alias("free"), F.coalesce(F.sum(F.col("noise") * F.col("n")) / F.sum("n"), F.lit(0.25)).alias("noise"),
    ).first()
    between = max(0.0, (level.dev - level.expected) / level.free) if level.free else 0.0
    weight = min(MOST, max(LEAST, level.noise / between - 1)) if between > 0 else MOST if level.free else LEAST
    a, b = F.col("g") + weight * F.col("prior"), F.col("n") - F.col("g") + weight * (1 - F.col("prior"))
    if last:
        return c.select("host", a.alias("a"), b.alias("b"))
    return c.withColumn("prior", a / (a + b)).drop("pn", "pg")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_good: float = MIN_GOOD, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, good_rate and good_upper. ``labels``: (id, good 0 or 1), id as ``id_col`` of pages."""
    host, path = host_and_path(F.col(url_col))
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "good_rate", "good_upper")]
    rows = pages.select(*given, host.alias("host"), path.alias("path"))
    outcomes = rows.select(F.col(id_col).alias("id"), "host").join(labels.select("id", "good"), "id", "left")
    rep = reputation(outcomes, min_good, z).withColumnsRenamed({"host": "_h", "mean": "good_rate", "upper": "good_upper"})
    out = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(rep, F.col("host") == F.col("_h"), "left")
    by_rule = F.create_map(*(F.lit(x) for r in rules for x in r)) if rules else None
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), F.try_element_at(by_rule, F.col("rule"))).otherwise(method) if rules else method
    return out.withColumn("verdict", verdict).drop("_h", "blocked")
