"""Whitening against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """{(vec_id, component): ...} by exact sums of products over the distinct vectors."""
    xs = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            xs.append((i, tuple(min(max(math.floor(256 * float(c)), -(1 << 63)), (1 << 63) - 1) for c in v)))
    dim = max((len(x) for _, x in xs), default=0)
    xs = [(i, x) for i, x in xs if len(x) == dim]
    if not dim:
        return [], None, None
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
    cov = [[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) for b in range(dim)] for a in range(dim)]
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1].T
    out = []
    for i, x in xs:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        u = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        for k in range(min(components, dim)):
            out.append((i, k + 1, n, deviation, float(u @ w[k]) / math.sqrt(e[k]) if e[k] > 1e-12 * e[0] else None, float(e[k] / v.trace()) if v.trace() else None))
    return out, v, e


def check(spark, rows, parts=3):
    df = vectors(spark, rows).repartition(parts) if rows else vectors(spark, rows)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    want, _, _ = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4] or 0))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == (*w[:3], w[3] if w[3] < 1 << 63 else None)
        assert (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        if w[4] is not None:
            assert abs(abs(g[4]) - abs(w[4])) < 1e-6 * max(1, abs(w[4]))
            assert abs(g[5] - w[5]) < 1e-9
            assert g[6] is not None and g[6] <= 1e-6
    return got


def test_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 7)) + 0.01 * rng.normal(size=(60, 7)) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist()) for i in range(200)]  # copies count once
    rows += [(None, base[1].tolist()), (7, base[2].tolist())]
    got = check(spark, rows)
    assert got[0][2] == 60


def test_signs_hold_for_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 4)) * [8, 4, 2, 1])]
    df = vectors(spark, rows).repartition(5)
    out = whitening.whiten(df, whitening.fit(df)).collect()
    w = np.array([[r.whitened for r in sorted(out, key=lambda r: r.vec_id) if r.component == k] for k in range(1, 5)])
    assert abs(w.mean(1)).max() < 1e-9 and abs(w @ w.T / 80 - np.eye(4)).max() < 1e-6
    assert [sorted({round(r.explained, 12) for r in out if r.component == k}) for k in range(1, 5)] == sorted([sorted({round(r.explained, 12) for r in out if r.component == k}) for k in range(1, 5)], reverse=True)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0])],
        [(1, [])],
        [(1, [0.5, 0.25])],
        [(1, [-0.0, 0.0]), (2, [0.0, -0.0]), (3, [0.001, -0.001])],
        [(1, [1.0]), (2, [2.0]), (2, [2.0]), (None, [3.0])],
        [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [0.0, 1.0, 5.0]), (4, [1.0, 2.0]), (5, None)],
        [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])],
        [(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [123456789.123, 3.0])],
    ],
    ids=["empty", "none left", "no entries", "one vector", "zeros", "one dimension", "short and dependent", "beyond long", "large"],
)
def test_edges(spark, rows):
    check(spark, rows, 1)


def test_packing_is_the_same_for_equal_vectors():
    x = np.array([[1, -5], [40000, 1], [1, 1 << 40], [1, -5]])
    seen = {}
    for rows, width, data in whitening.packed(x):
        for r, d in zip(rows.tolist(), data, strict=True):
            seen[r] = (width, d.tobytes())
    assert seen[0] == seen[3] and [seen[i][0] for i in range(4)] == [2, 4, 8, 2]


def test_squares_are_exact_near_overflow():
    x = np.full((5000, 2), (1 << 24) - 1)
    q = whitening.squares(x, np.zeros(2, object))
    assert q[0, 1] == 5000 * (2 * ((1 << 24) - 1)) ** 2 and q[0, 0] == 5000 * ((1 << 24) - 1) ** 2


def test_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(40, 6)))] + [(99, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r.component): r for r in queries.queries()["op12_polarisation_whitening"](spark, f"file://{tmp_path}").collect()}
    want, _, _ = brute(rows)
    assert len(got) == len(want) == 160
    for i, k, n, deviation, w, share in want:
        r = got[i, k]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(w)) < 1e-9 and abs(r.explained - share) < 1e-12
    assert spark.read.parquet(f"file://{tmp_path}/embeddings.parquet").where(F.col("embedding").isNull()).count() == 1
