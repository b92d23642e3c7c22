"""Whitening against numpy over the whole matrix, and exact sums against Python's whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexengine.llm import registry, whitening
from lexengine.llm.common import table


def brute(rows):
    """n, S, V and {vec_id: [(x, deviation)]} of (vec_id, vector) rows."""
    kept = [(i, [math.floor(float(c) * 256) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = {}
    for x in {tuple(x) for _, x in kept}:
        lengths.setdefault(len(x), []).append(x)
    dims, fit = max(lengths.items(), key=lambda g: (len(g[1]), g[0]))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums)] for x in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dims)] for i in range(dims)]) if n <= 60 else np.cov(np.array(fit, dtype=float).T, bias=True)
    return n, sums, cov, [(i, x, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept if len(x) == dims]


def check(frame, rows):
    n, sums, cov, kept = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    got = {}
    for r in frame.collect():
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9, abs=1e-12)
        assert r.identity_error <= 1e-8
        got.setdefault(r.vec_id, []).append(r)
    assert sum(map(len, got.values())) == len(kept) * len(values)
    for i, x, deviation in kept:
        own = (np.array(x, dtype=float) - np.array([float(Fraction(s, n)) for s in sums])) @ vectors / np.sqrt(values)
        assert any(r.deviation == (deviation if deviation < 2**63 else None) for r in got[i])
        for k in range(len(values)):
            assert any(abs(abs(r.whitened) - abs(own[k])) < 1e-6 for r in got[i] if r.component == k + 1)
    signs = [[np.sign(r.whitened) for r in sorted(got[i], key=lambda r: r.component)] for i, _, _ in kept[:1]]
    assert signs


def test_query_equals_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    check(registry.QUERIES["op11_whitening"](spark, sf), rows)


def frame_of(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return docs.withColumns({c: F.lit("t") for c in ("x", "d", "n", "row_block", "i", "a.b", "deviation")})


def test_tiles_of_any_shape_give_the_same_model(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0.3, 0.4, 7).tolist()) for i in range(50)]
    frame = frame_of(spark, rows).repartition(3)
    models = [whitening.fit(frame, tile=t, rows=r) for t, r in ((3, 9), (2, 1000), (7, 4), (32, 50))]
    n, sums, cov, _ = brute(rows)
    for m in models:
        assert (m.n, m.sums) == (n, sums)
        assert np.array_equal(m.covariance, cov) and np.array_equal(m.vectors, models[0].vectors)


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [rng.normal(0, 1, 3).tolist() for _ in range(20)]
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(100, 140)] + [(None, base[1])]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("inf"), 0.0]), (205, [1.0, 2.0]), (5, base[6])]
    frame = frame_of(spark, rows)
    check(whitening.by_component(frame), rows)
    assert whitening.by_component(frame.limit(0)).count() == 0
    assert whitening.by_component(frame.where("embedding is null")).count() == 0
    assert whitening.by_component(frame_of(spark, [(1, []), (2, [])])).count() == 0
    # one vector only: no component varies
    same = whitening.by_component(frame_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r.vec_id, r.component) for r in same) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    # a component without variance beside one with it
    flat = whitening.by_component(frame_of(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)


@pytest.mark.parametrize("size", [1e3, 1e6, 1e12, 1e17])
def test_entries_of_any_size_are_exact(spark, size):
    rng = np.random.default_rng(int(size) % 97)
    rows = [(i, (rng.normal(1, 1, 4) * size * (i % 7 == 0 or 1e-3)).tolist()) for i in range(40)]
    if size == 1e17:
        rows.append((99, [1e300, -1e300, 0.0, 1.0]))
    saturated = [(i, [min(max(c, -(2.0**55)), 2.0**55 - 2.0**3) for c in v]) for i, v in rows] if size == 1e17 else rows
    m = whitening.fit(frame_of(spark, rows), tile=3, rows=16)
    n, sums, cov, _ = brute(saturated)
    if size < 1e17:
        assert (m.n, m.sums) == (n, sums) and np.array_equal(m.covariance, cov)
    assert np.isfinite(m.covariance).all()


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 18, 1 << 22, 1 << 40, 1 << 61):
        a, b = rng.integers(-most, most, (300, 3)), rng.integers(-most, most, (300, 2))
        assert whitening.product(a, b).tolist() == (a.astype(object).T @ b.astype(object)).tolist()
        limbs = whitening._limbs(whitening.product(a, b).ravel())
        assert [whitening._joined(x) for x in zip(*limbs)] == (a.astype(object).T @ b.astype(object)).ravel().tolist()
        assert whitening.unpacked(whitening.packed(a), 3).tolist() == a.tolist()
