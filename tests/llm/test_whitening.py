"""Whitening against numpy's eigenvectors: distinct vectors, exact sums, rank-deficient and mixed tables, extreme entries."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.llm import whitening


def table(spark, rows, parts=3):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    return d.withColumns({c: F.lit("x") for c in ("id", "x", "n", "dim", "part", "component")})


def fixed(v):
    return tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)


def plain(vectors):
    x = np.array(sorted({fixed(v) for v in vectors}), dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = x.astype(float) - (s / n).astype(float)
    e, w = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], w[:, ::-1]


def by_id(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.vec_id][r.component] = r
    return out


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(9, 9)) * np.array([9, 6, 4, 3, 1, 1, 0.5, 0.2, 0.1])
    x = (rng.normal(size=(700, 9)) @ mix.T + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[0][1]) for i in range(900)]  # more than half of the table is one vector
    rows += [(5, rows[5][1])]
    bad = [(1, None), (2, [None] + [1.0] * 8), (3, [float("nan")] + [1.0] * 8), (4, [float("inf")] + [1.0] * 8)]
    got = whitening.whiten(table(spark, rows + [(20_000 + i, v) for i, v in bad]))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = by_id(got)
    n, s, e, w = plain([v for _, v in rows])
    assert set(got) == {i for i, _ in rows}
    sign = {}
    for i, v in rows:
        f = fixed(v)
        y = (np.array(f, dtype=float) - (s / n).astype(float)) @ w[:, :4] / np.sqrt(e[:4])
        assert sorted(got[i]) == [1, 2, 3, 4]
        for c in range(4):
            r = got[i][c + 1]
            sign.setdefault(c, np.sign(r.whitened * y[c]))
            assert r.whitened == pytest.approx(sign[c] * y[c], rel=1e-9, abs=1e-9)
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(f, s, strict=True))
            assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-10) and r.identity_error < 1e-9


def test_repeated_rows_come_as_often(spark):
    rows = [(1, [1.0, 2.0])] * 3 + [(2, [4.0, 2.5]), (None, [0.0, 1.0])]
    got = whitening.whiten(table(spark, rows)).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in got} == {1: 6, 2: 2, None: 2}


def test_many_tasks_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 3)
    x = np.random.default_rng(1).normal(size=(400, 5)).astype(np.float32)
    d = whitening.fixed_point(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding").repartition(29).select("x")
    of = whitening.totals(d)
    r = whitening.triangles(d, of)[5]
    n, s, e, _ = plain(x)
    assert of[5] == (n, list(s)) and np.linalg.svd(r)[1] ** 2 / n == pytest.approx(e, rel=1e-12)


def test_without_variance_and_of_low_rank(spark):
    one = by_id(whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])))
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and (r.n, r.deviation) == (1, 0) for v in one.values() for r in v.values())
    line = by_id(whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])))
    for v in line.values():
        assert v[1].whitened is not None and v[2].whitened is None and v[3].whitened is None and v[1].identity_error < 1e-12
        assert v[1].explained == pytest.approx(1)


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 3)), rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(100 + i, v.tolist()) for i, v in enumerate(b)] + [(900, [])]
    got = by_id(whitening.whiten(table(spark, rows)))
    assert 900 not in got and sorted(got[0]) == [1, 2, 3] and sorted(got[100]) == [1, 2, 3, 4]
    assert got[0][1].explained == pytest.approx(plain(a)[2][0] / plain(a)[2].sum()) and got[100][1].n == 60


def test_extreme_entries(spark):
    rows = [(1, [1e18, 0.0]), (2, [-1e18, 1.0]), (3, [1e30, 1.0]), (4, [2.0, 3.0]), (5, [1e16, 1.0])]
    got = by_id(whitening.whiten(table(spark, rows)))
    assert sorted(got) == [4, 5]  # the integers of the others exceed 62 bits
    assert got[5][1].deviation is None and np.isfinite(got[5][1].whitened)
    near = by_id(whitening.whiten(table(spark, [(1, [2e6, 0.0]), (2, [2e6 + 1, 1.0]), (3, [2e6 - 1, 0.5])])))
    n, s, *_ = plain([[2e6, 0.0], [2e6 + 1, 1.0], [2e6 - 1, 0.5]])
    for i, v in ((1, [2e6, 0.0]), (2, [2e6 + 1, 1.0])):
        assert near[i][1].deviation == sum((n * a - b) ** 2 for a, b in zip(fixed(v), s, strict=True))


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_rotations(d):
    rng = np.random.default_rng(d)
    a = np.triu(rng.normal(size=(d, d))) * 10.0 ** rng.integers(-6, 6, size=d)
    s, v = whitening.jacobi(a)
    assert s == pytest.approx(np.linalg.svd(a)[1], rel=1e-9, abs=1e-9 * s[0])
    assert np.log(s).sum() == pytest.approx(np.log(np.abs(np.diag(a))).sum(), rel=1e-9)  # small values too: their product is the determinant
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-12
    u = a @ v
    assert np.linalg.norm(u, axis=0) == pytest.approx(s, rel=1e-9)
    twice = np.concatenate([a, a], axis=1)[:, : 2 * d]  # equal columns: half of the values are 0
    s2, v2 = whitening.jacobi(np.linalg.qr(np.concatenate([twice, np.zeros((d, 2 * d))]), mode="r"))
    assert np.abs(v2.T @ v2 - np.eye(2 * d)).max() < 1e-12 and (s2[d:] <= s2[0] * 1e-12).all()
