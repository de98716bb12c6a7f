"""Whitening against a dense eigendecomposition; the eigensolver on operators of many shapes."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from gaugeline.llm import whitening


def plain(vectors, components=32):
    """(x, n, deviations, eigenvalues, eigenvectors, trace) with exact deviations."""
    x = [[floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    values, q = np.linalg.eigh(c.T @ c / n)
    return c, n, deviations, values[::-1][:components], q[:, ::-1][:, :components], float(Fraction(sum(deviations), n**3))


def check(found, vectors, components):
    c, n, deviations, values, q, trace = plain(vectors, components)
    scores = c @ q / np.sqrt(values)
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert all(sorted(x) == list(range(1, len(values) + 1)) for x in got.values()) and len(got) == n
    signs = [np.sign(sum(got[i][k + 1]["whitened"] * scores[i, k] for i in range(n))) for k in range(len(values))]
    for i in range(n):
        for k in range(len(values)):
            r = got[i][k + 1]
            assert (r["n"], r["deviation"]) == (n, deviations[i])
            assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-10)
            assert r["identity_error"] < 1e-9
            assert r["whitened"] == pytest.approx(signs[k] * scores[i, k], abs=1e-7)


def test_equals_dense_whitening(spark, rows):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    vectors[50:60] = vectors[50]
    data = [(i, v.tolist(), "a", 1) for i, v in enumerate(vectors)]
    sound = rows(data, "vec_id long, embedding array<float>, n string, component int").repartition(5)
    bad = [(500, None), (501, []), (502, [1.0] * 11), (503, [None] + [1.0] * 11), (504, [float("nan")] * 12)]
    bad += [(505, [float("inf")] + [0.0] * 11), (506, [-float("inf")] * 12)]
    odd = rows([(i, v, "b", 2) for i, v in bad], "vec_id long, embedding array<float>, n string, component int")
    check(whitening.whitened(sound.union(odd), 4).collect(), vectors, 4)
    check(whitening.whitened(sound).collect(), vectors, 32)


def test_repeated_rows_and_null_ids_count(rows):
    data = [(None, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 0.5])]
    found = whitening.whitened(rows(data, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in found if r["vec_id"]) == [
        (False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2)
    ]
    assert len(found) == 8 and {r["n"] for r in found} == {4} and max(r["identity_error"] for r in found) < 1e-9


def test_nothing_to_scale(rows):
    schema = "vec_id long, embedding array<float>"
    for data in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        frame = whitening.whitened(rows(data, schema))
        assert frame.collect() == [] and frame.columns[:3] == ["vec_id", "component", "n"]
    flat = whitening.whitened(rows([(1, [1.0, 2.0]), (2, [2.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["explained"]) for r in flat) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_large_deviations_are_exact(rows):
    data = [(i, [float(1 << 40) * (i % 2), float(i)]) for i in range(4)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened(rows(data, "vec_id long, embedding array<double>")).collect()}
    assert set(found.values()) == {None}


@pytest.mark.parametrize("d, k, shape", [(300, 8, "flat"), (200, 6, "falling"), (50, 10, "equal"), (40, 5, "low rank"), (1, 3, "flat")])
def test_eigenpairs_reach_rounding(d, k, shape):
    rng = np.random.default_rng(d)
    values = {
        "flat": np.sort(rng.uniform(1, 2, d))[::-1],
        "falling": 0.9 ** np.arange(d),
        "equal": np.array([9.0] * 4 + [5.0] * 8 + [1.0] * (d - 12))[:d] if d > 12 else np.ones(d),
        "low rank": np.array([3.0, 2.0, 1.0] + [0.0] * (d - 3)) if d > 3 else np.ones(d),
    }[shape]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    operator = (q * values) @ q.T
    found, vectors, made = whitening.leading_eigenvectors(lambda m: operator @ m, d, k)
    k = min(k, d)
    assert np.abs(found - values[:k]).max() < 1e-13 * values[0]
    assert np.linalg.norm(operator @ vectors - vectors * found, axis=0).max() < 1e-13 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert made["rounds"] < 40


def test_minres_solves_projected_shifted_systems():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    space, _ = np.linalg.qr(rng.standard_normal((30, 5)))
    p = np.eye(30) - space @ space.T
    right = p @ rng.standard_normal((30, 3))
    shifts = np.array([0.3, -1.0, 2.0])
    t = whitening.minres(lambda m: a @ m, shifts, space, right, steps=60)
    for i in range(3):
        left = p @ (a - shifts[i] * np.eye(30)) @ t[:, i] - right[:, i]
        assert np.linalg.norm(left) < 2e-3 * np.linalg.norm(right[:, i])
    assert np.abs(space.T @ t).max() < 1e-10
