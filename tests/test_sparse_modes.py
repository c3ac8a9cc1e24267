"""Modes from a table of entries against dense eigenvalues."""

import numpy as np
import pytest

from spindle.operators import sparse_modes as M


def dense(xyz, cutoff, kind):
    d = 1 if kind == "gnm" else 3
    h = np.zeros((len(xyz) * d, len(xyz) * d))
    for i in range(len(xyz)):
        for j in range(i):
            r = xyz[i] - xyz[j]
            if r @ r <= cutoff**2:
                u = np.eye(1) if d == 1 else np.outer(r, r) / (r @ r)
                for a, b, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
                    h[a * d : a * d + d, b * d : b * d + d] += s * u
    return h


def cloud(spark, n, seed, size):
    xyz = np.random.default_rng(seed).uniform(0, size, (n, 3)).astype(np.float32).astype(float)
    return xyz, spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "atom long, x double, y double, z double")


@pytest.mark.parametrize(("kind", "n", "count"), [("gnm", 26, 8), ("anm", 8, 5)])
def test_lowest_modes(spark, kind, n, count):
    xyz, nodes = cloud(spark, n, 6, 12 if kind == "gnm" else 6)
    h = dense(xyz, 7.0, kind)
    values = np.linalg.eigvalsh(h)
    want = values[values > 1e-7 * values[-1]][:count]
    rows = M.elastic_modes(nodes, 7.0, kind, count).collect()
    got = {r["mode"]: (r["eigenvalue"], r["residual"]) for r in rows}
    assert np.allclose([got[k][0] for k in range(count)], want, atol=1e-6) and max(r for _, r in got.values()) < 1e-6
    for k in range(count):
        v = np.zeros((n, 3))
        for r in rows:
            if r["mode"] == k:
                v[r["atom"]] = r["vx"], r["vy"], r["vz"]
        v = v[:, :1].ravel() if kind == "gnm" else v.ravel()
        assert np.isclose(np.linalg.norm(v), 1) and np.allclose(h @ v, want[k] * v, atol=1e-5) and v[np.abs(v).argmax()] > 0


def test_equal_eigenvalues_and_too_few(spark):
    # Two equal triangles: 3 four times, 0 twice.
    entries = [(3 * p + a, 3 * p + b, 2.0 if a == b else -1.0) for p in range(2) for a in range(3) for b in range(3)]
    matrix = spark.createDataFrame(entries, "i long, j long, h double")
    rows = M.lowest(matrix, 2).select("mode", "eigenvalue").distinct().collect()
    assert sorted(r["mode"] for r in rows) == [0, 1] and np.allclose([r["eigenvalue"] for r in rows], 3)
    with pytest.raises(M.NoModes, match="only"):
        M.lowest(matrix, 5)
    with pytest.raises(M.NoModes, match="empty"):
        M.lowest(matrix.filter("i < 0"), 1)
    with pytest.raises(M.NoModes, match="settled"):
        M.lowest(matrix, 4, steps=1)
