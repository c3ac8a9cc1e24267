"""The surface grid against a dense one, and what it refuses."""

import numpy as np
import pytest

from spindle.operators import surface

SCHEMA = "x double, y double, z double, radius double"


def dense(points, probe, grid, deepest):
    """All samples against all atoms, then against all samples that a probe reaches, far beyond the grid."""
    m = grid.matrix()
    step, pad = m[0, 0], int(np.ceil(deepest / m[0, 0])) + 2
    index = np.stack(np.meshgrid(*[np.arange(-pad, n + pad) for n in grid.dims], indexing="ij"), -1).reshape(-1, 3)
    world = index * step
    free = np.ones(len(index), bool)
    for x, y, z, r in points:
        free &= ((world - (np.array([x, y, z]) - m[:3, 3])) ** 2).sum(1) >= (r + probe) ** 2
    inside = ((index >= 0) & (index < grid.dims)).all(1)
    covered = world[inside & ~free]
    open_ = world[free & (np.abs(world - covered.mean(0)).max(1) < np.abs(covered - covered.mean(0)).max() + deepest)]
    square = (open_**2).sum(1)
    out = {tuple(i.tolist()): 0.0 for i in index[inside]}
    for i, w in zip(index[inside & ~free], covered):
        out[tuple(i.tolist())] = min(deepest, float(np.sqrt(max(0, (square - 2 * open_ @ w).min() + w @ w))))
    return out


@pytest.mark.parametrize("probe,resolution,n", [(1.4, 1.1, 25), (0.0, 0.9, 6), (2.5, 1.3, 200)])
def test_equals_a_dense_field(spark, probe, resolution, n):
    rng = np.random.default_rng(n)
    points = [(*map(float, rng.normal(0, 2.5, 3)), float(rng.uniform(1, 2))) for _ in range(n)]
    df = spark.createDataFrame(points + points[:3], SCHEMA).repartition(3)
    field = surface.surface_field(df, probe, resolution)
    got = {(r["i"], r["j"], r["k"]): r["v"] for r in field.samples.collect()}
    want = dense(points, probe, field.grid, field.deepest)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_a_ball_has_its_surface(spark):
    m = surface.molecular_surface(spark.createDataFrame([(1.0, 2.0, 3.0, 2.0)], SCHEMA), 1.4, 0.25)
    v = np.array([[r["x"], r["y"], r["z"]] for r in m.vertices.collect()])
    assert np.abs(np.linalg.norm(v - [1, 2, 3], axis=1) - 2).max() < 0.25
    assert m.triangles.count() > 1_000


def test_refusals(spark):
    one = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], SCHEMA)
    for bad in ({"probe": float("nan")}, {"probe": -1.0}, {"probe": 11.0}, {"resolution": 0.0}, {"resolution": float("inf")}, {"most": 0}, {"most": 1.5}):
        with pytest.raises(ValueError):
            surface.surface_field(one, **bad)
    for row in [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, -1.0), (float("nan"), 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (0.0, float("inf"), 0.0, 1.0), (1e8, 0.0, 0.0, 1.0)]:
        with pytest.raises(ValueError):
            surface.surface_field(one.union(spark.createDataFrame([row], SCHEMA)))
    with pytest.raises(ValueError):
        surface.surface_field(one.filter("false"))
