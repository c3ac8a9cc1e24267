"""Meshes: closed, shared vertices, normals, orientation."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import mesh, volume

IDENTITY = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def test_every_case_is_closed_within_its_faces():
    """The triangles' edges that only one triangle has lie on the faces of the cell, and neighbours agree on them."""
    for case, triangles in mesh.triangle_table().items():
        low = {c for n, c in enumerate(mesh.CORNERS) if case >> n & 1}
        crossed = {mesh._edge(a, b) for a in mesh.CORNERS for b in mesh.CORNERS if sum(x != y for x, y in zip(a, b)) == 1 and (a in low) != (b in low)}
        assert {e for t in triangles for e in t} == crossed
        directed = collections.Counter((t[k], t[(k + 1) % 3]) for t in triangles for k in range(3))
        assert max(directed.values(), default=1) == 1
        for a, b in directed:
            if (b, a) not in directed:
                ends = [{c, tuple(x + (k == axis) for k, x in enumerate(c))} for c, axis in (a, b)]
                corners = ends[0] | ends[1]
                assert any(len({c[k] for c in corners}) == 1 for k in range(3)), case


def samples(spark, f, n):
    g = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    return spark.createDataFrame([(int(i), int(j), int(k), float(f(np.array([i, j, k], float)))) for i, j, k in g], "i int, j int, k int, v double")


def checked(m, closed=True):
    v = {r["vertex"]: np.array([r["x"], r["y"], r["z"]]) for r in m.vertices.collect()}
    normals = {r["vertex"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in m.vertices.collect()}
    triangles = [(r["a"], r["b"], r["c"]) for r in m.triangles.collect()]
    assert {x for t in triangles for x in t} == set(v)
    edges = collections.Counter((t[k], t[(k + 1) % 3]) for t in triangles for k in range(3))
    assert max(edges.values()) == 1
    if closed:
        assert all((b, a) in edges for a, b in edges)
    return v, normals, triangles


@pytest.mark.parametrize("transform", [IDENTITY, (-0.5, 0, 0, 0, 0.1, 0.7, 0, 0, 0, 0, 2, 0, 3, 4, 5, 1)])
def test_a_ball(spark, transform):
    centre = np.array([4.3, 4.6, 4.9])
    grid = volume.Grid((10, 10, 10), transform)
    v, normals, triangles = checked(mesh.marching_cubes(samples(spark, lambda x: 3.2 - np.linalg.norm(x - centre), 10), grid))
    m = grid.matrix()
    back = np.linalg.inv(m[:3, :3])
    for x in v:
        assert abs(np.linalg.norm(back @ (v[x] - m[:3, 3]) - centre) - 3.2) < 0.1
    # Outwards is where the values are lower: normals and windings point there, whatever the transform.
    middle = m[:3, :3] @ centre + m[:3, 3]
    for a, b, c in triangles:
        across = np.cross(v[b] - v[a], v[c] - v[a])
        assert np.linalg.norm(across) < 1e-9 or across @ (v[a] - middle) > 0
    assert all(normals[x] @ (v[x] - middle) > 0 and abs(np.linalg.norm(normals[x]) - 1) < 1e-9 for x in v)
    assert len(v) - 3 * len(triangles) // 2 + len(triangles) == 2  # one sphere


def test_noise_is_watertight(spark):
    """All cases occur; the surface is closed if the border is below the level."""
    rng = np.random.default_rng(6)
    values = rng.normal(size=(12, 12, 12))
    values[[0, -1]] = values[:, [0, -1]] = values[:, :, [0, -1]] = -1
    field = samples(spark, lambda x: values[tuple(x.astype(int))], 12)
    grid = volume.Grid((12, 12, 12), IDENTITY)
    assert mesh.cell_cases(field, 0.0).select("case").distinct().count() > 150
    checked(mesh.marching_cubes(field, grid))


def test_nothing_to_cut_and_bad_input(spark):
    grid = volume.Grid((3, 3, 3), IDENTITY)
    flat = samples(spark, lambda x: 1.0, 3)
    out = mesh.marching_cubes(flat, grid)
    assert out.vertices.isEmpty() and out.triangles.isEmpty()
    part = mesh.marching_cubes(samples(spark, lambda x: x[0] - 0.5, 3).filter("k < 2"), grid)
    assert part.triangles.count() == 4  # cells that lack samples have none
    with pytest.raises(ValueError):
        mesh.marching_cubes(flat, grid, float("nan"))
    with pytest.raises(ValueError):
        mesh.marching_cubes(flat, volume.Grid((1, 3, 3), IDENTITY))
    assert mesh.marching_cubes(flat.filter(F.lit(False)), grid).vertices.isEmpty()
