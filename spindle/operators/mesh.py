"""Isosurfaces by marching cubes, as a table of shared vertices and a table of triangles.

A cell's case is one expression over its eight corners; a table of 256 cases, made by a rule, is
broadcast and joined to it.  A vertex is named by the grid edge it lies on, so the cells around an edge
name the same one and the surface is closed wherever it stays inside the grid.

The rule: on a face whose corners below the level lie across from each other, each of the two is cut
off by itself.  That depends on the face alone, so both its cells agree.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .volume import Grid

# The corners of a cell in order, bit n of a case being set where corner n is below the level.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


def _edge(a: tuple, b: tuple) -> tuple[tuple, int]:
    """A cell's edge as (corner it starts from, axis)."""
    low = min(a, b)
    return low, next(k for k in range(3) if a[k] != b[k])


def _faces() -> list[list[tuple]]:
    """Each face's corners, in the order that turns left seen from outside."""
    out = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            ring = []
            for du, dv in ((0, 0), (1, 0), (1, 1), (0, 1)):
                c = [0, 0, 0]
                c[axis], c[u], c[v] = side, du, dv
                ring.append(tuple(c))
            out.append(ring if side else ring[::-1])
    return out


def _on_face(a: tuple, b: tuple) -> bool:
    """Whether two edges of a cell lie on one face."""
    ends = [[c, tuple(x + (k == axis) for k, x in enumerate(c))] for c, axis in (a, b)]
    return any(len({c[k] for pair in ends for c in pair}) == 1 for k in range(3))


def triangulated(loop: list[tuple]) -> list[tuple]:
    """Triangles of a loop none of whose inner edges lies on a face, where the next cell could have the same."""

    def split(f: int, t: int) -> list[tuple] | None:
        """The part of the loop between f and t, to which the edge from f to t belongs."""
        if t - f < 2:
            return []
        for m in range(f + 1, t):
            if (m - f > 1 and _on_face(loop[f], loop[m])) or (t - m > 1 and _on_face(loop[m], loop[t])):
                continue
            parts = split(f, m), split(m, t)
            if None not in parts:
                return [(loop[f], loop[m], loop[t]), *parts[0], *parts[1]]
        return None

    return split(0, len(loop) - 1)


@functools.cache
def triangle_table() -> dict[int, list[tuple]]:
    """Case -> triangles, each three edges ((di, dj, dk), axis), turning left seen from below the level."""
    table = {}
    for case in range(256):
        low = {c for n, c in enumerate(CORNERS) if case >> n & 1}
        after = {}
        for ring in _faces():
            for n, corner in enumerate(ring):
                # A run of corners below the level is cut off from where it ends to where it begins.
                if corner in low and ring[n - 1] not in low:
                    end = n
                    if sum(c in low for c in ring) != 2 or ring[(n + 2) % 4] not in low:
                        while ring[(end + 1) % 4] in low:
                            end += 1
                    after[_edge(ring[end % 4], ring[(end + 1) % 4])] = _edge(ring[n - 1], corner)
        triangles = []
        while after:
            first = min(after)
            loop, at = [first], after.pop(first)
            while at != first:
                loop.append(at)
                at = after.pop(at)
            triangles += triangulated(loop)
        table[case] = triangles
    return table


def triangle_frame(spark: SparkSession) -> DataFrame:
    """(case, nth, edges): the triangles of every case; an edge is (di, dj, dk, axis)."""
    rows = [(case, nth, [(*corner, axis) for corner, axis in t]) for case, ts in triangle_table().items() for nth, t in enumerate(ts)]
    return spark.createDataFrame(rows, "case int, nth int, edges array<struct<di:int,dj:int,dk:int,axis:int>>")


@dataclass(frozen=True)
class Mesh:
    """vertices: (vertex, x, y, z, nx, ny, nz); triangles: (i, j, k, nth, a, b, c), the cell and three vertices."""

    vertices: DataFrame
    triangles: DataFrame


def cell_cases(samples: DataFrame, level: float) -> DataFrame:
    """(i, j, k, case) of the cells that the surface cuts."""
    corners = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip("ijk", corner)), F.lit(1 << n).alias("bit")) for n, corner in enumerate(CORNERS)))
    below = (F.col("v").cast("double") < level).cast("int")
    rows = samples.select("i", "j", "k", below.alias("below"), F.explode(corners).alias("s"))
    cells = rows.select(*((F.col(c) - F.col(f"s.d{c}")).alias(c) for c in "ijk"), (F.col("s.bit") * F.col("below")).alias("bits"))
    cells = cells.groupBy("i", "j", "k").agg(F.count("*").alias("n"), F.sum("bits").cast("int").alias("case"))
    return cells.filter("n = 8 AND case > 0 AND case < 255").drop("n")


def vertex_id(grid: Grid, i, j, k, axis):
    nx, ny, _ = grid.dims
    return (F.lit(3).cast("long") * (i.cast("long") + F.lit(nx) * (j.cast("long") + F.lit(ny).cast("long") * k))) + axis


def sample_gradients(samples: DataFrame, at: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, k, g0, g1, g2) of the samples ``at`` (i, j, k): differences of the neighbours, downhill, clamped at the faces."""
    hops = []
    for axis, (c, n) in enumerate(zip("ijk", grid.dims)):
        for step in (-1, 1):
            moved = {d: F.col(d) for d in "ijk"} | {c: F.least(F.greatest(F.col(c) + step, F.lit(0)), F.lit(n - 1))}
            hops.append(F.struct(*(moved[d].cast("int").alias(d) for d in "ijk"), F.lit(axis).alias("axis"), F.lit(-step).alias("sign")))
    rows = at.select(F.struct("i", "j", "k").alias("p"), F.explode(F.array(*hops)).alias("h")).select("p", "h.*").join(samples.select("i", "j", "k", "v"), ["i", "j", "k"])
    part = [F.sum(F.when(F.col("axis") == a, F.col("v").cast("double") * F.col("sign"))).alias(f"g{a}") for a in range(3)]
    return rows.groupBy("p").agg(*part).select("p.*", "g0", "g1", "g2")


def unit(parts: list) -> list:
    length = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    return [p / F.when(length == 0, 1.0).otherwise(length) for p in parts]


def mesh_vertices(samples: DataFrame, grid: Grid, level: float) -> DataFrame:
    """One row for each grid edge that crosses the level: where, and the unit normal towards lower values."""
    own = samples.select("i", "j", "k", F.col("v").cast("double").alias("v"))
    ends = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(far).alias("far")) for a in range(3) for far in (0, 1)))
    rows = own.select("*", F.explode(ends).alias("e"))
    back = [(F.col(c) - F.when(F.col("e.axis") == a, F.col("e.far")).otherwise(0)).alias(c) for a, c in enumerate("ijk")]
    edge = rows.select(*back, F.col("e.axis").alias("axis"), F.col("e.far").alias("far"), "v").groupBy("i", "j", "k", "axis")
    edge = edge.agg(F.max(F.when(F.col("far") == 0, F.col("v"))).alias("va"), F.max(F.when(F.col("far") == 1, F.col("v"))).alias("vb"))
    edge = edge.filter(F.col("va").isNotNull() & F.col("vb").isNotNull() & ((F.col("va") < level) != (F.col("vb") < level)))
    far = {f"{c}2": F.col(c) + (F.col("axis") == a).cast("int") for a, c in enumerate("ijk")}
    edge = edge.withColumns(far).withColumn("t", (F.lit(level) - F.col("va")) / (F.col("vb") - F.col("va")))
    at = edge.select("i", "j", "k").union(edge.select("i2", "j2", "k2")).distinct()
    slopes = sample_gradients(samples, at, grid)
    one = slopes.withColumnsRenamed({f"g{a}": f"a{a}" for a in range(3)})
    other = slopes.withColumnsRenamed({**{c: f"{c}2" for c in "ijk"}, **{f"g{a}": f"b{a}" for a in range(3)}})
    found = edge.join(one, ["i", "j", "k"]).join(other, ["i2", "j2", "k2"])
    t = F.col("t")
    place = [F.col(c) + F.when(F.col("axis") == a, t).otherwise(0.0) for a, c in enumerate("ijk")]
    slope = unit([F.col(f"a{a}") + t * (F.col(f"b{a}") - F.col(f"a{a}")) for a in range(3)])
    m = grid.matrix()[:3, :3]
    side = float(np.sign(np.linalg.det(m))) * np.linalg.det(m) * np.linalg.inv(m).T  # keeps normals on their side
    normal = unit([sum((slope[c] * float(side[r, c]) for c in range(3)), F.lit(0.0)) for r in range(3)])
    world = grid.to_world(*place)
    return found.select(vertex_id(grid, F.col("i"), F.col("j"), F.col("k"), F.col("axis")).alias("vertex"), *(v.alias(n) for n, v in zip(("x", "y", "z", "nx", "ny", "nz"), [*world, *normal])))


def mesh_triangles(samples: DataFrame, grid: Grid, level: float) -> DataFrame:
    """(i, j, k, nth, a, b, c): each cell's triangles, turning left seen from the lower side."""
    cases = cell_cases(samples, level).join(F.broadcast(triangle_frame(samples.sparkSession)), "case")  # some hundred rows
    edge = lambda n: F.element_at("edges", n)
    corner = [vertex_id(grid, *(F.col(c) + edge(n)[f"d{c}"] for c in "ijk"), edge(n)["axis"]) for n in (1, 2, 3)]
    if np.linalg.det(grid.matrix()[:3, :3]) < 0:
        corner[1], corner[2] = corner[2], corner[1]
    return cases.select("i", "j", "k", "nth", *(v.alias(n) for n, v in zip("abc", corner)))


def marching_cubes(samples: DataFrame, grid: Grid, level: float = 0.0) -> Mesh:
    """The surface between samples (i, j, k, v) below ``level`` and the others.

    Cells that lack a sample have no surface.  A reflecting transform turns triangles round and leaves normals on their side.
    """
    if not np.isfinite(level):
        raise ValueError("level must be finite")
    if min(grid.dims) < 2:
        raise ValueError("a grid needs two samples an axis at least")
    return Mesh(mesh_vertices(samples, grid, level), mesh_triangles(samples, grid, level))
