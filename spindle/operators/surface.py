"""Solvent-excluded surface grids, tile by tile.

First every tile learns which of its samples a probe's centre can't reach because an atom is nearer
than its radius and the probe's; a task marks the tiles its atoms touch, and marks of one tile are united.
Then each marked tile gets its neighbours' marks as a halo and measures how far its samples are from the
nearest one that a probe reaches.  The surface lies where that is the probe's radius.  No task sees more
than a tile and its halo; samples that no atom covers have distance 0 and need no task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, marching_cubes
from .volume import MAX_SAMPLES, Grid, grid_points

TILE = 16


@dataclass(frozen=True)
class SurfaceField:
    """samples: (i, j, k, v), v the distance to the nearest reachable sample, up to ``deepest``; the surface is at ``level``."""

    grid: Grid
    samples: DataFrame
    level: float
    deepest: float


def surface_grid(atoms: DataFrame, probe: float, resolution: float, most: int) -> tuple[Grid, float]:
    """The grid around atoms (x, y, z, radius), and the largest radius."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    good = finite("x") & finite("y") & finite("z") & finite("radius") & (F.col("radius") > 0)
    ends = [f(F.col(c).cast("double")).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    row = atoms.agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.max(F.col("radius").cast("double")).alias("r"), *ends).first()
    if not row["n"]:
        raise ValueError("a surface needs at least one atom")
    if row["bad"]:
        raise ValueError("coordinates must be finite, radii finite and positive")
    pad, scale = row["r"] + resolution, 1 / resolution
    dims = tuple(math.ceil((row[f"hi{c}"] + pad) * scale - (row[f"lo{c}"] - pad) * scale) for c in "xyz")
    if min(dims) < 2 or math.prod(dims) > most:
        raise ValueError(f"a grid of {dims} samples exceeds {most}")
    origin = [row[f"lo{c}"] - pad for c in "xyz"]
    return Grid(dims, (resolution, 0, 0, 0, 0, resolution, 0, 0, 0, 0, resolution, 0, *origin, 1)), row["r"]


def covered_tiles(atoms: DataFrame, grid: Grid, probe: float, tile: int, reach: int) -> DataFrame:
    """(ti, tj, tk, marks): per tile, a bit for each sample that an atom keeps the probe from.

    Tiles and samples go ``reach`` samples beyond the grid on either side.
    """
    m = grid.matrix()
    step, origin = float(m[0, 0]), m[:3, 3]
    top = [n - 1 + reach for n in grid.dims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = np.arange(tile)
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            far = batch.column(3).to_numpy() + probe
            index = (at - origin) / step
            low = np.maximum(np.ceil(index - (far / step)[:, None]), -reach).astype(int)
            high = np.minimum(np.floor(index + (far / step)[:, None]), top).astype(int)
            held: dict[tuple, np.ndarray] = {}
            for p, r, lo, hi in zip(index * step, far, low, high):
                for t in np.ndindex(*np.maximum(hi // tile - lo // tile + 1, 0)):
                    t = tuple((lo // tile + t).tolist())
                    marks = held.setdefault(t, np.zeros((tile,) * 3, bool))
                    d = [((offsets + tile * t[a]) * step - p[a]) ** 2 for a in range(3)]
                    marks |= d[0][:, None, None] + d[1][None, :, None] + d[2][None, None, :] < r * r
                if len(held) > 2_000:
                    yield packed(held)
                    held = {}
            if held:
                yield packed(held)

    def packed(held: dict) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([*(pa.array([k[a] for k in keys], pa.int32()) for a in range(3)), pa.array([np.packbits(held[k]).tobytes() for k in keys], pa.binary())], ["ti", "tj", "tk", "marks"])

    def united(table: pa.Table) -> pa.Table:
        marks = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("marks").to_pylist()])
        return pa.table({**{c: table.column(c)[:1] for c in ("ti", "tj", "tk")}, "marks": pa.array([marks.tobytes()], pa.binary())})

    schema = "ti int, tj int, tk int, marks binary"
    rows = atoms.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius"))).distinct()
    return rows.mapInArrow(run, schema).groupBy("ti", "tj", "tk").applyInArrow(united, schema)


def distances(tiles: DataFrame, grid: Grid, tile: int, reach: int, deepest: float) -> DataFrame:
    """(i, j, k, v) of the covered samples in the grid."""
    step = float(grid.matrix()[0, 0])
    around = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip("ijk", t))) for t in np.ndindex(3, 3, 3)))
    sent = tiles.select("*", F.explode(around).alias("d")).select(*((F.col(f"t{c}") + F.col(f"d.d{c}") - 1).alias(f"t{c}") for c in "ijk"), *((2 - F.col(f"d.d{c}")).alias(f"d{c}") for c in "ijk"), "marks")
    inside = F.lit(True)
    for c, n in zip("ijk", grid.dims):
        inside = inside & F.col(f"t{c}").between(0, (n - 1) // tile)
    sent = sent.filter(inside)
    dims, wide = grid.dims, tile + 2 * reach

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t = np.array([table.column(f"t{c}")[0].as_py() for c in "ijk"])
        covered = np.zeros((3 * tile,) * 3, bool)
        for *d, marks in zip(*(table.column(f"d{c}").to_pylist() for c in "ijk"), table.column("marks").to_pylist()):
            f = [tile * x for x in d]
            covered[f[0] : f[0] + tile, f[1] : f[1] + tile, f[2] : f[2] + tile] = np.unpackbits(np.frombuffer(marks, np.uint8))[: tile**3].reshape((tile,) * 3)
        cut = slice(tile - reach, 2 * tile + reach)
        covered = covered[cut, cut, cut]
        # Squared distances, axis by axis: the least over all shifts along one axis of what the others gave.
        square = np.where(covered, np.inf, 0.0)
        for axis in range(3):
            best = square.copy()
            for s in range(1, reach + 1):
                near, far = [slice(None)] * 3, [slice(None)] * 3
                near[axis], far[axis] = slice(0, wide - s), slice(s, wide)
                best[tuple(near)] = np.minimum(best[tuple(near)], square[tuple(far)] + s * s)
                best[tuple(far)] = np.minimum(best[tuple(far)], square[tuple(near)] + s * s)
            square = best
        own = slice(reach, reach + tile)
        v = np.minimum(np.sqrt(square[own, own, own]) * step, deepest)
        at = np.argwhere(covered[own, own, own])
        value, place = v[tuple(at.T)], at + tile * t
        keep = (place < dims).all(1)
        return pa.table({**{c: pa.array(place[keep, a].astype(np.int32)) for a, c in enumerate("ijk")}, "v": pa.array(value[keep])})

    return sent.groupBy("ti", "tj", "tk").applyInArrow(run, "i int, j int, k int, v double")


def surface_field(atoms: DataFrame, probe: float = 1.4, resolution: float = 0.5, most: int = MAX_SAMPLES) -> SurfaceField:
    """The grid of a solvent-excluded surface of atoms (x, y, z, radius).

    A sample that a probe's centre may occupy, its distance to every atom being at least the atom's radius and the
    probe's, has value 0; any other the distance to the nearest such sample, up to the probe's radius and the
    largest atom's.  What lies beyond the grid is reachable.  The lattice limits how exact a distance is.
    """
    if not (0 <= probe <= 10 and 0.01 <= resolution <= 20) or isinstance(most, bool) or not isinstance(most, int) or most < 1:
        raise ValueError("probe must lie in [0, 10], resolution in [0.01, 20], most must be a positive integer")
    grid, widest = surface_grid(atoms, probe, resolution, most)
    deepest = probe + widest
    reach = math.ceil(deepest / resolution)
    tile = max(TILE, reach)
    found = distances(covered_tiles(atoms, grid, probe, tile, reach), grid, tile, reach, deepest)
    every = grid_points(atoms.sparkSession, grid).select("i", "j", "k")
    samples = every.join(found, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("v", F.lit(0.0)).alias("v"))
    return SurfaceField(grid, samples, probe, deepest)


def molecular_surface(atoms: DataFrame, probe: float = 1.4, resolution: float = 0.5) -> Mesh:
    """The mesh of the surface; normals point out of the molecule."""
    field = surface_field(atoms, probe, resolution)
    return marching_cubes(field.samples, field.grid, field.level)
