"""Field lines through a potential grid: seeds, and fourth-order steps along the field's direction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import volume

LINE_ROWS = "line long, k int, x double, y double, z double, field double"


class Samples:
    """A dense grid in a task's memory: trilinear values and gradients at many points at once."""

    def __init__(self, values: np.ndarray, grid: volume.Grid, step: float):
        self.values, self.inverse, self.step = values, grid.inverse(), step
        self.top = np.array(values.shape) - 1

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, inside) of points (n, 3)."""
        u = p @ self.inverse[:3, :3].T + self.inverse[:3, 3]
        inside = ((u >= -volume.FACE) & (u <= self.top + volume.FACE)).all(1)
        u = np.clip(u, 0, self.top)
        low = np.minimum(np.floor(u), np.maximum(self.top - 1, 0)).astype(int)
        t = u - low
        out = np.zeros(len(p))
        for corner in np.ndindex(2, 2, 2):
            at = np.minimum(low + corner, self.top)
            out += np.where(corner, t, 1 - t).prod(1) * self.values[at[:, 0], at[:, 1], at[:, 2]]
        return np.where(inside, out, 0.0), inside

    def field(self, p: np.ndarray) -> np.ndarray:
        """Minus the gradient by central differences; zero where a sample is outside."""
        e, whole = np.zeros_like(p), np.ones(len(p), bool)
        for axis in range(3):
            d = np.zeros(3)
            d[axis] = self.step
            (a, ia), (b, ib) = self.at(p + d), self.at(p - d)
            e[:, axis] = (b - a) / (2 * self.step)
            whole &= ia & ib
        return np.where(whole[:, None], e, 0.0)


def _unit(e: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(e, axis=1, keepdims=True)
    return np.divide(e, size, out=np.zeros_like(e), where=size > 0)


def trace(s: Samples, seeds: np.ndarray, steps: int, h: float, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(lines, steps + 1, 3) points from each seed and the field's strength there, -1 once a line has stopped."""
    p, e = seeds.copy(), s.field(seeds)
    usable = lambda q, f: (np.linalg.norm(f, axis=1) >= least) & (np.abs(s.at(q)[0]) <= most)
    alive = usable(p, e)
    points, strength = [p.copy()], [np.where(alive, np.linalg.norm(e, axis=1), -1.0)]
    for _ in range(steps):
        k1 = _unit(e)
        k2 = _unit(s.field(p + 0.5 * h * k1))
        k3 = _unit(s.field(p + 0.5 * h * k2))
        k4 = _unit(s.field(p + h * k3))
        q = p + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        f = s.field(q)
        alive = alive & usable(q, f)
        p, e = np.where(alive[:, None], q, p), np.where(alive[:, None], f, e)
        points.append(p.copy()), strength.append(np.where(alive, np.linalg.norm(e, axis=1), -1.0))
    return np.stack(points, 1), np.stack(strength, 1)


def field_lines(seeds: DataFrame, samples: DataFrame, grid: volume.Grid, steps: int = 64, h: float = 0.5, least: float = 1e-3, most: float = 1e9, step: float = 0.5) -> DataFrame:
    """(line, k, x, y, z, field), k from -steps to steps: lines both ways from seeds (line, x, y, z).

    A stopped line (out of the grid, a weak field, too high a potential) repeats its last point
    with field -1.  The grid, of a checked number of samples, is sent to every task; the seeds
    spread over the tasks.
    """
    spark = seeds.sparkSession
    dims = grid.check().dims
    rows = samples.select("i", "j", "k", F.col("v").cast("double").alias("v")).toPandas()
    dense = np.zeros(dims, np.float32)
    dense[rows["i"], rows["j"], rows["k"]] = rows["v"]
    held = spark.sparkContext.broadcast(dense)

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Samples(held.value.astype(float), grid, step)
        for t in tables:
            at = t[["x", "y", "z"]].to_numpy(float)
            ahead, strong = trace(s, at, steps, h, least, most)
            back, weak = trace(s, at, steps, -h, least, most)
            points = np.concatenate([back[:, :0:-1], ahead], axis=1)
            field = np.concatenate([weak[:, :0:-1], strong], axis=1)
            flat = points.reshape(-1, 3)
            yield pd.DataFrame({"line": np.repeat(t["line"].to_numpy(), 2 * steps + 1), "k": np.tile(np.arange(-steps, steps + 1), len(t)), "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2], "field": field.ravel()})

    return seeds.select("line", "x", "y", "z").mapInPandas(run, LINE_ROWS)


def lattice_seeds(spark: SparkSession, grid: volume.Grid, spacing: float, most: int) -> DataFrame:
    """(line, x, y, z): a lattice through the grid; of more than ``most`` seeds every so many-th is taken."""
    m = grid.matrix()
    ticks = []
    for a, n in enumerate(grid.dims):
        d = spacing / np.linalg.norm(m[:3, a])
        at = np.arange(d / 2, n - 1, d)
        ticks.append(at if len(at) else np.array([(n - 1) / 2]))
    total = int(np.prod([len(t) for t in ticks]))
    every = max(1, -(-total // most))
    rows = spark.range(0, total, every).select(F.col("id").alias("n"), (F.col("id") / every).cast("long").alias("line"))
    nx, ny = len(ticks[0]), len(ticks[1])
    pick = lambda k, i: F.get(F.array(*(F.lit(float(x)) for x in ticks[k])), i.cast("int"))
    u = pick(0, F.col("n") % nx), pick(1, F.floor(F.col("n") / nx) % ny), pick(2, F.floor(F.col("n") / (nx * ny)))
    return rows.select("line", *(x.alias(c) for c, x in zip("xyz", grid.to_world(*u))))
