"""Scalar grids: (i, j, k, v) rows with an affine map from index to world."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SAMPLES = 256**3
#: Tolerance, in cells, at the faces of the grid.
FACE = 1e-4


@dataclass(frozen=True)
class Grid:
    dims: tuple[int, int, int]
    transform: tuple[float, ...]  # column-major 4 x 4

    def matrix(self) -> np.ndarray:
        m = np.array(self.transform, float).reshape(4, 4).T
        if abs(np.linalg.det(m[:3, :3])) < 1e-12:
            raise ValueError("transform is not invertible")
        return m

    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix())

    def to_index(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        m = self.inverse()
        return tuple(x * float(m[r, 0]) + y * float(m[r, 1]) + z * float(m[r, 2]) + float(m[r, 3]) for r in range(3))

    def to_world(self, i: Column, j: Column, k: Column) -> tuple[Column, Column, Column]:
        m = self.matrix()
        return tuple(i * float(m[r, 0]) + j * float(m[r, 1]) + k * float(m[r, 2]) + float(m[r, 3]) for r in range(3))

    def check(self, most: int = MAX_SAMPLES) -> Grid:
        if np.prod(self.dims) > most:
            raise ValueError(f"more than {most} samples")
        self.matrix()
        return self


def volume_stats(samples: DataFrame) -> DataFrame:
    v = F.col("v").cast("double")
    return samples.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sigma"))


def volume_level(stats: dict, level: float, relative: bool) -> float:
    return stats["mean"] + level * stats["sigma"] if relative else level


def component(samples: DataFrame, which: int | str) -> DataFrame:
    """One channel of vector samples (array v), or their magnitude."""
    if which == "magnitude":
        value = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    else:
        value = F.get("v", which).cast("double")
    return samples.select("i", "j", "k", value.alias("v"))


def sample(points: DataFrame, samples: DataFrame, grid: Grid, key: str = "point") -> DataFrame:
    """(point, value): trilinear at world points, 0 outside; eight corners by an equality join."""
    u = grid.to_index(*(F.col(c).cast("double") for c in "xyz"))
    cols, inside = {}, F.lit(True)
    for name, c, n in zip("ijk", u, grid.dims):
        inside = inside & (c >= -FACE) & (c <= n - 1 + FACE)
        held = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))
        low = F.least(F.floor(held), F.lit(max(0, n - 2))).cast("int")
        cols[f"{name}0"], cols[f"t{name}"] = low, held - low
    rows = points.withColumn("__in", inside).select(key, "__in", *(v.alias(k) for k, v in cols.items()))
    corners = []
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                w = (F.col("ti") if a else 1 - F.col("ti")) * (F.col("tj") if b else 1 - F.col("tj")) * (F.col("tk") if c else 1 - F.col("tk"))
                corners.append(F.struct((F.col("i0") + a).alias("i"), (F.col("j0") + b).alias("j"), (F.col("k0") + c).alias("k"), w.alias("w")))
    hit = rows.filter("__in").select(key, F.explode(F.array(*corners)).alias("c")).select(key, "c.*").filter("w <> 0")
    sums = hit.join(samples, ["i", "j", "k"]).groupBy(key).agg(F.sum(F.col("w") * F.col("v").cast("double")).alias("value"))
    return points.select(key).join(sums, key, "left").select(key, F.coalesce("value", F.lit(0.0)).alias("value"))


def gradient(points: DataFrame, samples: DataFrame, grid: Grid, step: float, key: str = "point") -> DataFrame:
    """(point, gx, gy, gz) by central differences; zero where a sample falls outside."""
    shifted = None
    for axis, c in enumerate("xyz"):
        for s in (-1, 1):
            at = {d: (F.col(d).cast("double") + (s * step if d == c else 0.0)) for d in "xyz"}
            rows = points.select(F.struct(F.col(key).alias("p"), F.lit(axis).alias("axis"), F.lit(s).alias("s")).alias("q"), *(v.alias(d) for d, v in at.items()))
            shifted = rows if shifted is None else shifted.union(rows)
    u = grid.to_index(*(F.col(c) for c in "xyz"))
    out = F.lit(False)
    for c, n in zip(u, grid.dims):
        out = out | (c < -FACE) | (c > n - 1 + FACE)
    outside = shifted.groupBy("q.p").agg(F.max(out.cast("int")).alias("out"))
    values = sample(shifted, samples, grid, "q")
    part = [F.sum(F.when(F.col("q.axis") == a, F.col("value") * F.col("q.s"))).alias(f"g{c}") for a, c in enumerate("xyz")]
    sums = values.groupBy("q.p").agg(*part)
    return sums.join(outside, "p").select(F.col("p").alias(key), *(F.when(F.col("out") == 1, 0.0).otherwise(F.col(f"g{c}") / (2 * step)).alias(f"g{c}") for c in "xyz"))


def grid_points(spark, grid: Grid) -> DataFrame:
    """(point, i, j, k, x, y, z) of every sample, x fastest."""
    nx, ny, nz = grid.check().dims
    rows = spark.range(nx * ny * nz).select(F.col("id").alias("point"))
    rows = rows.withColumn("i", (F.col("point") % nx).cast("int")).withColumn("j", F.expr(f"CAST((point div {nx}) % {ny} AS INT)")).withColumn("k", F.expr(f"CAST(point div {nx * ny} AS INT)"))
    return rows.withColumns(dict(zip("xyz", grid.to_world(*(F.col(c).cast("double") for c in "ijk")))))
