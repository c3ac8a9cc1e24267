"""Curve segments between guides: spline points, tangents, carried normals, sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEGMENT_ROWS = "segment long, j int, x double, y double, z double, tx double, ty double, tz double, nx double, ny double, nz double, bx double, by double, bz double"


def spline(p0, p1, p2, p3, t, tension):
    """A cubic from p1 to p2 whose slopes are those of its neighbours times the tension."""
    v0, v1 = (p2 - p0) * tension, (p3 - p1) * tension
    return ((2 * p1 - 2 * p2 + v0 + v1) * t + (3 * p2 - 3 * p1 - 2 * v0 - v1)) * t * t + v0 * t + p1


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def orthogonal(tangent: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The unit vector across the tangent in the plane of tangent and v."""
    return unit(v - tangent * (tangent * v).sum(-1, keepdims=True))


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    d = np.clip((a * b).sum(-1, keepdims=True), -1, 1)
    theta = np.arccos(d) * t
    return a * np.cos(theta) + unit(b - a * d) * np.sin(theta)


def points_and_tangents(p: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, tension: float, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Both (segments, n + 1, 3) from guides (segments, 5, 3); block ends are pinned to tension 0.5."""
    begin, end = np.where(first, 0.5, tension)[:, None], np.where(last, 0.5, tension)[:, None]
    points, tangents = np.empty((len(p), n + 1, 3)), np.empty((len(p), n + 1, 3))
    for j in range(n + 1):
        t = j / n
        if t < 1 - shift:
            at, guides, te = t + shift, [p[:, k] for k in range(4)], begin + (tension - begin) * t
            slope = begin
        else:
            at, guides, te = t - (1 - shift), [p[:, k] for k in range(1, 5)], tension + (end - tension) * t
            slope = te
        points[:, j] = spline(*guides, at, te)
        tangents[:, j] = unit(spline(*guides, at + 0.01, slope) - spline(*guides, at - 0.01, slope))
    return points, tangents


def normals_and_binormals(tangents: np.ndarray, d12: np.ndarray, d23: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals carried from the first to the last direction across the tangents, then smoothed."""
    n = tangents.shape[1]
    now, goal = orthogonal(tangents[:, 0], d12), orthogonal(tangents[:, -1], d23)
    goal = np.where((now * goal).sum(-1, keepdims=True) < 0, -goal, goal)
    normals = np.empty_like(tangents)
    for i in range(n):
        u = i / (n - 1) if n > 1 else 0.0
        j = u * u * (3 - 2 * u) * (n - 1)
        now = orthogonal(tangents[:, i], slerp(now, goal, 0.0 if i == 0 else 1 / (n - j)))
        normals[:, i] = now
    for i in range(1, n - 1):
        normals[:, i] = (normals[:, i - 1] + normals[:, i] + normals[:, i + 1]) / 3
    return normals, unit(np.cross(tangents, normals))


def curve_segments(guides: DataFrame, samples: int, tension: float = 0.5, shift: float = 0.5) -> DataFrame:
    """(segment, j, x .., tx .., nx .., bx ..): ``samples`` + 1 points along every segment.

    ``guides`` has segment, p (five guides as 15 doubles), d12 and d23 (directions) and the flags
    first and last.  A segment is a row of its own, so the work spreads with the rows.
    """

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in tables:
            p = np.array(g["p"].tolist(), float).reshape(-1, 5, 3)
            points, tangents = points_and_tangents(p, g["first"].to_numpy(bool), g["last"].to_numpy(bool), samples, tension, shift)
            normals, binormals = normals_and_binormals(tangents, np.array(g["d12"].tolist(), float).reshape(-1, 3), np.array(g["d23"].tolist(), float).reshape(-1, 3))
            out = {"segment": np.repeat(g["segment"].to_numpy(), samples + 1), "j": np.tile(np.arange(samples + 1), len(g))}
            for name, v in (("", points), ("t", tangents), ("n", normals), ("b", binormals)):
                out |= {f"{name}{c}": v[:, :, k].ravel() for k, c in enumerate("xyz")}
            yield pd.DataFrame(out)

    return guides.select("segment", "p", "d12", "d23", "first", "last").mapInPandas(run, SEGMENT_ROWS)


def sizes(w: tuple[float, float, float], samples: int, shift: float = 0.5) -> list[float]:
    """A width along a segment from those of three neighbouring guides."""
    out = []
    for j in range(samples + 1):
        t = j / samples
        a, b, u = (w[0], w[1], t + shift) if t < 1 - shift else (w[1], w[2], t - (1 - shift))
        out.append(a + (b - a) * u)
    return out
