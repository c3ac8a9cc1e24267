"""Three-vectors and affine maps as columns: plain scalars, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{suffix}").cast("double") for c in "xyz")


def lit(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    n = length(a)
    return tuple(F.when(n > 0, p / F.when(n > 0, n)).otherwise(F.lit(0.0)) for p in a)


def lerp(a: Vec, b: Vec, t) -> Vec:
    return tuple(p + (q - p) * t for p, q in zip(a, b))


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(lo)) / F.lit(hi - lo)))
    return t * t * (F.lit(3.0) - 2 * t)


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed angle in degrees, in (-180, 180]; NaN where points coincide."""
    b1, b2, b3 = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    size = length(b2)
    m = tuple(p / F.when(size > 0, size) for p in cross(n1, b2))
    deg = F.degrees(-F.atan2(dot(m, n2), dot(n1, n2)))
    return F.when(size == 0, F.lit(float("nan"))).when(deg == -180, F.lit(180.0)).otherwise(deg)


def affine(m: list[float], v: Vec) -> Vec:
    """A column-major 4 x 4 matrix applied to points."""
    return tuple(v[0] * m[r] + v[1] * m[4 + r] + v[2] * m[8 + r] + F.lit(float(m[12 + r])) for r in range(3))


def affine_column(m: Column, v: Vec) -> Vec:
    g = lambda i: F.get(m, i)
    return tuple(v[0] * g(r) + v[1] * g(4 + r) + v[2] * g(8 + r) + g(12 + r) for r in range(3))


def minimum_image(d: Vec, box: tuple[float, float, float]) -> Vec:
    """The shortest image of a difference in an orthorhombic box."""
    return tuple(p - F.lit(float(b)) * F.floor(p / F.lit(float(b)) + 0.5) for p, b in zip(d, box))
