"""Electrostatics: parameters, switched kernels, potentials and fields of point charges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial, volume

# Constants of nature in SI units, and joules in a kilocalorie.
ELEMENTARY_CHARGE, AVOGADRO, BOLTZMANN, VACUUM_PERMITTIVITY, KCAL = 1.602176634e-19, 6.02214076e23, 1.380649e-23, 8.8541878128e-12, 4184.0
COULOMB = ELEMENTARY_CHARGE**2 * AVOGADRO / (4 * math.pi * VACUUM_PERMITTIVITY) * 1e10 / KCAL
GAS = BOLTZMANN * AVOGADRO / KCAL
EPSILON = {"vacuum": 1.0, "distance": 4.0, "debye": 78.54}
#: Bytes of charges that may be sent to every task (32 a charge).
MAX_BROADCAST = 64 << 20


def debye_kappa(ionic_strength: float, epsilon: float, temperature: float) -> float:
    """Inverse Debye length in 1/A for an ionic strength in mol/l."""
    if ionic_strength == 0:
        return 0.0
    return math.sqrt(2 * AVOGADRO * ELEMENTARY_CHARGE**2 * ionic_strength * 1e3 / (VACUUM_PERMITTIVITY * epsilon * BOLTZMANN * temperature)) * 1e-10


@dataclass(frozen=True)
class Electrostatics:
    """Checked options; potentials come out in kT/e or kcal/mol/e, fields in that unit per Angstrom."""

    model: str = "distance"
    epsilon: float | None = None
    ionic_strength: float = 0.15
    temperature: float = 298.15
    min_distance: float = 1.0
    unit: str = "kT/e"
    cutoff: float | None = None
    switch_width: float | None = None

    def __post_init__(self):
        if self.model not in EPSILON:
            raise TypeError("model must be vacuum, distance or debye")
        if self.unit not in ("kT/e", "kcal/mol/e"):
            raise TypeError("unit must be kT/e or kcal/mol/e")
        if self.epsilon is None:
            object.__setattr__(self, "epsilon", EPSILON[self.model])
        for name in ("epsilon", "temperature", "min_distance"):
            if not 0 < getattr(self, name) < math.inf:
                raise ValueError(f"{name} must be positive and finite")
        if not 0 <= self.ionic_strength < math.inf:
            raise ValueError("ionic_strength must be finite and not negative")
        if self.cutoff is None and self.switch_width is not None:
            raise TypeError("switch_width needs a cutoff")
        if self.cutoff is not None:
            if self.switch_width is None:
                object.__setattr__(self, "switch_width", 2.0)
            if not (0 < self.cutoff < math.inf and 0 < self.switch_width < math.inf):
                raise ValueError("cutoff and switch_width must be positive and finite")
            if self.switch_on < self.min_distance:
                raise ValueError("cutoff - switch_width must be at least min_distance")

    @property
    def switch_on(self) -> float:
        return self.cutoff - self.switch_width

    @property
    def kappa(self) -> float:
        return debye_kappa(self.ionic_strength, self.epsilon, self.temperature) if self.model == "debye" else 0.0

    @property
    def scale(self) -> float:
        return COULOMB / self.epsilon / (GAS * self.temperature if self.unit == "kT/e" else 1.0)

    def switch(self, r: Column) -> tuple[Column, Column]:
        """S(r) and its slope: 1 below switch_on, 0 from the cutoff, smooth in r squared between."""
        if self.cutoff is None:
            return F.lit(1.0), F.lit(0.0)
        c2, on2 = self.cutoff**2, self.switch_on**2
        d3, u = (c2 - on2) ** 3, r * r
        rest = F.lit(c2) - u
        s = rest * rest * (F.lit(c2 - 3 * on2) + 2 * u) / d3
        ds = 12 * r * rest * (F.lit(on2) - u) / d3
        low, high = r <= self.switch_on, r >= self.cutoff
        return F.when(low, 1.0).when(high, 0.0).otherwise(s), F.when(low | high, 0.0).otherwise(ds)

    def kernel(self, r: Column) -> tuple[Column, Column]:
        """Potential and radial field of a unit charge at distance r, unscaled; the field is 0 in the clamp."""
        near = F.greatest(r, F.lit(float(self.min_distance)))
        if self.model == "vacuum":
            g, h = 1 / near, 1 / (near * near)
        elif self.model == "distance":
            g, h = 1 / (near * near), 2 / (near * near * near)
        else:
            e = F.exp(-F.lit(self.kappa) * near)
            g, h = e / near, e * (1 + F.lit(self.kappa) * near) / (near * near)
        h = F.when(r < self.min_distance, 0.0).otherwise(h)
        s, ds = self.switch(r)
        return g * s, h * s - g * ds


def _pairs(points: DataFrame, charges: DataFrame, p: Electrostatics) -> DataFrame:
    """(l_point, l_x .., r_q, r_x .., d2): points and the charges that count for them."""
    at = points.select("point", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    q = charges.filter("q <> 0").select(F.col("q").cast("double").alias("q"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    if p.cutoff is not None:
        return spatial.near_pairs(at, q, p.cutoff)
    if q.limit(MAX_BROADCAST // 32 + 1).count() > MAX_BROADCAST // 32:
        raise spatial.PairLimitError("too many charges for an exact sum; give a cutoff")
    # Every charge counts for every point: the sum is defined over all pairs.
    both = at.alias("l").crossJoin(F.broadcast(q).alias("r"))
    cols = [F.col(f"l.{c}").alias(f"l_{c}") for c in at.columns] + [F.col(f"r.{c}").alias(f"r_{c}") for c in q.columns]
    return both.select(*cols, spatial.squared_distance("l", "r").alias("d2"))


def potential(points: DataFrame, charges: DataFrame, p: Electrostatics = Electrostatics()) -> DataFrame:
    """(point, phi) of every point (point, x, y, z) from charges (x, y, z, q)."""
    pairs = _pairs(points, charges, p)
    sums = pairs.groupBy(F.col("l_point").alias("point")).agg(F.sum(F.col("r_q") * p.kernel(F.sqrt("d2"))[0]).alias("phi"))
    return points.select("point").join(sums, "point", "left").select("point", (F.coalesce("phi", F.lit(0.0)) * p.scale).alias("phi"))


def field(points: DataFrame, charges: DataFrame, p: Electrostatics = Electrostatics()) -> DataFrame:
    """(point, ex, ey, ez): minus the potential's gradient; a charge at the point itself gives none."""
    r = F.sqrt("d2")
    pull = F.when(r > 0, F.col("r_q") * p.kernel(r)[1] / r).otherwise(0.0)
    sums = [F.sum(pull * (F.col(f"l_{c}") - F.col(f"r_{c}"))).alias(f"e{c}") for c in "xyz"]
    found = _pairs(points, charges, p).groupBy(F.col("l_point").alias("point")).agg(*sums)
    out = points.select("point").join(found, "point", "left")
    return out.select("point", *((F.coalesce(f"e{c}", F.lit(0.0)) * p.scale).alias(f"e{c}") for c in "xyz"))


def coulomb_grid(spark, grid: volume.Grid, charges: DataFrame, p: Electrostatics = Electrostatics()) -> DataFrame:
    """(i, j, k, v): the potential on every sample of a grid."""
    at = volume.grid_points(spark, grid)
    return at.select("point", "i", "j", "k").join(potential(at, charges, p), "point").select("i", "j", "k", F.col("phi").alias("v"))


def field_grid(spark, grid: volume.Grid, charges: DataFrame, p: Electrostatics = Electrostatics()) -> DataFrame:
    """(i, j, k, ex, ey, ez) on every sample of a grid."""
    at = volume.grid_points(spark, grid)
    return at.select("point", "i", "j", "k").join(field(at, charges, p), "point").drop("point")
