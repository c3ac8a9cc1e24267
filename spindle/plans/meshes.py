"""Queries of grids made from points: statistics, isosurfaces, surfaces, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mesh, surface, volume
from .queries import P3, query, rounded
from .testtables import points_structure

DIMS = (24, 24, 24)
GRID = volume.Grid(DIMS, (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, -23, -23, -23, 1))
LEVEL = 0.5
#: How many points lie nearest to each sample of the grid.
DENSITY = P3 + f""", g AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k FROM (SELECT unnest(range({DIMS[0]})) AS i), (SELECT unnest(range({DIMS[1]})) AS j), (SELECT unnest(range({DIMS[2]})) AS k)),
 p AS (SELECT CAST(floor((x + 24) / 2) AS INT) AS i, CAST(floor((y + 24) / 2) AS INT) AS j, CAST(floor((z + 24) / 2) AS INT) AS k, CAST(count(*) AS DOUBLE) AS n FROM points GROUP BY 1, 2, 3),
 d AS (SELECT i, j, k, coalesce(n, 0) AS v FROM g LEFT JOIN p USING (i, j, k))"""


def density(spark, d) -> DataFrame:
    at = {c: F.floor((F.col(x) + 24) / 2).cast("int") for c, x in zip("ijk", "xyz")}
    held = points_structure(spark, d).atoms.groupBy(*(v.alias(c) for c, v in at.items())).agg(F.count("*").cast("double").alias("v"))
    return volume.grid_points(spark, GRID).select("i", "j", "k").join(held, ["i", "j", "k"], "left").fillna(0.0, ["v"])


@query(DENSITY + " SELECT min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sigma FROM d")
def volume_stats(spark, d):
    """Statistics of the points' density."""
    return rounded(volume.volume_stats(density(spark, d)), "mean", "sigma", digits=6)


_BITS = " + ".join(f"CASE WHEN max(v) FILTER (di = {a} AND dj = {b} AND dk = {c}) < {LEVEL} THEN {1 << n} ELSE 0 END" for n, (a, b, c) in enumerate(mesh.CORNERS))
_TABLE = ", ".join(f"({case}, {len(ts)})" for case, ts in mesh.triangle_table().items())


@query(DENSITY + f""", c AS (SELECT i - di AS i, j - dj AS j, k - dk AS k, {_BITS} AS kind FROM d, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj), (SELECT unnest([0, 1]) AS dk)
  GROUP BY 1, 2, 3 HAVING count(*) = 8)
 SELECT i, j, k, CAST(n AS BIGINT) AS triangles FROM c JOIN (VALUES {_TABLE}) t(kind, n) USING (kind) WHERE n > 0""")
def isosurface(spark, d):
    """Triangles of the density's isosurface in every cell that it cuts."""
    found = mesh.marching_cubes(density(spark, d), GRID, LEVEL).triangles
    return found.groupBy("i", "j", "k").agg(F.count("*").alias("triangles"))


def _slope(axis: str, at: str) -> str:
    n = DIMS["ijk".index(axis)] - 1
    low, high = ("{0}.i", "{0}.j", "{0}.k"), ("{0}.i", "{0}.j", "{0}.k")
    low = [f"greatest({c} - 1, 0)" if c.endswith(axis) else c for c in (x.format(at) for x in low)]
    high = [f"least({c} + 1, {n})" if c.endswith(axis) else c for c in (x.format(at) for x in high)]
    pick = lambda ijk: f"(SELECT v FROM d q WHERE q.i = {ijk[0]} AND q.j = {ijk[1]} AND q.k = {ijk[2]})"
    return f"{pick(low)} - {pick(high)}"


_EDGES = " UNION ALL ".join(
    f"SELECT a.i, a.j, a.k, {n} AS axis, b.i AS i2, b.j AS j2, b.k AS k2, ({LEVEL} - a.v) / (b.v - a.v) AS t FROM d a JOIN d b ON " + " AND ".join(f"b.{c} = a.{c}{' + 1' if c == axis else ''}" for c in "ijk") + f" WHERE (a.v < {LEVEL}) <> (b.v < {LEVEL})"
    for n, axis in enumerate("ijk")
)


@query(DENSITY + f""", e AS ({_EDGES}), s AS (SELECT i, j, k, {', '.join(f"{_slope(c, 'd')} AS g{n}" for n, c in enumerate('ijk'))} FROM d),
 m AS (SELECT e.*, {', '.join(f"s.g{n} + t * (o.g{n} - s.g{n}) AS g{n}" for n in range(3))} FROM e JOIN s ON s.i = e.i AND s.j = e.j AND s.k = e.k JOIN s o ON o.i = i2 AND o.j = j2 AND o.k = k2),
 l AS (SELECT *, CASE WHEN sqrt(g0 * g0 + g1 * g1 + g2 * g2) = 0 THEN 1 ELSE sqrt(g0 * g0 + g1 * g1 + g2 * g2) END AS len FROM m)
 SELECT CAST(3 * (i + {DIMS[0]} * (j + {DIMS[1]} * k)) + axis AS BIGINT) AS vertex, {', '.join(f"round(2 * ({c} + CASE WHEN axis = {n} THEN t ELSE 0 END) - 23, 5) AS {x}, round(g{n} / len, 5) + 0.0 AS n{x}" for n, (c, x) in enumerate(zip('ijk', 'xyz')))} FROM l""")
def isosurface_vertices(spark, d):
    """Vertices of the density's isosurface with their normals."""
    return rounded(mesh.marching_cubes(density(spark, d), GRID, LEVEL).vertices, "x", "y", "z", "nx", "ny", "nz", digits=5)


RADII = {6: 1.7, 7: 1.55, 8: 1.52, 16: 1.8}
PROBE, STEP = 1.4, 1.0
_RADIUS = "CASE element " + " ".join(f"WHEN {z} THEN {r}" for z, r in RADII.items()) + " END"
DEEPEST = PROBE + max(RADII.values())


@query(P3 + f""", a AS (SELECT x, y, z, CAST({_RADIUS} AS DOUBLE) + {PROBE} AS r FROM points),
 o AS (SELECT min(x) - max(r) + {PROBE} - {STEP} AS x, min(y) - max(r) + {PROBE} - {STEP} AS y, min(z) - max(r) + {PROBE} - {STEP} AS z,
   CAST(ceil((max(x) + max(r) - {PROBE} + {STEP}) - (min(x) - max(r) + {PROBE} - {STEP})) AS INT) AS ni, CAST(ceil((max(y) + max(r) - {PROBE} + {STEP}) - (min(y) - max(r) + {PROBE} - {STEP})) AS INT) AS nj,
   CAST(ceil((max(z) + max(r) - {PROBE} + {STEP}) - (min(z) - max(r) + {PROBE} - {STEP})) AS INT) AS nk FROM a),
 b AS (SELECT a.x - o.x AS x, a.y - o.y AS y, a.z - o.z AS z, r FROM a, o),
 c AS (SELECT DISTINCT i, j, k FROM (SELECT b.*, unnest(range(CAST(ceil(x - r) AS INT), CAST(floor(x + r) AS INT) + 1)) AS i FROM b) b,
   LATERAL (SELECT unnest(range(CAST(ceil(b.y - b.r) AS INT), CAST(floor(b.y + b.r) AS INT) + 1)) AS j), LATERAL (SELECT unnest(range(CAST(ceil(b.z - b.r) AS INT), CAST(floor(b.z + b.r) AS INT) + 1)) AS k)
   WHERE (i - x) ** 2 + (j - y) ** 2 + (k - z) ** 2 < r * r),
 h AS (SELECT di, dj, dk, sqrt(di * di + dj * dj + dk * dk) AS d FROM (SELECT unnest(range(-4, 5)) AS di), (SELECT unnest(range(-4, 5)) AS dj), (SELECT unnest(range(-4, 5)) AS dk)),
 n AS (SELECT c.i, c.j, c.k, min(h.d) AS d FROM c, o, h WHERE c.i BETWEEN 0 AND o.ni - 1 AND c.j BETWEEN 0 AND o.nj - 1 AND c.k BETWEEN 0 AND o.nk - 1 AND h.d <= {DEEPEST} + 1
   AND (c.i + di, c.j + dj, c.k + dk) NOT IN (SELECT (i, j, k) FROM c) GROUP BY c.i, c.j, c.k)
 SELECT CAST(c.i AS INT) AS i, CAST(c.j AS INT) AS j, CAST(c.k AS INT) AS k, round(least(coalesce(n.d, 99), {DEEPEST}), 6) AS v FROM c JOIN o ON c.i BETWEEN 0 AND o.ni - 1 AND c.j BETWEEN 0 AND o.nj - 1 AND c.k BETWEEN 0 AND o.nk - 1 LEFT JOIN n ON n.i = c.i AND n.j = c.j AND n.k = c.k""")
def surface_field(spark, d):
    """Samples within the solvent-accessible surface of all points, and how far a probe's centre stays away."""
    from .. import schema as S

    atoms = points_structure(spark, d).atoms.select("x", "y", "z", S.lookup(F.col("element").cast("int"), RADII).alias("radius"))
    field = surface.surface_field(atoms, PROBE, STEP)
    return rounded(field.samples.filter("v > 0"), "v", digits=6)
