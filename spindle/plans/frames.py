"""Queries of frames made from events and of points in spatial order, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import timeline
from ..operators import blocks, dynamics, keyframes, unwrapping
from ..sources import trajectory
from .queries import P3, PD2, query, rounded
from .testtables import duck, points_structure, table

#: Edges of the cell; no difference of two events lies half way.
CELL = (9.737, 8.917, 7.773)
_SHIFT = ", ".join(f"coalesce(sum(-floor(({c} - p{c}) / {n} + 0.5)) OVER (PARTITION BY frame ORDER BY atom), 0) AS s{c}" for c, n in zip("xyz", CELL))
_PLACE = ", ".join(f"round({c} + {n} * s{c}, 4) + 0.0 AS {c}" for c, n in zip("xyz", CELL))


@query(duck("frames") + f""", p AS (SELECT frame, atom, x, y, z, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM frames WINDOW w AS (PARTITION BY frame ORDER BY atom)),
 s AS (SELECT frame, atom, x, y, z, {_SHIFT} FROM p)
 SELECT frame, atom, min(atom) OVER (PARTITION BY frame) AS component, {_PLACE} FROM s""")
def unwrapped_chain(spark, d):
    """All events of a frame as one chain, made whole in a box."""
    frames = table(spark, d, "frames")
    atoms = frames.select("atom").distinct()
    edges = atoms.join(atoms.select((F.col("atom") - 20).alias("atom")), "atom", "left_semi").select(F.col("atom").alias("a"), (F.col("atom") + 20).alias("b"))
    a, b, c = CELL
    boxes = frames.select("frame").distinct().withColumn("box", F.array(*(F.lit(float(v)) for v in (a, 0, 0, 0, b, 0, 0, 0, c))))
    return rounded(unwrapping.unwrap_frames(frames, edges, boxes).positions, "x", "y", "z", digits=4)


@query(P3 + f" SELECT p.atom AS l, q.atom AS r, round({PD2}, 6) AS d2 FROM points p JOIN points q ON p.atom < q.atom AND {PD2} <= 6.25")
def pairs_by_blocks(spark, d):
    """Points less than 2.5 apart, by blocks whose boxes are near."""
    at = points_structure(spark, d).atoms
    return rounded(blocks.near_by_blocks(at, at, 2.5).filter("l < r"), "d2", digits=6)


_BEZIER = "((1 - {u}) ** 3 * b + 3 * (1 - {u}) ** 2 * {u} * k1 + 3 * (1 - {u}) * {u} ** 2 * k2 + {u} ** 3 * c)"
_CHORD = f"abs({_BEZIER.format(u='((i + 1) / 32)')} - {_BEZIER.format(u='(i / 32)')})"


@query(f"""WITH k AS (SELECT event_type AS curve, CAST(event_id AS DOUBLE) AS t0, value AS b, lag(value) OVER w AS p, lead(value) OVER w AS c, lead(value, 2) OVER w AS n,
 lead(CAST(event_id AS DOUBLE)) OVER w AS t1 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
 l AS (SELECT curve, t0, t1, b, c, coalesce(p, b) AS a, coalesce(n, c) AS d, abs(b - coalesce(p, b)) AS l1, abs(c - b) AS l2, abs(coalesce(n, c) - c) AS l3 FROM k WHERE t1 IS NOT NULL),
 s AS (SELECT *, b + CASE WHEN l1 > 0 AND l2 > 0 THEN l2 * ((b - a) / l1 - (c - a) / (l1 + l2) + (c - b) / l2) ELSE c - b END / 3 AS k1,
 c - CASE WHEN l3 > 0 AND l2 > 0 THEN l2 * ((c - b) / l2 - (d - b) / (l2 + l3) + (d - c) / l3) ELSE c - b END / 3 AS k2 FROM l),
 m AS (SELECT *, CASE WHEN l2 > 0 THEN list_sum(list_transform(range(32), lambda i: {_CHORD})) ELSE 0 END AS len FROM s),
 v AS (SELECT *, (len + coalesce(lag(len) OVER w, 0)) / (t1 - t0 + coalesce(lag(t1 - t0) OVER w, 0)) AS v0, (len + coalesce(lead(len) OVER w, 0)) / (t1 - t0 + coalesce(lead(t1 - t0) OVER w, 0)) AS v1
 FROM m WINDOW w AS (PARTITION BY curve ORDER BY t0)),
 g AS (SELECT *, CASE WHEN len > 0 THEN least(3, v0 * (t1 - t0) / len) ELSE 1 END AS s0, CASE WHEN len > 0 THEN least(3, v1 * (t1 - t0) / len) ELSE 1 END AS s1 FROM v),
 q AS (SELECT e.event_id AS moment, g.*, (e.event_id + 7.1415926535 - t0) / (t1 - t0) AS x FROM events e ASOF JOIN g ON e.event_type = g.curve AND e.event_id + 7.1415926535 >= g.t0),
 z AS (SELECT *, (1 - x) ** 2 * x * s0 + 3 * (1 - x) * x ** 2 * (1 - s1 / 3) + x ** 3 AS u FROM q)
 SELECT moment, round(CASE WHEN x >= 1 THEN c ELSE {_BEZIER.format(u='u')} END, 4) + 0.0 AS v FROM z""")
def automatic_curves(spark, d):
    """A smooth curve through the values of each event type, read a little after each event."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    keys = ev.select(F.col("event_type").alias("curve"), F.col("event_id").cast("double").alias("time"), F.array("value").alias("value"))
    moments = ev.select(F.col("event_id").alias("moment"), F.col("event_type").alias("curve"), (F.col("event_id") + 7.1415926535).alias("time"))
    got = keyframes.sample(moments, keyframes.segments(keys, automatic=True))
    return rounded(got.select("moment", F.get("value", F.lit(0)).alias("v")), "v", digits=4)


@query("""WITH k AS (SELECT o_orderpriority AS curve, o_orderkey AS t0, o_orderstatus AS s, o_totalprice AS a0, CAST(o_custkey AS DOUBLE) AS a1,
 lead(o_orderkey) OVER w AS t1, lead(o_totalprice) OVER w AS b0, lead(CAST(o_custkey AS DOUBLE)) OVER w AS b1, max(o_orderkey) OVER (PARTITION BY o_orderpriority) AS hi, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS lo
 FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)), g AS (SELECT * FROM k WHERE t1 IS NOT NULL),
 e AS (SELECT DISTINCT curve, lo, hi FROM g), t AS (SELECT o_orderkey AS moment, e.curve, o_orderkey + 3.1415926535 AS t, lo, hi FROM orders JOIN e ON o_orderpriority = e.curve),
 w AS (SELECT moment, curve, CASE WHEN t >= hi THEN t - (hi - lo) * floor((t - lo) / (hi - lo)) ELSE t END AS t FROM t),
 q AS (SELECT moment, g.*, (w.t - t0) / (t1 - t0) AS x FROM w ASOF JOIN g ON w.curve = g.curve AND w.t >= g.t0),
 z AS (SELECT *, CASE s WHEN 'P' THEN 0.0 WHEN 'F' THEN (1 - cos(pi() * x)) / 2 ELSE x END AS u FROM q)
 SELECT moment, round(a0 + (b0 - a0) * u, 4) + 0.0 AS v0, round(a1 + (b1 - a1) * u, 4) + 0.0 AS v1 FROM z""")
def vector_curves(spark, d):
    """Vectors of orders by priority as looping curves, eased by their status."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    ease = F.when(F.col("o_orderstatus") == "P", "hold").when(F.col("o_orderstatus") == "F", "cosine").otherwise("linear")
    curve = F.col("o_orderpriority").alias("curve")
    keys = o.select(curve, F.col("o_orderkey").cast("double").alias("time"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("value"), ease.alias("ease"))
    got = keyframes.sample(o.select(F.col("o_orderkey").alias("moment"), curve, (F.col("o_orderkey") + 3.1415926535).alias("time")), keyframes.segments(keys), loop=True)
    return rounded(got.select("moment", *(F.get("value", F.lit(k)).alias(f"v{k}") for k in (0, 1))), "v0", "v1", digits=4)


@query("""SELECT event_id, round(greatest(0, least(7.5, value - 2)) * 4, 6) + 0.0 AS held, round((value - 2 - 7.5 * floor((value - 2) / 7.5)) * 4, 6) + 0.0 AS looped, round(2 + event_id / 4.0, 6) AS second FROM events""")
def playback_frames(spark, d):
    """Frames on screen at the values of events, held and looped, and the second of each event's frame."""
    ev, at = spark.read.parquet(f"{d}/events.parquet"), F.col("value")
    held, looped = (timeline.playback_position(at, 30, 4, start=2, loop=loop) for loop in (False, True))
    return rounded(ev.select("event_id", held.alias("held"), looped.alias("looped"), timeline.playback_time(F.col("event_id"), 4, 2).alias("second")), "held", "looped", "second", digits=6)


@query(duck("frames") + " SELECT frame, atom FROM frames WHERE atom NOT IN (SELECT p_partkey FROM part)")
def frames_of_unknown_atoms(spark, d):
    """Rows of frames whose atom isn't among the parts."""
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("atom"))
    return trajectory.validate_frames(table(spark, d, "frames"), parts).select("frame", "atom")


@query(duck("frames") + """, t AS (SELECT * FROM frames WHERE frame = 0), m AS (SELECT * FROM frames WHERE x > 40)
 SELECT f.frame, t.atom, coalesce(m.x, t.x) AS x, coalesce(m.y, t.y) AS y, coalesce(m.z, t.z) AS z FROM (SELECT DISTINCT frame FROM m) f CROSS JOIN t LEFT JOIN m ON m.frame = f.frame AND m.atom = t.atom""")
def partial_frames(spark, d):
    """Every atom in every frame, where a frame tells only of the atoms far along x."""
    frames = table(spark, d, "frames")
    return trajectory.with_partial_frames(frames.filter("x > 40"), frames.filter("frame = 0"))


@query(duck("frames") + f""", a AS (SELECT * FROM frames WHERE frame = 0), b AS (SELECT * FROM frames WHERE frame = 1 AND z < 8)
 SELECT a.atom, {", ".join(f"round(CAST(CAST(a.{c} + CAST('{0.5 * math.sin(1.0)!r}' AS DOUBLE) * coalesce(b.{c} - a.{c}, 0) AS FLOAT) AS DOUBLE), 3) + 0.0 AS {c}" for c in "xyz")} FROM a LEFT JOIN b ON a.atom = b.atom""")
def mode_displaced(spark, d):
    """Atoms moved along the way to their next frame; those that have none there stay."""
    frames = table(spark, d, "frames")
    first = frames.filter("frame = 0").select("atom", "x", "y", "z")
    mode = first.join(frames.filter("frame = 1 AND z < 8").select("atom", *(F.col(c).alias(f"b{c}") for c in "xyz")), "atom")
    mode = mode.select("atom", *((F.col(f"b{c}") - F.col(c)).alias(f"v{c}") for c in "xyz"))
    return rounded(dynamics.apply_mode(first, mode, 0.5, 1.0), "x", "y", "z", digits=3)


_IMAGE = ", ".join(f"round(CAST(CAST(a.{c} + (b.{c} - a.{c} - {n} * floor((b.{c} - a.{c}) / {n} + 0.5)) * 0.25 AS FLOAT) AS DOUBLE), 2) + 0.0 AS {c}" for c, n in zip("xyz", CELL))


@query(duck("frames") + f" SELECT 7 AS moment, a.atom, {_IMAGE} FROM frames a JOIN frames b ON a.frame = 3 AND b.frame = 4 AND a.atom = b.atom")
def nearest_image_frames(spark, d):
    """Coordinates between two frames, by the nearest image in a box."""
    moments = spark.createDataFrame([(7, 3.25)], "moment int, position double")
    return rounded(timeline.interpolated(table(spark, d, "frames"), moments, 20, box=CELL), "x", "y", "z", digits=2)
