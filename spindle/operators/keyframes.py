"""Curves as tables of keyframes: explicit and automatic knots, vectors, angles, sampled at any number of moments.

Keys are rows (curve, time, value array<double>) with optional ``ease`` ('linear', 'cosine', 'hold', 'bezier'), ``bezier`` (x1, y1, x2, y2) and
``knots`` (two arrays as long as the value). A key's ease, Bezier and knots belong to the segment that it starts.

Automatic curves take no ease or knots: a segment's knots are those of the Catmull-Rom spline over its two neighbours with chord lengths as
parameters (at an end, or beside an equal key, the tangent is the segment's own chord), and its easing keeps the speed continuous: at a key it is the length
of both neighbouring segments over their duration, at most three times a segment's mean speed. Lengths are sums of
``CHORDS`` chords.

Keys find their neighbours by their number in one global order, in blocks of it, moments their segment by buckets of their curve's time, so one curve may hold most of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

CHORDS = 32
#: Numbers of keys in one block, in which a key finds its neighbours.
BLOCK = 4_096
#: Halvings when a Bezier's parameter is sought.
HALVINGS = 48
EASES = ("linear", "cosine", "hold", "bezier")


def _turn(d: Column) -> Column:
    """A difference of angles on the short arc, from -180 (included) to 180 degrees."""
    return d - 360 * F.floor(d / 360 + 0.5)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def _toward(a: Column, b: Column, angle: bool) -> Column:
    """``b``, or its turn next to ``a``."""
    return _zip(a, b, lambda x, y: x + _turn(y - x)) if angle else b


def _length(a: Column, b: Column, angle: bool) -> Column:
    d = (lambda x, y: _turn(y - x)) if angle else (lambda x, y: y - x)
    return F.sqrt(F.aggregate(_zip(a, b, d), F.lit(0.0), lambda s, v: s + v * v))


def _cubic(t: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    s = 1 - t
    return s * s * s * a + 3 * s * s * t * b + 3 * s * t * t * c + t * t * t * d


def spline(t: Column, a: Column, k1: Column, k2: Column, b: Column) -> Column:
    """A vector on the cubic Bezier a, k1, k2, b."""
    parts = F.arrays_zip(a.alias("a"), k1.alias("k1"), k2.alias("k2"), b.alias("b"))
    return F.transform(parts, lambda p: _cubic(t, p["a"], p["k1"], p["k2"], p["b"]))


def faults(keys: DataFrame) -> DataFrame:
    """(curve, time, reason) of keys that make no curve: no time or value, another length, two at one time, unknown or incomplete eases."""
    cols = set(keys.columns)
    ok = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    t = F.col("time").cast("double")
    time = F.coalesce(~F.isnan(t) & (F.abs(t) < float("inf")), F.lit(False))
    value = F.coalesce((F.size("value") > 0) & ok(F.col("value").cast("array<double>")), F.lit(False))
    checks = [(~time, "time"), (~value, "value")]
    if "ease" in cols:
        checks.append((~F.coalesce(F.col("ease"), F.lit("linear")).isin(*EASES), "ease"))
        if "bezier" in cols:
            checks.append(((F.col("ease") == "bezier") & ~F.coalesce((F.size("bezier") == 4) & ok(F.col("bezier")), F.lit(False)), "bezier"))
        else:
            checks.append((F.col("ease") == "bezier", "bezier"))
    if "knots" in cols:
        whole = (F.size("knots") == 2) & F.forall("knots", lambda k: (F.size(k) == F.size("value")) & ok(k))
        checks.append((F.col("knots").isNotNull() & ~F.coalesce(whole, F.lit(False)), "knots"))
    own = keys.select("curve", "time", F.coalesce(*(F.when(c, r) for c, r in checks)).alias("reason")).filter("reason IS NOT NULL")
    twice = keys.groupBy("curve", "time").count().filter("count > 1").select("curve", "time", F.lit("twice").alias("reason"))
    sizes = keys.groupBy("curve").agg(F.min(F.size("value")).alias("low"), F.max(F.size("value")).alias("high"), F.count("*").alias("n"))
    shape = sizes.filter("low <> high OR n < 2").select("curve", F.lit(None).cast("double").alias("time"), F.when(F.col("n") < 2, "one key").otherwise("shape").alias("reason"))
    return own.union(twice).union(shape)


def _numbered(keys: DataFrame) -> DataFrame:
    """``keys`` with ``at``: their number in the order of curve and time, with no gap."""
    ordered = keys.repartitionByRange("curve", "time").sortWithinPartitions("curve", "time")
    held = graph.cut(ordered.withColumn("__id", F.monotonically_increasing_id()))
    # One row a partition.
    counts = sorted((r[0], r[1]) for r in held.groupBy(F.shiftright("__id", 33)).count().collect())
    total, first = 0, []
    for part, n in counts:
        first.append((part, total))
        total += n
    starts = keys.sparkSession.createDataFrame(first, "__part long, __first long")
    out = held.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(starts), "__part")
    return out.withColumn("at", F.col("__first") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__first", "__id")


def _beside(rows: DataFrame, shifts: tuple[int, ...], cols: list[str]) -> DataFrame:
    """``rows`` with a struct ``by<k>`` of ``cols`` for each neighbour ``k`` numbers on in the same curve, null where there is none."""
    block = lambda k: F.floor((F.col("at") - k) / BLOCK)
    # A row goes to its own block of numbers, and those at an edge to the next one as well.
    sent = rows.withColumn("__block", F.explode(F.array_distinct(F.array(*(block(k) for k in (0, *shifts))))))
    # As many tasks as the session asks for, however few bytes the rows take.
    sent = sent.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__block")
    order = Window.partitionBy("__block").orderBy("at")
    held = F.struct("curve", *cols)
    found = {f"by{k}".replace("-", "_"): F.lead(held, k).over(order) if k > 0 else F.lag(held, -k).over(order) for k in shifts}
    got = sent.withColumns(found).filter(F.col("__block") == block(0))
    same = lambda n: F.when(F.col(f"{n}.curve").eqNullSafe(F.col("curve")), F.col(n)).alias(n)
    return got.select(*rows.columns, *map(same, found))


def segments(keys: DataFrame, angle: bool = False, automatic: bool = False) -> DataFrame:
    """(curve, t0, t1, a, b, k1, k2, ease, bezier, last) of each two neighbouring keys; k1 and k2 are null on straight segments.

    Keys that ``faults`` reports are refused; for angles in degrees every value is turned next to the one before it in its segment.
    """
    fault = faults(keys).first()
    if fault:
        raise ValueError(f"curve {fault['curve']!r} at {fault['time']}: {fault['reason']}")
    has = lambda c: c in keys.columns
    if automatic and any(has(c) and not keys.filter(F.col(c).isNotNull()).isEmpty() for c in ("ease", "knots")):
        raise ValueError("automatic curves take no ease or knots")
    plain = keys.select(
        "curve", F.col("time").cast("double").alias("time"), F.col("value").cast("array<double>").alias("value"),
        (F.coalesce("ease", F.lit("linear")) if has("ease") else F.lit("linear")).alias("ease"),
        (F.col("bezier").cast("array<double>") if has("bezier") else F.lit(None).cast("array<double>")).alias("bezier"),
        (F.col("knots").cast("array<array<double>>") if has("knots") else F.lit(None).cast("array<array<double>>")).alias("knots"),
    )
    near = _beside(_numbered(plain), (-1, 1, 2) if automatic else (1,), ["time", "value"]).filter("by1 IS NOT NULL")
    a, b = F.col("value"), F.col("by1.value")
    if automatic:
        return _automatic(near, a, b, angle)
    k1 = _toward(a, F.get("knots", 0), angle)
    k2 = _toward(k1, F.get("knots", 1), angle)
    end = F.when(F.col("knots").isNull(), _toward(a, b, angle)).otherwise(_toward(k2, b, angle))
    return near.select("curve", F.col("time").alias("t0"), F.col("by1.time").alias("t1"), a.alias("a"), end.alias("b"), k1.alias("k1"), k2.alias("k2"), "ease", "bezier", b.alias("last"))


def _automatic(near: DataFrame, b: Column, c: Column, angle: bool) -> DataFrame:
    before, after = F.coalesce("by_1.value", b), F.coalesce("by2.value", c)
    near = near.withColumns({"l1": _length(before, b, angle), "l2": _length(b, c, angle), "l3": _length(c, after, angle)})
    # All four on one branch of the angle.
    near = near.withColumns({"c": _toward(b, c, angle), "a": _toward(b, before, angle), "last": c})
    near = near.withColumn("d", _toward(F.col("c"), after, angle))
    l1, l2, l3 = (F.col(f"l{k}") for k in (1, 2, 3))
    parts = F.arrays_zip("a", F.col("value").alias("b"), "c", "d")
    out = lambda p: l2 * ((p["b"] - p["a"]) / l1 - (p["c"] - p["a"]) / (l1 + l2) + (p["c"] - p["b"]) / l2)
    into = lambda p: l2 * ((p["c"] - p["b"]) / l2 - (p["d"] - p["b"]) / (l2 + l3) + (p["d"] - p["c"]) / l3)
    first = F.transform(parts, lambda p: p["b"] + F.when((l1 > 0) & (l2 > 0), out(p)).otherwise(p["c"] - p["b"]) / 3)
    second = F.transform(parts, lambda p: p["c"] - F.when((l3 > 0) & (l2 > 0), into(p)).otherwise(p["c"] - p["b"]) / 3)
    near = near.withColumns({"k1": first, "k2": second})
    at = lambda k: spline(k / CHORDS, F.col("value"), F.col("k1"), F.col("k2"), F.col("c"))
    chords = F.transform(F.sequence(F.lit(0), F.lit(CHORDS - 1)), lambda k: _length(at(k), at(k + 1), False))
    near = near.withColumn("length", F.when(l2 > 0, F.aggregate(chords, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0))
    rows = near.select("curve", "at", F.col("time").alias("t0"), F.col("by1.time").alias("t1"), F.col("value").alias("a"), F.col("c").alias("b"), "k1", "k2", "last", "length")
    rows = _beside(rows, (-1, 1), ["t0", "t1", "length"])
    own = F.col("t1") - F.col("t0")
    speed = lambda by: (F.col("length") + F.coalesce(f"{by}.length", F.lit(0.0))) / (own + F.coalesce(F.col(f"{by}.t1") - F.col(f"{by}.t0"), F.lit(0.0)))
    slope = lambda by: F.when(F.col("length") > 0, F.least(F.lit(3.0), speed(by) * own / F.col("length"))).otherwise(1.0)
    bezier = F.array(F.lit(1 / 3), slope("by_1") / 3, F.lit(2 / 3), 1 - slope("by1") / 3)
    return rows.select("curve", "t0", "t1", "a", "b", "k1", "k2", F.lit("bezier").alias("ease"), bezier.alias("bezier"), "last")


def eased(u: Column, ease: Column, bezier: Column) -> Column:
    """The fraction of a segment's way at the fraction ``u`` of its time."""
    x1, y1, x2, y2 = (F.get(bezier, k) for k in range(4))
    halve = lambda s, _: F.when(_cubic((s["lo"] + s["hi"]) / 2, F.lit(0.0), x1, x2, F.lit(1.0)) < u, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(
        F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve, lambda s: (s["lo"] + s["hi"]) / 2)
    t = F.when((x1 == 1 / 3) & (x2 == 2 / 3), u).when(u <= 0, F.lit(0.0)).when(u >= 1, F.lit(1.0)).otherwise(found)
    curve = _cubic(t, F.lit(0.0), y1, y2, F.lit(1.0))
    return F.when(ease == "hold", F.lit(0.0)).when(ease == "cosine", (1 - F.cos(u * F.pi())) / 2).when(ease == "bezier", curve).otherwise(u)


def sample(moments: DataFrame, parts: DataFrame, key: str = "moment", loop: bool = False) -> DataFrame:
    """(key, curve, time, value) of every moment (key, curve, time) on the curves whose ``segments`` are ``parts``.

    Times outside a curve are held at its ends, or with ``loop`` wrapped into it; the last instant has the last key's value. Moments of no
    curve, or with a null, infinite or NaN time, have a null value.
    """
    spans = parts.groupBy("curve").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"), F.count("*").alias("n"))
    bucket = lambda t: F.least(F.floor((t - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n")), F.col("n") - 1)
    spread = parts.join(spans, "curve").withColumn("bucket", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col("t1")))))
    spread = spread.drop("lo", "n").withColumnRenamed("hi", "end")
    t = F.col("time").cast("double")
    rows = moments.select(key, "curve", "time").join(spans, "curve", "left")
    length = F.col("hi") - F.col("lo")
    wrapped = F.col("lo") + (t - F.col("lo")) - length * F.floor((t - F.col("lo")) / length)
    if loop:
        t = F.when((t < F.col("lo")) | (t >= F.col("hi")), wrapped).otherwise(t)
    t = F.when(~F.isnan(F.col("time").cast("double")) & (F.abs(F.col("time").cast("double")) < float("inf")), F.greatest(F.col("lo"), F.least(F.col("hi"), t)))
    rows = rows.withColumn("__t", t).withColumn("bucket", bucket(F.col("__t"))).select(key, "curve", "time", "__t", "bucket")
    last = F.col("p.t1") == F.col("p.end")
    held = (F.col("m.__t") >= F.col("p.t0")) & ((F.col("m.__t") < F.col("p.t1")) | (last & (F.col("m.__t") == F.col("p.t1"))))
    tasks = int(moments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, spread = (df.repartition(tasks, "curve", "bucket") for df in (rows, spread))
    got = rows.alias("m").join(spread.alias("p"), (F.col("m.curve") == F.col("p.curve")) & (F.col("m.bucket") == F.col("p.bucket")) & held, "left")
    u = eased((F.col("m.__t") - F.col("p.t0")) / (F.col("p.t1") - F.col("p.t0")), F.col("p.ease"), F.col("p.bezier"))
    got = got.select(f"m.{key}", "m.curve", "m.time", "m.__t", "p.t1", "p.a", "p.b", "p.k1", "p.k2", "p.last", u.alias("__u"), last.alias("__end"))
    straight = _zip(F.col("a"), F.col("b"), lambda x, y: x + (y - x) * F.col("__u"))
    value = F.when(F.col("__end") & (F.col("__t") == F.col("t1")), F.col("last")).when(F.col("k1").isNull(), straight).otherwise(spline(F.col("__u"), F.col("a"), F.col("k1"), F.col("k2"), F.col("b")))
    return got.select(key, "curve", "time", value.alias("value"))
