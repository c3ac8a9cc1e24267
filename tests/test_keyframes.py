"""Curves of keyframe tables against plain Python."""

import math

import numpy as np
import pytest

from spindle.operators import keyframes as K

SCHEMA = "curve string, time double, value array<double>, ease string, bezier array<double>, knots array<array<double>>"


def turn(d):
    return d - 360 * np.floor(d / 360 + 0.5)


def cubic(t, a, b, c, d):
    return (1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t * t * c + t**3 * d


def plain_automatic(keys, t, angle):
    """One curve's value at t, key by key."""
    times = [k[0] for k in keys]
    v = [np.array(k[1], float) for k in keys]
    if t <= times[0]:
        return v[0]
    if t >= times[-1]:
        return v[-1]
    near = lambda a, b: a + turn(b - a) if angle else b
    size = lambda a, b: float(np.linalg.norm(turn(b - a) if angle else b - a))
    parts = []
    for i in range(len(v) - 1):
        b, c0 = v[i], v[i + 1]
        a0, d0 = v[max(0, i - 1)], v[min(len(v) - 1, i + 2)]
        l1, l2, l3 = size(a0, b), size(b, c0), size(c0, d0)
        a, c = near(b, a0), near(b, c0)
        d = near(c, d0)
        out = l2 * ((b - a) / l1 - (c - a) / (l1 + l2) + (c - b) / l2) if l1 * l2 else c - b
        into = l2 * ((c - b) / l2 - (d - b) / (l2 + l3) + (d - c) / l3) if l3 * l2 else c - b
        f = lambda s, b=b, k1=b + out / 3, k2=c - into / 3, c=c: cubic(s, b, k1, k2, c)
        n = K.CHORDS
        parts.append((f, sum(np.linalg.norm(f((k + 1) / n) - f(k / n)) for k in range(n)) if l2 else 0.0, times[i + 1] - times[i]))
    speed = []
    for i in range(len(v)):
        by = parts[max(0, i - 1) : i + 1]
        speed.append(sum(p[1] for p in by) / sum(p[2] for p in by))
    i = max(k for k in range(len(parts)) if times[k] <= t)
    f, length, long = parts[i]
    u = (t - times[i]) / long
    s0, s1 = (min(3.0, s * long / length) if length else 1.0 for s in speed[i : i + 2])
    return f(cubic(u, 0, s0 / 3, 1 - s1 / 3, 1))


def sampled(spark, keys, moments, **options):
    loop = options.pop("loop", False)
    rows = K.sample(spark.createDataFrame(moments, "moment int, curve string, time double"), K.segments(keys, **options), loop=loop)
    return {r["moment"]: r["value"] for r in rows.collect()}


@pytest.mark.parametrize("angle", [False, True])
def test_automatic_knots_of_vectors(spark, angle):
    rng = np.random.default_rng(8)
    curves = {c: sorted((float(t), rng.uniform(-400, 400, 2).tolist()) for t in rng.choice(50, n, replace=False)) for c, n in (("one", 9), ("two", 2), ("three", 30))}
    curves["three"][5] = (curves["three"][5][0], curves["three"][4][1])
    keys = spark.createDataFrame([(c, t, v) for c, ks in curves.items() for t, v in ks], "curve string, time double, value array<double>")
    moments = [(m, str(rng.choice(list(curves))), float(rng.uniform(-5, 55))) for m in range(200)]
    moments += [(200 + m, "three", t) for m, (t, _) in enumerate(curves["three"])]
    got = sampled(spark, keys.repartition(3), moments, angle=angle, automatic=True)
    assert len(got) == len(moments)
    for m, c, t in moments:
        want = plain_automatic(curves[c], t, angle)
        d = np.array(got[m]) - want
        assert np.allclose(turn(d) if angle else d, 0, atol=1e-7), (m, c, t)


def test_eases_knots_angles_and_ends(spark):
    keys = spark.createDataFrame(
        [
            ("e", 0.0, [0.0], "hold", None, None), ("e", 1.0, [10.0], "cosine", None, None), ("e", 2.0, [20.0], "bezier", [0.42, 0.0, 0.58, 1.0], None),
            ("e", 3.0, [30.0], None, None, None), ("e", 4.0, [40.0], None, None, None), ("k", 0.0, [0.0, 0.0], None, None, [[0.0, 0.0], [1.0, 2.0]]),
            ("k", 1.0, [1.0, 2.0], None, None, None), ("a", 0.0, [350.0], None, None, None), ("a", 2.0, [10.0], None, None, None),
        ],
        SCHEMA,
    )
    times = {"e": (-1.0, 0.5, 1.25, 2.5, 2.2, 3.5, 4.0, 9.0), "k": (0.5, 0.25), "a": (1.0, 1.5)}
    moments = [(m, c, t) for m, (c, t) in enumerate((c, t) for c, ts in times.items() for t in ts)]
    moments += [(90, "none", 1.0), (91, None, 1.0), (92, "e", None), (93, "e", float("nan")), (94, "e", float("inf"))]
    got = sampled(spark, keys, moments)
    value = {(c, t): got[m] for m, c, t in moments[:12]}
    assert [value["e", t] for t in (-1.0, 0.5, 4.0, 9.0, 3.5)] == [[0.0], [0.0], [40.0], [40.0], [35.0]]
    assert np.isclose(value["e", 1.25][0], 10 + 10 * (1 - math.cos(math.pi / 4)) / 2) and np.isclose(value["e", 2.5][0], 25)
    t = max(np.roots([1 - 3 * 0.58 + 3 * 0.42, 3 * 0.58 - 6 * 0.42, 3 * 0.42, -0.2]), key=lambda r: (abs(r.imag) < 1e-9 and 0 <= r.real <= 1)).real
    assert np.isclose(value["e", 2.2][0], 20 + 10 * (3 * t * t - 2 * t**3))
    assert value["k", 0.5] == [0.5, 1.0] and np.allclose(value["k", 0.25], [cubic(0.25, 0, 0, 1, 1), cubic(0.25, 0, 0, 2, 2)])
    assert np.allclose(value["a", 1.0], [180.0])
    assert all(got[m] is None for m in range(90, 95))
    turned = sampled(spark, keys.filter("curve = 'a'"), [(0, "a", 1.0), (1, "a", 1.5), (2, "a", 2.0)], angle=True)
    assert turned == {0: [360.0], 1: [365.0], 2: [10.0]}
    wrapped = sampled(spark, keys.filter("curve = 'a'"), [(0, "a", 2.5), (1, "a", -0.5), (2, "a", 2.0), (3, "a", 0.5)], loop=True)
    assert wrapped[0] == wrapped[3] and np.allclose(wrapped[1], [95.0]) and wrapped[2] == [350.0]


def test_refusals(spark):
    good = [("c", 0.0, [1.0], None, None, None), ("c", 1.0, [2.0], None, None, None)]
    for row, reason in (
        (("c", 1.0, [3.0], None, None, None), "twice"), (("c", 2.0, [3.0, 4.0], None, None, None), "shape"), (("c", None, [3.0], None, None, None), "time"),
        (("c", 2.0, [], None, None, None), "value"), (("c", 2.0, [float("nan")], None, None, None), "value"), (("c", 2.0, [1.0], "bounce", None, None), "ease"),
        (("c", 2.0, [1.0], "bezier", [0.1], None), "bezier"), (("c", 2.0, [1.0], None, None, [[1.0]]), "knots"), (("c", 2.0, [1.0], None, None, [[1.0], [1.0, 2.0]]), "knots"),
        (("d", 2.0, [1.0], None, None, None), "one key"),
    ):
        assert reason in {r["reason"] for r in K.faults(spark.createDataFrame([*good, row], SCHEMA)).collect()}, row
    assert K.faults(spark.createDataFrame(good, SCHEMA)).isEmpty()
    with pytest.raises(ValueError, match="twice"):
        K.segments(spark.createDataFrame([*good, good[0]], SCHEMA))
    with pytest.raises(ValueError, match="no ease"):
        K.segments(spark.createDataFrame([good[0], ("c", 1.0, [2.0], "hold", None, None)], SCHEMA), automatic=True)
    empty = spark.createDataFrame([], SCHEMA)
    assert sampled(spark, empty, [(1, "c", 0.0)]) == {1: None}


def test_neighbours_across_blocks(spark, monkeypatch):
    """A key is sent once, and twice or three times at the edge of a block; blocks of any size give the same neighbours."""
    rows = spark.createDataFrame([("a" if i < 23 else "b", i, float(i)) for i in range(40)], "curve string, at long, time double").repartition(3)
    for size in (2, 3, 7, 100):
        monkeypatch.setattr(K, "BLOCK", size)
        got = {r["at"]: [r[n] and r[n]["time"] for n in ("by_1", "by1", "by2")] for r in K._beside(rows, (-1, 1, 2), ["time"]).collect()}
        near = lambda i, k: float(i + k) if 0 <= i + k < 40 and (i < 23) == (i + k < 23) else None
        assert got == {i: [near(i, k) for k in (-1, 1, 2)] for i in range(40)}
