"""Keyframe curves and frame times as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keyframe:
    time: float
    value: float
    ease: str = "linear"
    bezier: tuple[float, float, float, float] | None = None


def timeline(spark: SparkSession, beats: dict[str, float]) -> DataFrame:
    """(name, time) of named instants."""
    if any(not math.isfinite(t) for t in beats.values()):
        raise ValueError("times must be finite")
    return spark.createDataFrame(sorted(beats.items()), "name string, time double")


def checked(keys: list[Keyframe]) -> list[Keyframe]:
    if not keys or any(b.time <= a.time for a, b in zip(keys, keys[1:])):
        raise ValueError("times must strictly increase")
    return keys


def ease(u: Column, kind: str, bezier: tuple | None = None) -> Column:
    if kind == "hold":
        return F.lit(0.0)
    if kind == "cosine":
        return (F.lit(1.0) - F.cos(u * math.pi)) / 2
    if kind == "bezier":
        return _bezier(u, *bezier)
    return u


def _bezier(u: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """y of a unit Bezier at x = u; t is found by eight halvings and two Newton steps."""
    curve = lambda t, a, b: ((1 - 3 * b + 3 * a) * t + (3 * b - 6 * a)) * t * t + 3 * a * t
    steps = 20
    lo = [curve(k / steps, x1, x2) for k in range(steps + 1)]
    ys = [curve(k / steps, y1, y2) for k in range(steps + 1)]
    out = F.lit(1.0)
    for k in reversed(range(steps)):
        if lo[k + 1] > lo[k]:
            t = (k + (u - lo[k]) / (lo[k + 1] - lo[k])) / steps
            for _ in range(2):
                slope = 3 * (1 - 3 * x2 + 3 * x1) * t * t + 2 * (3 * x2 - 6 * x1) * t + 3 * x1
                t = t - (curve(t, x1, x2) - u) / F.when(F.abs(slope) > 1e-9, slope).otherwise(F.lit(1e9))
            out = F.when(u < lo[k + 1], curve(t, y1, y2)).otherwise(out)
    return F.when(u <= 0, F.lit(float(ys[0]))).otherwise(out)


def sample(t: Column, keys: list[Keyframe], overflow: str = "clamp", angle: bool = False) -> Column:
    """A curve's value at column ``t``: the segment that holds t, eased between its ends."""
    keys = checked(keys)
    first, last = keys[0], keys[-1]
    t = t.cast("double")
    if overflow == "loop" and last.time > first.time:
        span = last.time - first.time
        t = F.lit(first.time) + (t - first.time) - span * F.floor((t - first.time) / span)
    out = F.lit(float(last.value))
    for a, b in reversed(list(zip(keys, keys[1:]))):
        d = b.value - a.value
        if angle:
            d -= 360 * math.floor(d / 360 + 0.5)
        u = (t - a.time) / (b.time - a.time)
        out = F.when(t < b.time, F.lit(float(a.value)) + F.lit(float(d)) * ease(u, a.ease, a.bezier)).otherwise(out)
    return F.when(t <= first.time, F.lit(float(first.value))).otherwise(out)


def frame_pair(position: Column, frames: int, mode: str = "linear") -> dict[str, Column]:
    """Columns a, b, t of a fractional frame: clamped, snapped at 1e-6."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(float(frames - 1)), position.cast("double")))
    if mode == "nearest":
        n = F.floor(p + 0.5).cast("int")
        return {"a": n, "b": n, "t": F.lit(0.0)}
    near = F.floor(p + 0.5)
    p = F.when(F.abs(p - near) < 1e-6, near.cast("double")).otherwise(p)
    a = F.floor(p).cast("int")
    return {"a": a, "b": F.least(a + 1, F.lit(frames - 1)), "t": p - a}


def frame_curve(seconds: Column, start: float, stop: float, frames: int) -> Column:
    return (seconds.cast("double") - start) / (stop - start) * (frames - 1)


def frame_time(frame: Column, start: float, stop: float, frames: int) -> Column:
    return F.lit(float(start)) + frame.cast("double") / max(1, frames - 1) * (stop - start)


def playback_position(seconds: Column, frames: int, fps: float, start: float = 0.0, loop: bool = False) -> Column:
    """The fractional frame on screen: frame i starts at ``start + i / fps`` and stays for ``1 / fps``, so the end is ``frames``.

    Times outside are held at 0 and ``frames``, or with ``loop`` wrapped, the end to 0; null and infinite or NaN times give null.
    """
    if frames < 1 or not (math.isfinite(fps) and fps > 0 and math.isfinite(start)):
        raise ValueError("frames and fps must be positive, start finite")
    t, long = seconds.cast("double") - F.lit(float(start)), frames / fps
    held = t - F.lit(long) * F.floor(t / long) if loop else F.greatest(F.lit(0.0), F.least(F.lit(long), t))
    return F.when(~F.isnan(t) & (F.abs(t) < float("inf")), held / F.lit(long) * frames)


def playback_time(frame: Column, fps: float, start: float = 0.0) -> Column:
    """The second at which a frame starts."""
    return F.lit(float(start)) + frame.cast("double") / F.lit(float(fps))


def interpolated(frames: DataFrame, moments: DataFrame, count: int, mode: str = "linear", box: tuple[float, float, float] | None = None) -> DataFrame:
    """(moment, atom, x, y, z): coordinates at fractional frames (moment, position).

    With the lengths of an orthorhombic ``box`` an atom moves to the nearest image of its next place.
    """
    pair = frame_pair(F.col("position"), count, mode)
    at = moments.select("moment", *(c.alias(f"__{k}") for k, c in pair.items()))
    a = frames.select(F.col("frame").alias("__a"), "atom", *(F.col(c).cast("double").alias(f"a{c}") for c in "xyz"))
    b = frames.select(F.col("frame").alias("__b"), "atom", *(F.col(c).cast("double").alias(f"b{c}") for c in "xyz"))
    rows = at.join(a, "__a").join(b, ["__b", "atom"])
    step = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    if box is not None:
        step = {c: d - F.lit(float(n)) * F.floor(d / F.lit(float(n)) + 0.5) for (c, d), n in zip(step.items(), box)}
    return rows.select("moment", "atom", *((F.col(f"a{c}") + step[c] * F.col("__t")).cast("float").alias(c) for c in "xyz"))
