"""Spatial joins: cells of the cutoff's size turn a range join into an equality join.

One side is copied to the 27 cells around its own; every pair within the cutoff meets in
exactly one cell, so no pair comes out twice.  Distances are computed in DOUBLE, inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
#: Rows of a cell in one lot, about; a cell with more is dealt over several.
LOT = 1_024


class PairLimitError(RuntimeError):
    """More pairs than the caller allows."""


def _cells(df: DataFrame, size: float) -> list[Column]:
    return [F.floor(F.col(c).cast("double") / F.lit(size)).cast("long").alias(f"c{c}") for c in "xyz"]


def squared_distance(a: str, b: str) -> Column:
    out = None
    for c in "xyz":
        d = F.col(f"{a}.{c}").cast("double") - F.col(f"{b}.{c}").cast("double")
        out = d * d if out is None else out + d * d
    return out


def near_pairs(left: DataFrame, right: DataFrame, reach: float, condition: Column | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (columns prefixed l_ and r_, with d2) within ``reach``; ``condition`` sees l and r."""
    size = max(reach, 1.0) * (1 + 1e-9)
    l = left.select("*", *_cells(left, size)).alias("l")  # noqa: E741
    shifts = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("ijk", s))) for s in AROUND))
    r = right.select("*", *_cells(right, size), F.explode(shifts).alias("s"))
    r = r.withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"s.{n}") for c, n in zip("xyz", "ijk")}).drop("s").alias("r")
    same = [F.col(f"l.c{c}") == F.col(f"r.c{c}") for c in "xyz"] + [F.col(f"l.{p}") == F.col(f"r.{p}") for p in partition]
    on = same[0]
    for s in same[1:]:
        on = on & s
    d2 = squared_distance("l", "r")
    on = on & (d2 <= F.lit(float(reach) * float(reach)))
    if condition is not None:
        on = on & condition
    cols = [F.col(f"l.{c}").alias(f"l_{c}") for c in left.columns] + [F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns]
    return l.join(r, on).select(*cols, d2.alias("d2"))


def self_pairs(rows: DataFrame, reach: float, partition: tuple[str, ...] = (), key: str = "atom") -> DataFrame:
    """Unordered pairs of ``rows`` within ``reach``: columns prefixed l_ (of the lower ``key``) and r_, with d2.

    Rows are copied to half of the cells around their own.  A crowded cell is dealt over lots, each of which meets all that
    is sent to the cell by itself, so a dense place is the work of many tasks.
    """
    size = max(reach, 1.0) * (1 + 1e-9)
    by = ["cx", "cy", "cz", *partition]
    at = rows.select("*", *_cells(rows, size))
    crowded = at.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > LOT)
    crowded = crowded.select(*by, F.ceil(F.col("__n") / LOT).cast("int").alias("__lots"))
    lots = F.coalesce("__lots", F.lit(1))
    here = at.join(crowded, by, "left").withColumn("__lot", F.pmod(F.xxhash64(key), lots).cast("int")).drop("__lots")
    shifts = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("ijk", s))) for s in AROUND if s >= (0, 0, 0)))
    sent = at.select("*", F.explode(shifts).alias("__s"))
    sent = sent.withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"__s.{n}") for c, n in zip("xyz", "ijk")}).withColumn("__own", F.expr("__s.i = 0 AND __s.j = 0 AND __s.k = 0")).drop("__s")
    sent = sent.join(crowded, by, "left").withColumn("__lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("__lots")
    # As many tasks as the session asks for, however few bytes the rows take: it is the pairs that cost.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (df.repartition(parts, *by, "__lot").alias(n) for df, n in ((here, "l"), (sent, "r")))  # noqa: E741
    d2, lower = squared_distance("l", "r"), F.col(f"l.{key}") < F.col(f"r.{key}")
    on = (lower | (~F.col("r.__own") & (F.col(f"l.{key}") > F.col(f"r.{key}")))) & (d2 <= F.lit(float(reach) * float(reach)))
    for c in (*by, "__lot"):
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    pick = lambda c, yes: F.when(lower == yes, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}"))
    cols = [pick(c, True).alias(f"l_{c}") for c in rows.columns] + [pick(c, False).alias(f"r_{c}") for c in rows.columns]
    # The join buffers its right side, a lot at a time.
    # The partition's number keeps filters on what comes out from being moved into the join, where every candidate would pay for them.
    return r.join(l.hint("merge"), on).select(*cols, (d2 + F.spark_partition_id() * F.lit(0.0)).alias("d2"))


def near_rows(rows: DataFrame, seeds: DataFrame, cutoff: float) -> DataFrame:
    """The rows with a seed at most ``cutoff`` away, whole.  Places are compared, each once, however many rows share them."""
    spots, seeds = rows.select("x", "y", "z").distinct(), seeds.select("x", "y", "z").distinct()
    near = near_pairs(spots, seeds, cutoff).select(*(F.col(f"l_{c}").alias(c) for c in "xyz")).distinct()
    return rows.join(near, ["x", "y", "z"], "left_semi")


def within(atoms: DataFrame, seeds: DataFrame, cutoff: float, key: str = "atom") -> DataFrame:
    """The rows of ``atoms`` with a seed at most ``cutoff`` away, each once."""
    return near_rows(atoms.select(key, "x", "y", "z"), seeds, cutoff).select(key).distinct()


def pairs_within(atoms: DataFrame, cutoff: float, most: int | None = None, key: str = "atom", partition: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d2) of unordered pairs; more than ``most`` raise PairLimitError, none are dropped."""
    rows = atoms.select(key, *partition, "x", "y", "z")
    out = self_pairs(rows, cutoff, partition, key).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), "d2")
    if most is not None and out.count() > most:
        raise PairLimitError(f"more than {most} pairs within {cutoff}")
    return out


def placed(rows: DataFrame) -> DataFrame:
    """The rows whose coordinates are finite."""
    good = F.lit(True)
    for c in "xyz":
        v = F.col(c).cast("double")
        good = good & F.col(c).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return rows.filter(good)


def nearest(points: DataFrame, atoms: DataFrame, cutoff: float, key: str = "point", atom: str = "atom") -> DataFrame:
    """(point, atom, d2): the nearest atom of every point, the lower id of equals.

    Rings of cells of doubling size are searched until every point has an atom that is nearer
    than the ring is wide; only points without one go on to the next ring.  Points and atoms
    without finite coordinates take no part.
    """
    left, out, reach = placed(points.select(key, "x", "y", "z")), None, float(cutoff)
    targets = placed(atoms.select(atom, "x", "y", "z"))
    if targets.isEmpty():
        return points.select(key, F.lit(None).cast("long").alias(atom), F.lit(None).cast("double").alias("d2")).limit(0)
    while True:
        pairs = near_pairs(left, targets, reach)
        best = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min(F.struct("d2", f"r_{atom}")).alias("m"))
        best = best.select(key, F.col(f"m.r_{atom}").alias(atom), F.col("m.d2").alias("d2"))
        out = best if out is None else out.union(best)
        left = left.join(best.select(key), key, "left_anti")
        if left.isEmpty():
            return out
        reach *= 4


def morton(cols: list[Column], bits: int = 10) -> Column:
    """Interleave the low bits of integer columns: rows near in space get near numbers."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cols):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(cols) + k))
    return out


def cell_histogram(atoms: DataFrame, size: float) -> DataFrame:
    """(cx, cy, cz, n): rows per cell."""
    return atoms.select(*_cells(atoms, size)).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
