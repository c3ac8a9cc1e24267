"""Lowest modes of large elastic networks: Lanczos with the matrix as a table of entries.

A matrix is rows (i, j, h), each entry once, symmetric, without negative eigenvalues. A step joins the entries with the last vector and sums by
row; the driver holds the coefficients of the steps, never a vector. The vectors so far are an array in each row's state, which is
written once a step into the session's checkpoint folder, the one before it being removed; so disk and memory grow with
rows times steps. The start lies in the matrix's range, so modes of rigid bodies and of
loose parts don't enter, whatever parts the network has.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dynamics, graph

#: Eigenvalues up to this part of the largest one count as zero.
ZERO = 1e-7
#: Starts that are tried before a matrix is held to have no more modes.
STARTS = 3


class NoModes(ValueError):
    """Fewer modes than asked for, or none settled in the steps allowed."""


def network_matrix(nodes: DataFrame, cutoff: float, kind: str = "gnm") -> DataFrame:
    """(i, j, h) of nodes (atom, x, y, z) within ``cutoff``: one row an atom ('gnm'), or three, 3 * atom + axis ('anm')."""
    if kind not in ("gnm", "anm"):
        raise ValueError("kind must be gnm or anm")
    pairs = dynamics.elastic_pairs(nodes, cutoff)
    if kind == "anm":
        parts = [(r, s, F.col(f"u{c}") * F.col(f"u{d}")) for r, c in enumerate("xyz") for s, d in enumerate("xyz")]
        row = lambda atom, axis: F.col(atom) * 3 + axis
    else:
        parts, row = [(0, 0, F.lit(1.0))], lambda atom, axis: F.col(atom) + axis
    entries = [F.struct(row(p, r).alias("i"), row(q, s).alias("j"), (u if p == q else -u).alias("h")) for r, s, u in parts for p in "ab" for q in "ab"]
    return pairs.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.h").alias("h")).filter("h <> 0")


class _State:
    """A table in the checkpoint folder that takes the place of the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.last = spark, graph.shared_folder(spark), None

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/modes-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop()
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self.last:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            self.last = None


def _dots(state: DataFrame, w: Column) -> np.ndarray:
    """The products of w with every vector so far, and with itself; one number a step."""
    terms = F.transform(F.concat("q", F.array("w")), lambda x: x * F.col("w"))
    rows = state.withColumn("w", w).select(F.posexplode(terms).alias("k", "x")).groupBy("k").agg(F.sum("x")).collect()
    return np.array([x for _, x in sorted(map(tuple, rows))])


def _less(w: Column, c: np.ndarray) -> Column:
    if not len(c):
        return w
    return w - F.aggregate(F.zip_with("q", F.array(*map(F.lit, c.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, w): the matrix times (i, x)."""
    return matrix.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("h") * F.col("x")).alias("w"))


def lowest(matrix: DataFrame, count: int, steps: int = 400, tolerance: float = 1e-9) -> DataFrame:
    """(mode, eigenvalue, residual, i, v) of the ``count`` lowest modes above zero, each with its largest entry positive.

    Raises ``NoModes`` where the matrix has fewer, or they don't settle in ``steps`` steps.
    """
    if count < 1 or steps < 1:
        raise ValueError("count and steps must be positive")
    spark = matrix.sparkSession
    matrix = graph.cut(matrix.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("h").cast("double")).repartition("j"))
    every = matrix.select("i").distinct()
    held, alphas, betas, scale = _State(spark), [], [], 0.0

    def fresh(seed: int) -> DataFrame:
        noise = F.xxhash64("i", F.lit(seed)) / F.lit(float(1 << 63))
        return _times(matrix, every.select("i", noise.alias("x")))

    try:
        state = held.put(fresh(1).select("i", F.array().cast("array<double>").alias("q"), "w"))
        seed, started, found = 1, True, ()
        while True:
            c1 = _dots(state, F.col("w"))
            if not len(c1):
                raise NoModes("the matrix is empty")
            m = len(c1) - 1
            once = _less(F.col("w"), c1[:m])
            c2 = _dots(state, once)
            left = math.sqrt(max(0.0, c2[m] - float(c2[:m] @ c2[:m])))
            if started:
                new = left > 1e-10 * math.sqrt(c1[m])
            else:
                alphas.append(float(c1[m - 1] + c2[m - 1]))
                scale = max(scale, abs(alphas[-1]) + left)
                new = left > 1e-10 * scale
                values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
                found = np.flatnonzero(values > ZERO * values[-1])[:count]
                if len(found) == count and all(left * abs(vectors[-1, k]) <= tolerance * max(1.0, values[k]) for k in found):
                    return _assembled(matrix, state, vectors[:, found])
            if m >= steps:
                raise NoModes(f"not settled in {steps} steps")
            if not new:
                # Nothing leads out of what is spanned but another start, which finds equal eigenvalues.
                if seed == STARTS:
                    raise NoModes(f"only {len(found)} modes")
                seed, started = seed + 1, True
                state = held.put(state.select("i", "q").join(fresh(seed), "i"))
                continue
            if m:
                betas.append(0.0 if started else left)
            grown = state.select("i", "q", (_less(once, c2[:m]) / left).alias("x"))
            state = held.put(_times(matrix, grown).join(grown, "i").select("i", F.concat("q", F.array("x")).alias("q"), "w"))
            started = False
    finally:
        held.drop()


def _assembled(matrix: DataFrame, state: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Modes from their coefficients, with eigenvalues and residuals taken from the matrix itself."""
    mixed = [F.aggregate(F.zip_with("q", F.array(*map(F.lit, c.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for c in vectors.T]
    modes = state.select("i", F.posexplode(F.array(*mixed)).alias("mode", "v"))
    image = matrix.join(modes.withColumnRenamed("i", "j"), "j").groupBy("mode", "i").agg(F.sum(F.col("h") * F.col("v")).alias("hv"))
    both = graph.cut(modes.join(image, ["mode", "i"]))
    # One row a mode.
    v, hv = F.col("v"), F.col("hv")
    most = F.max(F.struct(F.abs(v).alias("size"), (-F.col("i")).alias("i"), v.alias("v")))["v"]
    of = both.groupBy("mode").agg((F.sum(v * hv) / F.sum(v * v)).alias("eigenvalue"), (F.signum(most) / F.sqrt(F.sum(v * v))).alias("by"))
    rows = both.join(F.broadcast(of), "mode").withColumns({"v": v * F.col("by"), "hv": hv * F.col("by")})
    off = rows.groupBy("mode").agg((F.sqrt(F.sum((hv - F.col("eigenvalue") * v) ** 2)) / F.greatest(F.lit(1.0), F.first("eigenvalue"))).alias("residual"))
    return rows.join(F.broadcast(off), "mode").select("mode", "eigenvalue", "residual", "i", "v")


def elastic_modes(nodes: DataFrame, cutoff: float, kind: str = "gnm", count: int = 10, steps: int = 400) -> DataFrame:
    """(mode, eigenvalue, residual, atom, vx, vy, vz) of the lowest modes of a network; of 'gnm' ones vx alone is used.

    Nodes that touch no other are in no mode and have no row. Any number of nodes.
    """
    rows = lowest(network_matrix(nodes, cutoff, kind), count, steps)
    if kind == "gnm":
        return rows.select("mode", "eigenvalue", "residual", F.col("i").alias("atom"), F.col("v").alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    part = [F.sum(F.when(F.pmod("i", F.lit(3)) == k, F.col("v"))).alias(f"v{c}") for k, c in enumerate("xyz")]
    return rows.groupBy("mode", "eigenvalue", "residual", F.expr("CAST(floor(i / 3) AS LONG)").alias("atom")).agg(*part)
