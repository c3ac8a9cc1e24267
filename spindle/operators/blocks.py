"""Pairs of near points by blocks: points in spatial order, a box for each block, boxes before points.

Points are range-partitioned by the Morton number of their cell, so a block holds neighbours and is of
bounded size however dense a place is.  Blocks whose boxes lie within reach meet; how many pairs of points that
takes is known from the blocks' sizes before any points do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, spatial

#: Cells an axis of the spatial order.
AXIS_BITS = 16
ROWS = 1_024


def spatial_order(points: DataFrame, key: str, size: float, rows: int = ROWS) -> DataFrame:
    """(key, x, y, z, block), cut: points in Morton order of cells of ``size``, ``rows`` to a block at most."""
    at = points.select(F.col(key).cast("long").alias(key), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    least = at.agg(*(F.min(c).alias(c) for c in "xyz")).first()
    # Cells beyond the last are dealt with it: the order suffers there, the pairs don't.
    cells = [F.least(F.floor((F.col(c) - F.lit(float(least[c] or 0.0))) / size), F.lit((1 << AXIS_BITS) - 1)).cast("long") for c in "xyz"]
    placed = at.withColumn("place", spatial.morton(cells, AXIS_BITS))
    dealt = placed.repartitionByRange(max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "place", key).sortWithinPartitions("place", key)

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, seen = TaskContext.get().partitionId() << 40, 0
        for t in tables:
            yield t.drop(columns="place").assign(block=first + (seen + np.arange(len(t))) // rows)
            seen += len(t)

    return graph.cut(dealt.mapInPandas(run, f"{key} long, x double, y double, z double, block long"))


def row_bounds(blocks: DataFrame) -> DataFrame:
    """(block, n, lox, hix, loy, hiy, loz, hiz): how many points a block has, and its box."""
    return blocks.groupBy("block").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))


def block_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """(lb, rb, work) of the blocks (``row_bounds``) whose boxes are within ``reach``; work: pairs of points.

    Boxes meet in the cells they touch.  Cells are as wide as an average box and the reach, but so that no box touches more than
    some thousand; a pair counts in the least cell that both touch.
    """
    wide = lambda b: b.agg(*(f(F.col(f"hi{c}") - F.col(f"lo{c}")).alias(f"{n}{c}") for c in "xyz" for n, f in (("a", F.avg), ("m", F.max)))).first()
    extents = [wide(b) for b in (left, right)]
    size = {c: max(reach, *((e[f"a{c}"] or 0.0) for e in extents), *((e[f"m{c}"] or 0.0) / 12 for e in extents), 1e-6) for c in "xyz"}

    def touched(b: DataFrame, side: str, by: float) -> DataFrame:
        out = b.select(F.col("block").alias(f"{side}b"), F.col("n").alias(f"{side}n"), *(F.col(f"{e}{c}").alias(f"{side}{e}{c}") for c in "xyz" for e in ("lo", "hi")))
        for c in "xyz":
            low, high = (F.floor((F.col(f"{side}{e}{c}") + d) / size[c]).cast("long") for e, d in (("lo", -by), ("hi", by)))
            out = out.withColumn(f"{side}c{c}", low).withColumn(f"c{c}", F.explode(F.sequence(low, high)))
        return out

    met = touched(left, "l", reach).join(touched(right, "r", 0.0), ["cx", "cy", "cz"])
    once, apart = F.lit(True), F.lit(0.0)
    for c in "xyz":
        once = once & (F.col(f"c{c}") == F.greatest(f"lc{c}", f"rc{c}"))
        gap = F.greatest(F.col(f"llo{c}") - F.col(f"rhi{c}"), F.col(f"rlo{c}") - F.col(f"lhi{c}"), F.lit(0.0))
        apart = apart + gap * gap
    return met.filter(once & (apart <= float(reach) * float(reach))).select("lb", "rb", (F.col("ln") * F.col("rn")).alias("work"))


def near_by_blocks(left: DataFrame, right: DataFrame, reach: float, key: str = "atom", budget: int | None = None, rows: int = ROWS) -> DataFrame:
    """(l, r, d2) of all points (key, x, y, z) of both sides within ``reach``, distances in DOUBLE, inclusive.

    More than ``budget`` pairs of points to look at raise PairLimitError before any is.  Points without finite
    coordinates take no part.
    """
    if not reach > 0 or not np.isfinite(reach):
        raise ValueError("reach must be a positive number")
    sides = [spatial_order(spatial.placed(s.select(key, "x", "y", "z")), key, reach, rows) for s in (left, right)]
    pairs = graph.cut(block_pairs(*(graph.cut(row_bounds(s)) for s in sides), reach))
    if budget is not None:
        work = pairs.agg(F.sum("work")).first()[0] or 0
        if work > budget:
            raise spatial.PairLimitError(f"{work} pairs of points to look at, more than {budget}")
    pairs = pairs.withColumn("pair", F.monotonically_increasing_id())
    pairs = graph.cut(pairs)
    l = pairs.select("pair", F.col("lb").alias("block")).join(sides[0], "block").select("pair", F.col(key).alias("id"), "x", "y", "z")  # noqa: E741
    r = pairs.select(F.col("pair").alias("of"), F.col("rb").alias("block")).join(sides[1], "block").select("of", F.col(key).alias("id"), "x", "y", "z")
    far = float(reach) * float(reach)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.stack([t.column(c).to_numpy() for c in "xyz"], 1) for t in (a, b))
        d2 = np.zeros((len(x), len(y)))
        for c in range(3):
            d2 += (x[:, None, c] - y[None, :, c]) ** 2
        i, j = np.nonzero(d2 <= far)
        return pa.table({"l": pa.array(a.column("id").to_numpy()[i]), "r": pa.array(b.column("id").to_numpy()[j]), "d2": pa.array(d2[i, j])})

    return l.groupBy("pair").cogroup(r.groupBy("of")).applyInArrow(meet, "l long, r long, d2 double")
