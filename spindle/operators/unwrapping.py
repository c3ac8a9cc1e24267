"""Molecules made whole across periodic boundaries, without a task that holds one.

Each bond says by how many cells one end lies off the other's nearest image.  Components are found by
hooking every root to its least neighbouring root and jumping pointers, and the offsets are
summed along the pointers as they jump.  Bonds within a block of atoms of neighbouring ids are settled first, block by
block; only bonds between blocks, with the blocks' roots as ends, take joins, some log n of them.  The root is the component's
least atom and stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..structure import Structure
from . import graph
from .dynamics import minimum_image_triclinic

SHIFT = ("s0", "s1", "s2")
#: Atoms of a frame in one block, about, and blocks at most; where atoms are more than both allow, blocks are larger.
BLOCK, BLOCKS = 4_096, 1_000
#: Frames whose boxes may be sent to every task.
FEW = 10_000


@dataclass(frozen=True)
class Unwrapped:
    """positions: (frame, atom, component, x, y, z); status: (frame, status, ambiguous)."""

    positions: DataFrame
    status: DataFrame


def covalent_bonds(s: Structure) -> DataFrame:
    """(a, b) of the bonds known to be covalent, within a model and conformer."""
    at = s.atoms.join(s.residues.select("residue", "chain"), "residue").join(s.chains.select("chain", "model"), "chain")
    rows = s.bonds.filter(F.col("flags").cast("int").bitwiseAND(S.BOND_FLAGS["covalent"]) != 0).filter("a <> b").select("a", "b")
    for end in "ab":
        rows = rows.join(at.select(F.col("atom").alias(end), F.col("model").alias(f"{end}m"), F.col("altloc").alias(f"{end}l")), end)
    return rows.filter("am = bm AND (al = '' OR bl = '' OR al = bl)").select("a", "b").distinct()


def valid_boxes(boxes: DataFrame) -> DataFrame:
    """(frame, box, good): whether nine finite numbers span a cell."""
    n = lambda k: F.get("box", k).cast("double")
    det = n(0) * (n(4) * n(8) - n(5) * n(7)) - n(1) * (n(3) * n(8) - n(5) * n(6)) + n(2) * (n(3) * n(7) - n(4) * n(6))
    finite = F.forall("box", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return boxes.filter(F.col("box").isNotNull()).select("frame", "box", F.coalesce((F.size("box") == 9) & finite & (F.abs(det) > 1e-12), F.lit(False)).alias("good"))


def block_bounds(frames: DataFrame) -> np.ndarray:
    """The first ids of all blocks but the first one: quantiles of the atoms' ids."""
    most = frames.groupBy("frame").count().agg(F.max("count")).first()[0] or 0
    n = min(-(-most // BLOCK), BLOCKS)
    if n < 2:
        return np.zeros(0, np.int64)
    found = frames.agg(F.percentile_approx("atom", [k / n for k in range(1, n)], 10 * n)).first()[0]
    return np.unique(np.array(found, np.int64))


def bond_shifts(frames: DataFrame, edges: DataFrame, boxes: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(frame, a, b, s0, s1, s2, block): the lattice vector that brings b to its image nearest a; block: that of both ends, or -1."""
    ends = frames.select("frame", "atom", "x", "y", "z")
    rows = edges.join(ends.withColumnsRenamed({"atom": "a", "x": "ax", "y": "ay", "z": "az"}), "a")
    rows = rows.join(ends.withColumnsRenamed({"atom": "b", "x": "bx", "y": "by", "z": "bz"}), ["frame", "b"]).join(boxes.select("frame", "box"), "frame")
    rows = rows.select("frame", "a", "b", *((F.col(f"b{c}").cast("double") - F.col(f"a{c}").cast("double")).alias(f"d{c}") for c in "xyz"), "box")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, a, b = (batch.column(k).to_numpy() for k in range(3))
            d, shift = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], 1), np.zeros((batch.num_rows, 3))
            cells = batch.column(6).flatten().to_numpy().astype(float).reshape(-1, 3, 3)
            for f in np.unique(frame):
                at = np.flatnonzero(frame == f)
                shift[at] = np.round((minimum_image_triclinic(d[at], cells[at[0]]) - d[at]) @ np.linalg.inv(cells[at[0]]))
            own, to = (np.searchsorted(bounds, e, side="right") for e in (a, b))
            cols = [frame, a, b, *shift.astype(np.int64).T, np.where(own == to, own, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["frame", "a", "b", *SHIFT, "block"])

    # As many tasks as the session asks for, however few bytes the rows take.
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "frame", "a").mapInArrow(run, "frame int, a long, b long, s0 long, s1 long, s2 long, block long")


def settled(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(atoms, roots, offsets) of the ends of some bonds, as ``potentials`` finds them."""
    atoms, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root, off = np.arange(len(atoms)), np.zeros((len(atoms), 3), np.int64)
    while (live := root[i] != root[j]).any():
        i, j, s = i[live], j[live], s[live]
        d, down = off[i] + s - off[j], root[i] < root[j]
        high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
        order = np.lexsort((low, high))
        order = order[np.diff(high[order], prepend=-1) > 0]
        up, by = np.arange(len(atoms)), np.zeros_like(off)
        up[high[order]] = low[order]
        by[high[order]] = np.where(down[:, None], d, -d)[order]
        while (up[up] != up).any():
            by, up = by + by[up], up[up]
        off, root = off + by[root], up[root]
    return atoms, atoms[root], off


def potentials(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, atom, component, s0, s1, s2): each atom's offset from its component's least atom, summed along bonds.

    nodes: (frame, atom); edges: (frame, a, b, s0, s1, s2), b's offset being a's and s.
    """
    state = graph.cut(nodes.select("frame", "atom", F.col("atom").alias("root"), *(F.lit(0).cast("long").alias(c) for c in SHIFT)))
    while True:
        end = lambda e: state.select("frame", F.col("atom").alias(e), F.col("root").alias(f"{e}r"), *(F.col(c).alias(f"{e}{c}") for c in SHIFT))
        step = edges.join(end("a"), ["frame", "a"]).join(end("b"), ["frame", "b"]).filter("ar <> br")
        between = step.select("frame", "ar", "br", *((F.col(f"a{c}") + F.col(c) - F.col(f"b{c}")).alias(c) for c in SHIFT))
        up = between.select("frame", F.col("br").alias("root"), F.col("ar").alias("to"), *SHIFT)
        down = between.select("frame", F.col("ar").alias("root"), F.col("br").alias("to"), *((-F.col(c)).alias(c) for c in SHIFT))
        least = up.union(down).filter("to < root").groupBy("frame", "root").agg(F.min(F.struct("to", *SHIFT)).alias("h"))
        hooks = graph.cut(least.select("frame", "root", "h.to", *(f"h.{c}" for c in SHIFT)))
        if hooks.isEmpty():
            return state.select("frame", "atom", F.col("root").alias("component"), *SHIFT)
        while True:
            above = hooks.select("frame", F.col("root").alias("to"), F.col("to").alias("next"), *(F.col(c).alias(f"n{c}") for c in SHIFT))
            far = hooks.join(above, ["frame", "to"], "left")
            moved = graph.cut(far.select("frame", "root", F.coalesce("next", "to").alias("to"), *((F.col(c) + F.coalesce(f"n{c}", F.lit(0))).alias(c) for c in SHIFT), F.col("next").isNotNull().alias("moved")))
            hooks = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        hooked = hooks.select("frame", "root", "to", *(F.col(c).alias(f"n{c}") for c in SHIFT))
        state = state.join(hooked, ["frame", "root"], "left").select("frame", "atom", F.coalesce("to", "root").alias("root"), *((F.col(c) + F.coalesce(f"n{c}", F.lit(0))).alias(c) for c in SHIFT))
        state = graph.cut(state)


def whole(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``potentials`` of edges that have a block: those within blocks are settled there, the others between the blocks' roots."""

    def settle(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        atoms, roots, off = settled(table["a"].to_numpy(), table["b"].to_numpy(), table[list(SHIFT)].to_numpy())
        return pd.DataFrame({"frame": key[0], "atom": atoms, "root": roots, **{c: off[:, k] for k, c in enumerate(SHIFT)}})

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = edges.filter("block >= 0").repartition(parts, "frame", "block").groupBy("frame", "block").applyInPandas(settle, "frame int, atom long, root long, s0 long, s1 long, s2 long")
    within = graph.stored(within)
    between = edges.filter("block < 0").drop("block")
    for e in "ab":
        end = within.select("frame", F.col("atom").alias(e), F.col("root").alias(f"{e}r"), *(F.col(c).alias(f"{e}{c}") for c in SHIFT))
        between = between.join(end, ["frame", e], "left").withColumn(f"{e}r", F.coalesce(f"{e}r", e)).fillna(0, [f"{e}{c}" for c in SHIFT])
    moved = [(F.col(f"a{c}") + F.col(c) - F.col(f"b{c}")).alias(c) for c in SHIFT]
    between = graph.cut(between.select("frame", F.col("ar").alias("a"), F.col("br").alias("b"), *moved).filter("a <> b").distinct())
    roots = between.select("frame", "a").union(between.select("frame", "b")).distinct().withColumnRenamed("a", "atom")
    top = potentials(roots, between).withColumnsRenamed({"atom": "root", **{c: f"n{c}" for c in SHIFT}})
    held = nodes.select("frame", "atom").join(within, ["frame", "atom"], "left").withColumn("root", F.coalesce("root", "atom"))
    held = held.join(top, ["frame", "root"], "left")
    zero = F.lit(0).cast("long")
    return held.select("frame", "atom", F.coalesce("component", "root").alias("component"), *((F.coalesce(c, zero) + F.coalesce(f"n{c}", zero)).alias(c) for c in SHIFT))


def unwrap_frames(frames: DataFrame, edges: DataFrame, boxes: DataFrame, center: DataFrame | None = None) -> Unwrapped:
    """Every component of every frame whole; frames (frame, atom, x, y, z), edges (a, b), boxes (frame, box of nine).

    status: ``missing-box`` or ``invalid-box``, where positions stay as they are; ``ambiguous`` where bonds of a ring disagree
    about an image, with the number of such bonds; else ``ok``.  With ``center`` (atom) each component moves by whole
    cells so that the centre of its listed atoms lies in the first cell.
    """
    frames = frames.select("frame", "atom", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    known = graph.cut(valid_boxes(boxes))
    good = known.filter("good")
    if good.limit(FEW + 1).count() <= FEW:
        good = F.broadcast(good)
    inside = frames.join(good.select("frame"), "frame", "left_semi")
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    shifts = graph.stored(bond_shifts(inside, edges, good, block_bounds(inside)))
    found = whole(inside, shifts)
    end = lambda e: found.select("frame", F.col("atom").alias(e), *(F.col(c).alias(f"{e}{c}") for c in SHIFT))
    both = shifts.join(end("a"), ["frame", "a"]).join(end("b"), ["frame", "b"])
    off = F.lit(False)
    for c in SHIFT:
        off = off | (F.col(f"a{c}") + F.col(c) != F.col(f"b{c}"))
    bad = both.groupBy("frame").agg(F.count_if(off).alias("ambiguous"))
    placed = inside.join(found, ["frame", "atom"]).join(good.select("frame", "box"), "frame")
    lattice = lambda s: [sum((F.col(s[k]).cast("double") * F.get("box", 3 * k + axis).cast("double") for k in range(3)), F.lit(0.0)) for axis in range(3)]
    placed = placed.withColumns({c: F.col(c) + m for c, m in zip("xyz", lattice(SHIFT))})
    if center is not None:
        middle = placed.join(center.select("atom").distinct(), "atom", "left_semi").groupBy("frame", "component").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), F.first("box").alias("mbox"))

        def cells(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for table in tables:
                at = [np.floor(np.array(m, float) @ np.linalg.inv(np.array(b, float).reshape(3, 3))) for *m, b in zip(table["mx"], table["my"], table["mz"], table["mbox"])]
                at = np.array(at).reshape(-1, 3)
                yield table[["frame", "component"]].assign(**{f"c{k}": at[:, k] for k in range(3)})

        moved = middle.mapInPandas(cells, "frame int, component long, c0 double, c1 double, c2 double")
        placed = placed.join(moved, ["frame", "component"], "left").fillna(0.0, ["c0", "c1", "c2"])
        placed = placed.withColumns({c: F.col(c) - m for c, m in zip("xyz", lattice(("c0", "c1", "c2")))})
    cols = ["frame", "atom", "component", "x", "y", "z"]
    rest = frames.join(good.select("frame"), "frame", "left_anti").withColumn("component", F.lit(None).cast("long"))
    every = frames.select("frame").distinct().join(known.select("frame", "good"), "frame", "left").join(bad, "frame", "left")
    some = F.coalesce("ambiguous", F.lit(0))
    status = F.when(F.col("good").isNull(), "missing-box").when(~F.col("good"), "invalid-box").when(some > 0, "ambiguous").otherwise("ok")
    return Unwrapped(placed.select(*cols).union(rest.select(*cols)), every.select("frame", status.alias("status"), some.alias("ambiguous")))
