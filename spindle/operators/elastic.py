"""Inputs of elastic networks: guide atoms, springs, and which guide every atom follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..structure import Structure
from . import dynamics, graph, spatial

RESIDUE_MASS = 110.0


def ca_guides(s: Structure) -> DataFrame:
    """(node, atom, residue, altloc, x, y, z): the first CA of each protein residue of the first atom's model."""
    rows = s.wide().select("atom", "name", "residue", "altloc", "polymer", "model", "x", "y", "z")
    model = rows.agg(F.min_by("model", "atom").alias("model"))
    rows = rows.filter("name = 'CA' AND polymer = 'protein'").join(F.broadcast(model), "model", "left_semi")
    best = rows.groupBy("residue").agg(F.min_by(F.struct("atom", "altloc", "x", "y", "z"), "atom").alias("g")).select("residue", "g.*")
    return numbered(best, "atom", "node")


def numbered(df: DataFrame, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """``df`` with its rank by a unique integer column, from 0, counted in blocks of ids.

    Only the number of rows per block goes through one task.
    """
    blocks = df.withColumn("__b", F.floor(F.col(order) / F.lit(block)))
    sizes = blocks.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(order))
    return blocks.withColumn("__r", rank).join(before, "__b").withColumn(name, (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__b", "__r", "__before")


def springs(guides: DataFrame, cutoff: float = 15.0, k: float = 1.0, most: int | None = None) -> DataFrame:
    """(a, b, k, rest): contacts of guides with their rest lengths; with ``most``, more than that raise, none are dropped."""
    pairs = spatial.pairs_within(guides, cutoff, most)
    return pairs.select("a", "b", F.lit(float(k)).alias("k"), F.sqrt("d2").alias("rest"))


def spring_rows(springs_: DataFrame) -> DataFrame:
    """(node, neighbours, first): every node's sorted neighbours, and how many entries come before them."""
    both = springs_.select("a", "b").union(springs_.select("b", "a")).toDF("node", "other")
    rows = both.groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    degrees = numbered(rows.select("node", F.size("neighbours").cast("long").alias("degree")), "node", "k")
    lots = degrees.withColumn("__b", F.floor(F.col("k") / F.lit(1 << 16)))
    total = lots.groupBy("__b").agg(F.sum("degree").alias("__t")).withColumn("__before", F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).drop("__t")
    inner = F.sum("degree").over(Window.partitionBy("__b").orderBy("k")) - F.col("degree")
    first = lots.withColumn("__in", inner).join(total, "__b").select("node", (F.col("__in") + F.col("__before")).alias("first"))
    return rows.join(first, "node")


def network(s: Structure, cutoff: float = 15.0, k: float = 1.0, mass: float = RESIDUE_MASS) -> tuple[DataFrame, DataFrame]:
    """(nodes with masses, springs) of a structure; fewer than three guides are refused."""
    guides = ca_guides(s)
    if guides.limit(3).count() < 3:
        raise TypeError("an elastic network needs at least three guides")
    return guides.withColumn("mass", F.lit(float(mass))), springs(guides, cutoff, k)


def residue_guide_map(s: Structure, guides: DataFrame) -> DataFrame:
    """(atom, guide): the guide of its residue with the atom's altloc, else with none, else the first; or null."""
    g = guides.select(F.col("atom").alias("guide"), "residue", F.col("altloc").alias("__alt"))
    both = s.atoms.select("atom", "residue", "altloc").join(g, "residue", "left")
    rank = F.when(F.col("__alt") == F.col("altloc"), 0).when(F.col("__alt") == "", 1).otherwise(2)
    return both.groupBy("atom").agg(F.min_by("guide", F.struct(rank, "guide")).alias("guide"))


def displaced(s: Structure, guides: DataFrame, mode: DataFrame, amplitude: float, phase: float) -> DataFrame:
    """(atom, x, y, z): all atoms moved as their guides are along a mode (atom, vx, vy, vz)."""
    of = residue_guide_map(s, guides).join(mode.withColumnRenamed("atom", "guide"), "guide", "left").select("atom", "vx", "vy", "vz")
    return dynamics.apply_mode(s.atoms.select("atom", "x", "y", "z"), of, amplitude, phase)
