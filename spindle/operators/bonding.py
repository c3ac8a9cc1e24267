"""The bond graph that selections traverse: explicit bonds, or bonds by rules.

Without explicit bonds, listed connections are bonds of their own, components with bond tables
keep to them (but for hydrogens that the tables leave unbound), and all other atoms bond by the
thresholds of their elements.  Bonds to metals are metallic.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..structure import Structure
from . import graph, spatial

REACH = 4.0
COVALENT, METALLIC, COMPUTED = 1, 2, 32
# How near two atoms of an element bond (hydrogen 0, else the atomic number), in
# Angstrom; the default elsewhere; and pairs of elements with a threshold of their own.
DEFAULT_THRESHOLD = 2.001
ELEMENT_THRESHOLDS = (
    1.42, 1.42, 2.001, 2.7, 2.7, 2.001, 1.75, 1.6, 1.52, 2.001,
    2.001, 2.7, 2.7, 2.7, 1.9, 2, 1.9, 1.8, 2.001, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.001, 2.68, 2.001, 2.001, 2.001, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7,
    2.7, 2.001, 2.001, 2.001, 2.001, 2.7, 2.7, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.001, 2.001, 2.001, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7,
    2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.7, 2.88,
)
PAIR_THRESHOLDS = (
    (0, 0, 0.8), (0, 5, 1.31), (0, 6, 1.2), (0, 7, 1.15), (0, 8, 1.1), (0, 9, 1), (0, 15, 1.47), (0, 16, 1.45), (0, 17, 1.4), (0, 34, 1.54), (0, 35, 1), (0, 53, 1),
    (4, 8, 1.76), (4, 9, 1.63), (5, 5, 1.84), (5, 6, 1.88), (5, 7, 1.56), (5, 8, 1.68), (5, 9, 1.36), (5, 15, 1.98), (6, 6, 1.75), (6, 7, 1.6), (6, 8, 1.59),
    (6, 9, 1.45), (6, 14, 1.91), (6, 16, 2), (6, 17, 1.9), (6, 33, 2.6), (6, 34, 2.27), (6, 35, 2.1), (6, 52, 2.14), (6, 53, 2.48), (6, 80, 2.36), (7, 7, 1.6),
    (7, 12, 2.4), (7, 35, 2.06), (7, 78, 2.11), (8, 8, 1.6), (8, 12, 2.24), (8, 16, 1.8), (8, 33, 1.93), (8, 34, 2.05), (8, 35, 1.62), (8, 52, 2.1), (8, 53, 1.72),
    (8, 78, 2.6), (9, 9, 1.55), (9, 12, 2.02), (9, 31, 2.65), (14, 14, 2.37), (15, 15, 2.3), (15, 16, 2.3), (16, 16, 2.3), (16, 33, 2.68), (16, 34, 2.33),
    (16, 47, 2.72), (16, 80, 2.75), (17, 17, 2.1), (27, 51, 2.6), (34, 34, 2.34), (35, 46, 2.44), (35, 73, 2.63), (35, 78, 2.84), (35, 80, 2.87), (53, 53, 2.73), (53, 80, 2.81),
)
# Metals by atomic number.
METALS = (
    3, 4, 11, 12, 13, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50,
    55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 83, 87, 88,
    89, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109,
)


def _index(element: Column) -> Column:
    """Hydrogen 0, unknown -1, else the atomic number."""
    z = element.cast("int")
    return F.when(z == 1, 0).when((z == 0) | (z > 109), -1).otherwise(z)


def _threshold(e: Column) -> Column:
    table = F.array(*(F.lit(float(v)) for v in ELEMENT_THRESHOLDS))
    return F.coalesce(F.when(e >= 0, F.get(table, F.greatest(e, F.lit(0)))), F.lit(DEFAULT_THRESHOLD))


def _pairing(a: Column, b: Column) -> Column:
    """The threshold of two atoms, the one of lower id first."""
    items = [F.lit(v) for i, j, r in PAIR_THRESHOLDS for v in (i * 1024 + j, float(r))]
    own = F.try_element_at(F.create_map(*items), F.least(a, b) * 1024 + F.greatest(a, b))
    both = F.when(b < 0, _threshold(a)).otherwise((_threshold(a) + _threshold(b)) / 1.95)
    return F.coalesce(F.when((a >= 0) & (b >= 0), own), both)


def _metal(e: Column) -> Column:
    return e.isin(*METALS)


def widest(at: DataFrame) -> float:
    """How far the atoms (e) may at most be apart to bond: the widest threshold of two of their elements, and a hair."""
    kinds = at.select("e").distinct()
    most = kinds.crossJoin(kinds.withColumnRenamed("e", "f")).agg(F.max(_pairing(F.col("e"), F.col("f")))).first()[0]
    return min(REACH, (most or 0.0) * (1 + 1e-9))


def computed_bonds(s: Structure) -> DataFrame:
    """(a, b, flags, order), a < b: the bonds that the rules give."""
    own = "comp" if "comp" in s.atoms.columns else "residueComp"
    at = s.wide().select(
        "atom", "residue", "chain", "altloc", "x", "y", "z", _index(F.col("element")).alias("e"), F.col("occupancy").cast("double").alias("occupancy"),
        "authSeq", (F.coalesce(F.col(own), F.col("residueComp")) != F.col("residueComp")).alias("other"),
    )
    at = graph.cut(at)
    mixed = at.filter("other").select("residue").distinct()
    ends = lambda links: _with_ends(links, at)
    empty = s.atoms.sparkSession.createDataFrame([], "a long, b long, order int, flags int, source string")
    links = s.links.select("a", "b", F.col("order").cast("int").alias("order"), F.col("flags").cast("int").alias("flags"), "source") if s.links is not None else empty
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "order", "flags", "source")
    conn = ends(links.filter("source <> 'component'"))
    comp = ends(links.filter("source = 'component'"))
    together = conn.select(F.least("a_residue", "b_residue").alias("lo"), F.greatest("a_residue", "b_residue").alias("hi")).distinct()
    listed = conn.filter((F.col("a_chain") == F.col("b_chain")) | (F.col("d2") <= REACH * REACH)).select("a", "b", "flags", "order")
    tabled = comp.select(F.col("a_residue").alias("residue")).distinct().join(mixed, "residue", "left_anti")
    pair = (F.least("a_residue", "b_residue") == F.col("lo")) & (F.greatest("a_residue", "b_residue") == F.col("hi"))
    kept = comp.filter((F.col("a_residue") == F.col("b_residue")) & _compatible("a_altloc", "b_altloc") & ~((F.col("a_e") == 0) & (F.col("b_e") == 0)) & (F.col("d2") <= REACH * REACH))
    kept = kept.join(tabled, F.col("a_residue") == F.col("residue"), "left_semi").join(together, pair, "left_anti")
    flags = F.when(_metallic("a_e", "b_e"), F.col("flags").bitwiseAND(F.lit(~COVALENT)).bitwiseOR(F.lit(METALLIC))).otherwise(F.col("flags"))
    template = kept.select("a", "b", flags.alias("flags"), "order")
    found = spatial.self_pairs(at, widest(at)).filter(~((F.col("l_e") == 0) & (F.col("r_e") == 0)))
    found = found.filter(_compatible("l_altloc", "r_altloc") & (F.col("d2") > 0) & (F.sqrt("d2") <= _pairing(F.col("l_e"), F.col("r_e"))))
    found = found.join(together, (F.least("l_residue", "r_residue") == F.col("lo")) & (F.greatest("l_residue", "r_residue") == F.col("hi")), "left_anti")
    partners = conn.select(F.col("a").alias("p"), F.col("b_chain").alias("pc")).union(conn.select("b", "a_chain")).distinct()
    for one, other in (("l", "r"), ("r", "l")):
        across = (F.col("l_chain") != F.col("r_chain")) & (F.col(f"{one}_atom") == F.col("p")) & (F.col(f"{other}_chain") == F.col("pc"))
        found = found.join(partners, across, "left_anti")
    partial = (F.col("l_chain") != F.col("r_chain")) & (F.col("l_occupancy") < 1) & (F.col("r_occupancy") < 1) & (F.col("l_authSeq") == F.col("r_authSeq"))
    found = found.filter(~partial).join(tabled.withColumn("tabled", F.lit(True)), (F.col("l_residue") == F.col("residue")) & (F.col("l_residue") == F.col("r_residue")), "left")
    found = found.join(template.select(F.col("a").alias("ta"), F.col("b").alias("tb")).distinct(), (F.col("l_atom") == F.col("ta")) & (F.col("r_atom") == F.col("tb")), "left")
    inside = F.col("tabled").isNotNull() & (((F.col("l_e") != 0) & (F.col("r_e") != 0)) | F.col("ta").isNotNull())
    kind = F.when(_metallic("l_e", "r_e"), METALLIC).otherwise(COVALENT).bitwiseOR(F.lit(COMPUTED))
    near = found.filter(~inside).select(F.col("l_atom").alias("a"), F.col("r_atom").alias("b"), kind.alias("flags"), F.lit(1).alias("order"))
    every = listed.unionByName(template).unionByName(near)
    return every.groupBy("a", "b").agg(F.bit_or(F.col("flags").cast("int")).alias("flags"), F.max(F.col("order").cast("int")).alias("order"))


def _compatible(a: str, b: str) -> Column:
    return (F.col(a) == "") | (F.col(b) == "") | (F.col(a) == F.col(b))


def _metallic(a: str, b: str) -> Column:
    return (_metal(F.col(a)) | _metal(F.col(b))) & (F.col(a) != 0) & (F.col(b) != 0)


def _with_ends(links: DataFrame, at: DataFrame) -> DataFrame:
    out = links
    for end in "ab":
        cols = [F.col(c).alias(f"{end}_{c}") for c in ("residue", "chain", "altloc", "e", "x", "y", "z")]
        out = out.join(at.select(F.col("atom").alias(end), *cols), end)
    d = [F.col(f"a_{c}").cast("double") - F.col(f"b_{c}").cast("double") for c in "xyz"]
    return out.withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def preserve_bond_graph(source: Structure, snapshot: Structure) -> Structure:
    """``snapshot`` with the bond graph of its source, wherever its atoms have moved."""
    if source.dataset != snapshot.dataset or source.revisions["topology"] != snapshot.revisions["topology"]:
        raise TypeError("preserve_bond_graph needs the same dataset and topology")
    return replace(snapshot, edges=graph.bond_graph(source))
