"""Views over a structure: eligible atoms, bounds, ranges, radii, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schema as S
from .structure import Structure

EXACT = "decimal(38,9)"


def primary_altlocs(s: Structure) -> DataFrame:
    """(residue, altloc): per residue the label with the largest summed occupancy, then lexical."""
    sums = s.atoms.filter("altloc <> ''").groupBy("residue", "altloc").agg(F.sum(F.col("occupancy").cast(EXACT)).alias("occ"))
    return sums.groupBy("residue").agg(F.min_by("altloc", F.struct((-F.col("occ")).alias("o"), "altloc")).alias("altloc"))


def first_model(s: Structure) -> DataFrame:
    return s.chains.agg(F.min_by("model", "chain").alias("model"))


def active_atoms(s: Structure, model: str | int = "first", altloc: str = "primary", base: DataFrame | None = None) -> DataFrame:
    """The atoms of a view; model: 'first', 'all' or an id; altloc: 'primary', 'all' or a label."""
    atoms = s.atoms if base is None else base
    if model != "all":
        chains = s.chains.select("chain", "model")
        if model == "first":
            chains = chains.join(F.broadcast(first_model(s)), "model")
        else:
            chains = chains.filter(F.col("model") == model)
            if chains.isEmpty():
                raise KeyError(f"no model {model}")
        scope = s.residues.select("residue", "chain").join(chains.select("chain"), "chain", "left_semi").select("residue")
        atoms = atoms.join(scope, "residue", "left_semi")
    if altloc == "primary":
        best = primary_altlocs(s).select("residue", F.col("altloc").alias("__best"))
        atoms = atoms.join(best, "residue", "left").filter((F.col("altloc") == "") | (F.col("altloc") == F.col("__best"))).drop("__best")
    elif altloc != "all":
        atoms = atoms.filter(F.col("altloc").isin("", altloc))
    return atoms


def residue_key(*cols: str) -> Column:
    return F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


def coordinate_bounds(atoms: DataFrame) -> DataFrame:
    """One row of least, greatest and middle coordinates; nulls when there is no atom."""
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    out = atoms.agg(*aggs)
    return out.select("*", *(((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"mid_{c}") for c in "xyz"))


def column_range(df: DataFrame, column: str) -> DataFrame:
    """(lo, hi); [0, 1] when empty, [lo, lo + 1] when constant."""
    got = df.agg(F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi"))
    hi = F.when(F.col("lo").isNull(), 1.0).when(F.col("lo") == F.col("hi"), F.col("lo") + 1).otherwise(F.col("hi"))
    return got.select(F.coalesce("lo", F.lit(0.0)).alias("lo"), hi.alias("hi"))


def atom_radii(s: Structure) -> DataFrame:
    radius = S.display_radius(F.col("element"))
    if "radius" in s.atoms.columns:
        radius = F.coalesce(F.col("radius").cast("double"), radius)
    return s.atoms.select("atom", radius.alias("radius"))


def centroid(atoms: DataFrame) -> DataFrame:
    return atoms.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"))


def run_ids(df: DataFrame, key: str, order: str, partition: list[str], name: str = "run") -> DataFrame:
    """Number the runs of equal ``key`` along ``order`` in each partition, from 1."""
    w = Window.partitionBy(*partition).orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__new")


def suffixed_labels(df: DataFrame, label: str, partition: list[str], order: str, name: str = "unique") -> DataFrame:
    """``A``, ``A_1``, ``A_2`` ... for repeated labels in order of appearance."""
    w = Window.partitionBy(*partition, label).orderBy(order)
    n = F.row_number().over(w) - 1
    return df.withColumn(name, F.when(n == 0, F.col(label)).otherwise(F.concat(F.col(label), F.lit("_"), n.cast("string"))))
