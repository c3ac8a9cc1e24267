"""A structure: one DataFrame per table, an identity and a revision per stream.

Values are immutable; ``with_attributes`` and ``with_positions`` return new ones with the
revision of the stream they change raised.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S

_revision = itertools.count(1)


class StructureError(ValueError):
    """A broken constraint; ``violations`` holds (path, message) rows."""

    def __init__(self, message: str, violations: list | None = None):
        super().__init__(message)
        self.violations = violations or []


@dataclass(frozen=True)
class Structure:
    atoms: DataFrame
    residues: DataFrame
    chains: DataFrame
    bonds: DataFrame | None = None
    links: DataFrame | None = None
    instances: DataFrame | None = None
    dataset: str = field(default_factory=lambda: uuid.uuid4().hex)
    revisions: dict = field(default_factory=lambda: {"topology": 0, "positions": 0, "attributes": 0})
    attributes: dict = field(default_factory=dict)
    #: A bond graph pinned to these coordinates (see operators.bonding); none is computed then.
    edges: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.atoms.sparkSession

    def wide(self) -> DataFrame:
        """Atoms with the columns of their residue and chain; Catalyst prunes what isn't read."""
        residues = self.residues.withColumnsRenamed({"comp": "residueComp"})
        atoms = self.atoms
        if "comp" not in atoms.columns:
            atoms = atoms.withColumn("comp", F.lit(None).cast("string"))
        return atoms.join(residues, "residue").join(self.chains, "chain")

    def residues_wide(self) -> DataFrame:
        return self.residues.join(self.chains, "chain")

    def with_attributes(self, changes: dict[str, DataFrame | None], domain: str = "atom", provenance: str = "user") -> Structure:
        """Add, replace (frames of id and value) or remove (None) derived columns."""
        if not changes:
            return self
        table, key = ("atoms", "atom") if domain == "atom" else ("residues", "residue")
        df, known = getattr(self, table), dict(self.attributes)
        for name, values in changes.items():
            if values is None:
                known.pop(name, None)
                df = df.drop(name)
                continue
            value = values.select(F.col(values.columns[0]).alias(key), F.col(values.columns[1]).alias(name, metadata={"provenance": provenance}))
            df = df.drop(name).join(value, key, "left")
            known[name] = (domain, provenance)
        return replace(self, **{table: df}, attributes=known, revisions=self.revisions | {"attributes": next(_revision)})

    def with_positions(self, positions: DataFrame) -> Structure:
        """Replace the coordinates of the atoms listed in (atom, x, y, z)."""
        moved = positions.select("atom", *(F.col(c).cast("float").alias(f"__{c}") for c in "xyz"))
        atoms = self.atoms.join(moved, "atom", "left")
        for c in "xyz":
            atoms = atoms.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
        return replace(self, atoms=atoms, edges=None, revisions=self.revisions | {"positions": next(_revision)})

    def attribute_domain(self, name: str) -> str:
        if name in self.attributes:
            return self.attributes[name][0]
        for domain, df in (("atom", self.atoms), ("residue", self.residues), ("residue", self.chains)):
            if name in df.columns:
                return domain
        raise KeyError(f"no column {name!r}")

    def attribute_names(self) -> list[str]:
        return sorted({*self.atoms.columns, *self.residues.columns, *self.attributes})

    def attribute(self, name: str, domain: str | None = None) -> DataFrame:
        """(id, value) of a column; residue columns are lifted onto atoms on request."""
        own = self.attribute_domain(name)
        if own == "residue":
            at = self.residues if name in self.residues.columns else self.residues_wide()
            rows = at.select("residue", F.col(name).alias("value"))
            return rows if domain != "atom" else self.atoms.select("atom", "residue").join(rows, "residue").select("atom", "value")
        if domain == "residue":
            raise ValueError(f"{name!r} is an atom column")
        return self.atoms.select("atom", F.col(name).alias("value"))


def violations(s: Structure) -> DataFrame:
    """(path, id, message) of every broken constraint."""
    found = []

    def add(df: DataFrame, path: str, key: str, message: str) -> None:
        found.append(df.select(F.lit(path).alias("path"), F.col(key).cast("string").alias("id"), F.lit(message).alias("message")))

    def foreign(df: DataFrame, column: str, to: DataFrame, key: str, path: str, of: str) -> None:
        ids = to.select(F.col(key).alias("__k"))
        add(df.join(ids, F.col(column) == F.col("__k"), "left_anti"), path, of, "refers to no row")

    def unique(df: DataFrame, cols: list[str], path: str) -> None:
        many = df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
        add(many.withColumn("__id", F.concat_ws("/", *(F.col(c).cast("string") for c in cols))), path, "__id", "is not unique")

    def rule(df: DataFrame, bad, path: str, key: str, message: str) -> None:
        add(df.filter(bad), path, key, message)

    def infinite(c: str):
        value = F.col(c).cast("double")
        return F.col(c).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    a, r, c = s.atoms, s.residues, s.chains
    foreign(a, "residue", r, "residue", "atoms.residue", "atom")
    foreign(r, "chain", c, "chain", "residues.chain", "residue")
    unique(a, ["residue", "name", "altloc"], "atoms.(residue,name,altloc)")
    unique(c, ["model", "labelId"], "chains.(model,labelId)")
    rule(a, ~F.col("element").between(0, 118), "atoms.element", "atom", "expected 0..118")
    rule(a, ~F.col("occupancy").between(0, 1), "atoms.occupancy", "atom", "expected 0..1")
    for col in "xyz":
        if col in a.columns:
            rule(a, infinite(col), f"atoms.{col}", "atom", "expected finite number")
    if "radius" in a.columns:
        rule(a, F.col("radius").isNotNull() & (infinite("radius") | (F.col("radius") <= 0)), "atoms.radius", "atom", "expected a positive number")
    rule(r, ~F.col("polymer").isin(*S.POLYMERS), "residues.polymer", "residue", "expected a polymer kind")
    if s.bonds is not None:
        for end in "ab":
            foreign(s.bonds, end, a, "atom", f"bonds.{end}", "bond")
        rule(s.bonds, F.col("a") == F.col("b"), "bonds", "bond", "joins an atom to itself")
        rule(s.bonds, ~F.col("order").between(0, 4), "bonds.order", "bond", "expected 0..4")
        unique(s.bonds.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "bonds.(a,b)")
        at = a.join(r.select("residue", "chain"), "residue").join(c.select("chain", "model"), "chain")
        ends = s.bonds
        for end in "ab":
            ends = ends.join(at.select(F.col("atom").alias(end), *(F.col(x).alias(f"{end}_{x}") for x in ("model", "residue", "altloc"))), end)
        rule(ends, F.col("a_model") != F.col("b_model"), "bonds", "bond", "joins two models")
        clash = (F.col("a_residue") == F.col("b_residue")) & (F.col("a_altloc") != "") & (F.col("b_altloc") != "") & (F.col("a_altloc") != F.col("b_altloc"))
        rule(ends, clash, "bonds", "bond", "joins two conformers of a residue")
    if s.links is not None:
        rule(s.links, F.col("a") == F.col("b"), "links", "link", "joins an atom to itself")
        rule(s.links, F.col("order") > 4, "links.order", "link", "expected at most 4")
    if s.instances is not None:
        foreign(s.instances, "chain", c, "chain", "instances.chain", "instance")
        last = [F.get("transform", i) for i in (3, 7, 11, 15)]
        rule(s.instances, (F.size("transform") != 16) | (last[0] != 0) | (last[1] != 0) | (last[2] != 0) | (last[3] != 1), "instances.transform", "instance", "expected an affine matrix")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def validated(s: Structure, limit: int = 20) -> Structure:
    """``s``, or StructureError with the first violations."""
    bad = violations(s).orderBy("path", "id").limit(limit).collect()
    if bad:
        raise StructureError(f"{bad[0]['path']}[{bad[0]['id']}]: {bad[0]['message']}", [tuple(b) for b in bad])
    return s


def create_structure(spark: SparkSession, tables: dict, check: bool = True) -> Structure:
    """A structure from rows (lists or DataFrames) per table."""
    frames = {}
    for name, rows in tables.items():
        frames[name] = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, S.TABLES[name])
    out = Structure(**frames)
    return validated(out) if check else out
