"""Named selections: lazy recipes, resolved against a structure.

Row predicates stay ``Column`` expressions and fuse into one filter; spatial and set
operators become joins.  A resolved selection knows its dataset and the revisions it read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .. import views
from ..structure import Structure
from . import spatial


class ScopeConflict(ValueError):
    """Two parts of a query ask for different views."""


@dataclass(frozen=True)
class Query:
    domain: str
    label: str
    #: atoms_wide (or residues_wide, bonds) -> predicate, if the query is a row predicate.
    predicate: Callable[[Structure], Column] | None = None
    #: (structure, universe of atoms) -> frame of atom ids, otherwise.
    rows: Callable[[Structure, DataFrame], DataFrame] | None = None
    view: dict = field(default_factory=dict)
    reads: frozenset = frozenset({"topology"})

    def __and__(self, other: Query) -> Query:
        return and_(self, other)

    def __or__(self, other: Query) -> Query:
        return or_(self, other)

    def __invert__(self) -> Query:
        return not_(self)


def all_(domain: str = "atom") -> Query:
    return Query(domain, f"all {domain}", lambda s: F.lit(True))


def where(domain: str, label: str, test: Column | Callable[[], Column], reads: tuple = ("topology",)) -> Query:
    return Query(domain, label, lambda s: test() if callable(test) else test, reads=frozenset(reads))


def element(z: int) -> Query:
    return Query("atom", f"element {z}", lambda s: F.col("element") == z)


def comp(names: list[str]) -> Query:
    return Query("residue", f"comp {names}", lambda s: F.col("residueComp").isin(*names))


def attribute(name: str, test: Callable[[Column], Column]) -> Query:
    def predicate(s: Structure) -> Column:
        s.attribute_domain(name)
        return test(F.col("residueComp" if name == "comp" else name))

    return Query("atom", f"attribute {name}", predicate, reads=frozenset({"topology", "attributes"}))


def model(id_: int) -> Query:
    return Query("atom", f"model {id_}", lambda s: F.col("model") == id_, view={"model": id_})


def protein() -> Query:
    return Query("atom", "protein", lambda s: F.col("polymer") == "protein")


def nucleic() -> Query:
    return Query("atom", "nucleic", lambda s: F.col("polymer").isin("rna", "dna"))


def _water(s: Structure) -> Column:
    by_name = F.col("residueComp").isin(*S.WATERS)
    if "entityType" not in s.chains.columns:
        return by_name
    kind = F.coalesce(F.col("entityType"), F.lit(""))
    return F.when(kind == "", by_name).otherwise(kind == "water")


def water() -> Query:
    return Query("atom", "water", _water)


def ligand() -> Query:
    return Query("atom", "ligand", lambda s: (F.col("polymer") == "other") & ~_water(s))


def chain(id_: str, namespace: str = "auth") -> Query:
    return Query("atom", f"chain {id_}", lambda s: F.col("authId" if namespace == "auth" else "labelId") == id_)


def residues(lo: int, hi: int, namespace: str = "auth") -> Query:
    def predicate(s: Structure) -> Column:
        if namespace == "label":
            return F.col("labelSeq").between(lo, hi) & (F.col("labelSeq") != -1)
        return F.coalesce(S.leading_int(F.col("authSeq")).between(lo, hi), F.lit(False))

    return Query("atom", f"residues {lo}-{hi}", predicate)


def secondary_structure(kind: str) -> Query:
    return Query("atom", f"ss {kind}", lambda s: (F.col("polymer") != "other") & (S.ss_kind(F.col("ssCode")) == kind), reads=frozenset({"topology", "attributes"}))


def within(cutoff: float, of: Query) -> Query:
    def rows(s: Structure, universe: DataFrame) -> DataFrame:
        seeds = universe.join(_atoms(of, s, universe), "atom", "left_semi")
        return spatial.within(universe, seeds, cutoff)

    return Query("atom", f"within {cutoff} of {of.label}", rows=rows, view=of.view, reads=of.reads | {"positions"})


def merged_view(parts: tuple[Query, ...]) -> dict:
    out: dict = {}
    for p in parts:
        for axis, value in p.view.items():
            if out.setdefault(axis, value) != value:
                raise ScopeConflict(f"{axis}: {out[axis]!r} and {value!r}")
    return out


def _boolean(parts: tuple[Query, ...], sign: str, fold: Callable, sets: Callable) -> Query:
    label = f" {sign} ".join(f"({p.label})" for p in parts)
    reads = frozenset().union(*(p.reads for p in parts))
    view = merged_view(parts)
    if all(p.predicate and p.domain != "bond" for p in parts):
        def predicate(s: Structure) -> Column:
            tests = [p.predicate(s) for p in parts]
            out = tests[0]
            for t in tests[1:]:
                out = fold(out, t)
            return out

        return Query("atom", label, predicate, view=view, reads=reads)

    def rows(s: Structure, universe: DataFrame) -> DataFrame:
        out = _atoms(parts[0], s, universe)
        for p in parts[1:]:
            out = sets(out, _atoms(p, s, universe))
        return out

    return Query("atom", label, rows=rows, view=view, reads=reads)


def and_(*parts: Query) -> Query:
    return _boolean(parts, "and", lambda a, b: a & b, lambda a, b: a.join(b, "atom", "left_semi"))


def or_(*parts: Query) -> Query:
    return _boolean(parts, "or", lambda a, b: a | b, lambda a, b: a.union(b).distinct())


def not_(q: Query) -> Query:
    if q.predicate and q.domain != "bond":
        return Query("atom", f"not ({q.label})", lambda s: ~F.coalesce(q.predicate(s), F.lit(False)), view=q.view, reads=q.reads)

    def rows(s: Structure, universe: DataFrame) -> DataFrame:
        return universe.select("atom").join(_atoms(q, s, universe), "atom", "left_anti")

    return Query("atom", f"not ({q.label})", rows=rows, view=q.view, reads=q.reads)


def compile_(tree, label: str = "expression") -> Query:
    """A named query from an expression tree; it reads the streams that the tree's symbols need."""
    from ..functions import expr

    words = set(_symbols(tree))
    reads = {"topology"}
    if any(w.rsplit(".", 1)[-1] in ("x", "y", "z", "within", "include-surroundings", "surrounding-ligands", "length") for w in words):
        reads.add("positions")
    if any("secondary-structure" in w or w.endswith(("B_iso_or_equiv", "occupancy", "pdbx_formal_charge")) for w in words):
        reads.add("attributes")
    return Query("atom", label, rows=lambda s, universe: expr.evaluate(s, tree, universe).flat(), reads=frozenset(reads))


def _symbols(tree):
    if isinstance(tree, dict):
        for v in tree.values():
            yield from _symbols(v)
    elif isinstance(tree, (list, tuple)) and tree:
        if isinstance(tree[0], str):
            yield tree[0]
        for v in tree[1:]:
            yield from _symbols(v)


def with_view(q: Query, **view) -> Query:
    """``q`` with some axes of its view set, whatever its parts ask for."""
    return replace(q, view=q.view | view)


def all_models(q: Query) -> Query:
    return with_view(q, model="all")


def all_conformers(q: Query) -> Query:
    return with_view(q, altloc="all")


def _atoms(q: Query, s: Structure, universe: DataFrame) -> DataFrame:
    """Ids of the atoms of ``universe`` (rows of atoms_wide) that ``q`` selects."""
    if q.domain == "bond":
        ids = s.bonds.filter(q.predicate(s)).select(F.explode(F.array("a", "b")).alias("atom")).distinct()
        return universe.select("atom").join(ids, "atom", "left_semi")
    if q.rows:
        return q.rows(s, universe)
    return universe.filter(q.predicate(s)).select("atom")


@dataclass(frozen=True)
class Selection:
    structure: Structure
    domain: str
    ids: DataFrame
    reads: dict

    def count(self) -> int:
        return self.ids.count()

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def is_stale(self, s: Structure) -> bool:
        return s.dataset != self.structure.dataset or any(s.revisions[k] != v for k, v in self.reads.items())

    def sorted(self) -> DataFrame:
        return self.ids.distinct().orderBy(self.domain)

    def identity(self) -> DataFrame:
        """Order-insensitive fingerprint of the ids: count, xor and sum of their hashes."""
        h = F.xxhash64(self.domain)
        return self.ids.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64(F.col(self.domain), F.lit(1)).cast("decimal(38,0)")).alias("s"))

    def same(self, other: Selection) -> bool:
        return self.ids.exceptAll(other.ids).isEmpty() and other.ids.exceptAll(self.ids).isEmpty()


def resolve(q: Query, s: Structure, view: dict | None = None) -> Selection:
    """Evaluate; with a view (the caller's or the query's) the result is always atoms."""
    scope = {**(view or {}), **q.view}
    reads = {k: s.revisions[k] for k in q.reads}
    if not scope and q.domain == "residue":
        rows = s.residues_wide().withColumn("residueComp", F.col("comp")).filter(q.predicate(s)).select("residue")
        return Selection(s, "residue", rows, reads)
    if not scope and q.domain == "bond":
        return Selection(s, "bond", s.bonds.filter(q.predicate(s)).select("bond"), reads)
    universe = s.wide()
    if scope:
        universe = views.active_atoms(s, scope.get("model", "all"), scope.get("altloc", "all"), universe)
    return Selection(s, "atom", _atoms(q, s, universe), reads)


def _together(a: Selection, b: Selection) -> dict:
    if a.structure.dataset != b.structure.dataset:
        raise ValueError("selections of different datasets")
    if a.domain != b.domain:
        raise ValueError("selections of different domains")
    for k in a.reads.keys() & b.reads.keys():
        if a.reads[k] != b.reads[k]:
            raise ValueError(f"selections of different {k}")
    return a.reads | b.reads


def union(a: Selection, b: Selection) -> Selection:
    return Selection(a.structure, a.domain, a.ids.union(b.ids).distinct(), _together(a, b))


def intersect(a: Selection, b: Selection) -> Selection:
    return Selection(a.structure, a.domain, a.ids.join(b.ids, a.domain, "left_semi").distinct(), _together(a, b))


def difference(a: Selection, b: Selection) -> Selection:
    return Selection(a.structure, a.domain, a.ids.join(b.ids, a.domain, "left_anti").distinct(), _together(a, b))


def to_atoms(sel: Selection) -> Selection:
    s = sel.structure
    if sel.domain == "residue":
        ids = s.atoms.select("atom", "residue").join(sel.ids, "residue", "left_semi").select("atom")
    elif sel.domain == "bond":
        ids = s.bonds.join(sel.ids, "bond", "left_semi").select(F.explode(F.array("a", "b")).alias("atom")).distinct()
    else:
        return sel
    return Selection(s, "atom", ids, sel.reads)


def to_residues(sel: Selection) -> Selection:
    atoms = to_atoms(sel)
    ids = sel.structure.atoms.select("atom", "residue").join(atoms.ids, "atom", "left_semi").select("residue").distinct()
    return Selection(sel.structure, "residue", ids, sel.reads)


def to_bonds(sel: Selection, endpoints: str = "both") -> Selection:
    ids, bonds = to_atoms(sel).ids.distinct(), sel.structure.bonds
    a = bonds.join(ids.select(F.col("atom").alias("a")), "a", "left_semi")
    if endpoints == "both":
        out = a.join(ids.select(F.col("atom").alias("b")), "b", "left_semi").select("bond")
    else:
        b = bonds.join(ids.select(F.col("atom").alias("b")), "b", "left_semi")
        out = a.select("bond").union(b.select("bond")).distinct()
    return Selection(sel.structure, "bond", out, sel.reads)
