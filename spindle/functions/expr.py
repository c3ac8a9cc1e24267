"""The closed expression language: trees of symbols compiled to columns and set relations.

A tree is ``[symbol, argument ...]`` with an optional dictionary of named arguments, or a plain
number, string or boolean.  Scalar symbols compile to typed columns; generators, modifiers,
combinators and filters to relations (set_id, atom), one row for each atom of each set.
Unknown symbols, unknown arguments and wrong numbers of arguments are errors when compiled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import graph, spatial
from ..structure import Structure
from . import js


class ExpressionError(ValueError):
    """A tree that the language does not hold."""


@dataclass
class Typed:
    kind: str  # num, str, bool, list, regex
    col: Column | None
    value: Any = None


@dataclass
class Sets:
    """A relation (set_id, atom); singletons: every set is one atom and its id that atom."""

    rows: DataFrame
    singletons: bool

    def flat(self) -> DataFrame:
        return self.rows.select("atom").distinct()


def literal(x: Any) -> Typed:
    kind = "bool" if isinstance(x, bool) else "num" if isinstance(x, (int, float)) else "str"
    return Typed(kind, F.lit(float(x)) if kind == "num" else F.lit(x), x)


def split(tree: Any) -> tuple[str, list, dict]:
    if isinstance(tree, dict):
        tree = [tree["name"], *tree.get("args", []), tree.get("named", {})]
    name, *args = tree
    named = args.pop() if args and isinstance(args[-1], dict) and "name" not in args[-1] else {}
    return name, args, named


def _same_kind(xs: list[Typed], name: str, kind: str) -> None:
    for x in xs:
        if x.kind != kind:
            raise ExpressionError(f"{name}: expected {kind}, got {x.kind}")


def _fold(f, empty):
    def run(xs: list[Typed]) -> Typed:
        out = F.lit(float(empty))
        for k, x in enumerate(xs):
            out = js.num(x.col) if k == 0 else f(out, js.num(x.col))
        return Typed("num", out)

    return run


def _sub(xs: list[Typed]) -> Typed:
    if len(xs) == 1:
        return Typed("num", -js.num(xs[0].col))
    return _fold(lambda a, b: a - b, 0)(xs)


def _logic(f, empty: bool):
    def run(xs: list[Typed]) -> Typed:
        out = F.lit(empty)
        for x in xs:
            out = f(out, js.truth(x.col, x.kind))
        return Typed("bool", out)

    return run


def _relation(op: str):
    def run(xs: list[Typed]) -> Typed:
        a, b = xs
        if a.kind != b.kind:
            if op in ("eq", "neq"):
                return Typed("bool", F.lit(op == "neq"))
            return Typed("bool", js.compare(op, js.num(a.col), js.num(b.col), True))
        return Typed("bool", js.compare(op, a.col, b.col, a.kind == "num"))

    return run


def _string(x: Typed) -> Column:
    if x.kind == "num":
        whole = F.when(x.col == F.floor(x.col), F.floor(x.col).cast("string"))
        return F.coalesce(F.when(F.isnan(x.col), "NaN"), whole, x.col.cast("string"))
    return x.col.cast("string")


def _number(x: Typed) -> Typed:
    if x.kind == "num":
        return x
    if x.kind == "bool":
        return Typed("num", x.col.cast("double"))
    return Typed("num", F.when(F.trim(x.col) == "", 0.0).otherwise(F.coalesce(x.col.try_cast("double"), js.nan())))


def _pattern(x: Typed) -> str:
    return x.value if x.kind in ("regex", "str") else _raise("expected a pattern")


def _raise(message: str):
    raise ExpressionError(message)


def _regex(xs: list[Typed]) -> Typed:
    flags = "".join(f for f in (xs[1].value if len(xs) > 1 else "") if f in "ims")
    source = xs[0].value
    re.compile(source)
    return Typed("regex", None, f"(?{flags}){source}" if flags else source)


def _bits(names: dict, lower: bool):
    def run(xs: list[Typed]) -> Typed:
        mask = 0
        for x in xs:
            for n in x.value if isinstance(x.value, list) else [x.value]:
                mask |= names.get(str(n).lower() if lower else n, 0)
        return Typed("num", F.lit(float(mask)), mask)

    return run


def _flags(every: bool):
    def run(xs: list[Typed]) -> Typed:
        have, want = xs[0].col.cast("long"), xs[1].col.cast("long")
        both = have.bitwiseAND(want)
        if every:
            return Typed("bool", F.when(want == 0, have == 0).otherwise(both == want))
        return Typed("bool", F.when(want == 0, have != 0).otherwise(both != 0))

    return run


def _list(kind: str):
    def run(xs: list[Typed]) -> Typed:
        cols = F.array(*(x.col for x in xs)) if xs else F.array().cast("array<string>")
        return Typed("list", F.array_distinct(cols) if kind == "set" else cols, [x.value for x in xs])

    return run


N = 10**6
#: symbol -> (least arguments, most arguments, compile).
PURE: dict[str, tuple] = {
    "core.type.bool": (1, 1, lambda xs: Typed("bool", js.truth(xs[0].col, xs[0].kind))),
    "core.type.num": (1, 1, lambda xs: _number(xs[0])),
    "core.type.str": (1, 1, lambda xs: Typed("str", _string(xs[0]))),
    "core.type.regex": (1, 2, _regex),
    "core.type.list": (0, N, _list("list")),
    "core.type.set": (0, N, _list("set")),
    "core.type.composite-key": (0, N, lambda xs: Typed("str", F.concat_ws("-", *(_string(x) for x in xs)))),
    "core.logic.not": (1, 1, lambda xs: Typed("bool", ~js.truth(xs[0].col, xs[0].kind))),
    "core.logic.and": (0, N, _logic(lambda a, b: a & b, True)),
    "core.logic.or": (0, N, _logic(lambda a, b: a | b, False)),
    **{f"core.rel.{op}": (2, 2, _relation(op)) for op in ("eq", "neq", "lt", "lte", "gr", "gre")},
    "core.rel.in-range": (3, 3, lambda xs: Typed("bool", js.compare("gre", xs[0].col, xs[1].col, True) & js.compare("lte", xs[0].col, xs[2].col, True))),
    "core.math.add": (0, N, _fold(lambda a, b: a + b, 0)),
    "core.math.sub": (0, N, _sub),
    "core.math.mult": (0, N, _fold(lambda a, b: a * b, 1)),
    "core.math.min": (0, N, lambda xs: Typed("num", js.least(*(x.col for x in xs)))),
    "core.math.max": (0, N, lambda xs: Typed("num", js.greatest(*(x.col for x in xs)))),
    "core.math.div": (2, 2, lambda xs: Typed("num", js.div(xs[0].col, xs[1].col))),
    "core.math.pow": (2, 2, lambda xs: Typed("num", F.pow(js.num(xs[0].col), js.num(xs[1].col)))),
    "core.math.mod": (2, 2, lambda xs: Typed("num", js.mod(xs[0].col, xs[1].col))),
    "core.math.atan2": (2, 2, lambda xs: Typed("num", F.atan2(js.num(xs[0].col), js.num(xs[1].col)))),
    **{
        f"core.math.{n}": (1, 1, (lambda g: lambda xs: Typed("num", g(js.num(xs[0].col))))(f))
        for n, f in {
            "floor": js.whole(F.floor), "ceil": js.whole(F.ceil), "round-int": js.round_half_up, "trunc": js.trunc, "abs": F.abs, "sign": js.sign,
            "sqrt": F.sqrt, "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
            "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "log": js.log, "log10": lambda x: js.log(x, F.log10),
        }.items()
    },
    "core.str.concat": (0, N, lambda xs: Typed("str", F.concat(F.lit(""), *(_string(x) for x in xs)))),
    "core.str.match": (2, 2, lambda xs: Typed("bool", F.coalesce(_string(xs[1]).rlike(_pattern(xs[0])), F.lit(False)))),
    "core.list.get-at": (2, 2, lambda xs: Typed("str", F.get(xs[0].col, xs[1].col.cast("int")))),
    "core.list.equal": (2, 2, lambda xs: Typed("bool", F.coalesce(xs[0].col == xs[1].col, F.lit(False)))),
    "core.set.has": (2, 2, lambda xs: Typed("bool", F.coalesce(F.array_contains(xs[0].col, xs[1].col), F.lit(False)))),
    "core.set.is-subset": (2, 2, lambda xs: Typed("bool", F.size(F.array_except(xs[0].col, xs[1].col)) == 0)),
    "core.flags.has-any": (2, 2, _flags(False)),
    "core.flags.has-all": (2, 2, _flags(True)),
    "structure-query.type.element-symbol": (1, 1, lambda xs: Typed("str", F.upper(_string(xs[0])))),
    "structure-query.type.atom-name": (1, 1, lambda xs: Typed("str", F.upper(_string(xs[0])))),
    "structure-query.type.bond-flags": (0, N, _bits(S.BOND_FLAGS, False)),
    "structure-query.type.secondary-structure-flags": (0, N, _bits(S.SS_NAMES, True)),
}


def _c(name: str, kind: str, cast: str | None = None) -> Typed:
    col = F.col(name)
    return Typed(kind, js.num(col) if kind == "num" else col.cast(cast) if cast else col)


def _key(*names: str) -> Typed:
    return Typed("str", F.concat_ws(" ", *(F.col(n).cast("string") for n in names)))


P = "structure-query.atom-property."
ATOM_PROPERTIES: dict[str, Any] = {
    P + "core.element-symbol": lambda: Typed("str", S.element_symbol(F.col("element"))),
    P + "core.atomic-number": lambda: _c("element", "num"),
    P + "core.x": lambda: _c("x", "num"),
    P + "core.y": lambda: _c("y", "num"),
    P + "core.z": lambda: _c("z", "num"),
    P + "core.vdw": lambda: Typed("num", S.by_number(F.col("element"), S.QUERY_RADII)),
    P + "core.mass": lambda: Typed("num", S.by_number(F.col("element"), S.MASSES)),
    P + "core.atom-key": lambda: _c("atom", "num"),
    P + "macromolecular.residue-key": lambda: _key("residue"),
    P + "macromolecular.chain-key": lambda: _key("chain"),
    P + "macromolecular.entity-key": lambda: _c("entityKey", "num"),
    P + "macromolecular.id": lambda: _c("id", "str"),
    P + "macromolecular.label_atom_id": lambda: _c("name", "str"),
    P + "macromolecular.auth_atom_id": lambda: _c("name", "str"),
    P + "macromolecular.label_alt_id": lambda: _c("altloc", "str"),
    P + "macromolecular.label_comp_id": lambda: Typed("str", F.coalesce("comp", "residueComp")),
    P + "macromolecular.auth_comp_id": lambda: Typed("str", F.coalesce("comp", "residueComp")),
    P + "macromolecular.label_seq_id": lambda: Typed("num", F.greatest(F.lit(0), F.col("labelSeq")).cast("double")),
    P + "macromolecular.auth_seq_id": lambda: Typed("num", F.coalesce(S.leading_int(F.col("authSeq")), F.lit(0)).cast("double")),
    P + "macromolecular.pdbx_PDB_ins_code": lambda: _c("insertionCode", "str"),
    P + "macromolecular.label_asym_id": lambda: _c("labelId", "str"),
    P + "macromolecular.auth_asym_id": lambda: _c("authId", "str"),
    P + "macromolecular.is-het": lambda: _c("het", "bool"),
    P + "macromolecular.pdbx_formal_charge": lambda: _c("formalCharge", "num"),
    P + "macromolecular.label_entity_id": lambda: _c("entityId", "str"),
    P + "macromolecular.entity-type": lambda: _c("entityType", "str"),
    P + "macromolecular.entity-subtype": lambda: _c("entitySubtype", "str"),
    P + "macromolecular.occupancy": lambda: _c("occupancy", "num"),
    P + "macromolecular.B_iso_or_equiv": lambda: _c("bfactor", "num"),
    P + "macromolecular.secondary-structure-flags": lambda: Typed("num", F.coalesce(F.get(F.array(*(F.lit(float(v)) for v in S.SS_CODE_FLAGS)), F.col("ssCode").cast("int")), F.lit(0.0))),
}
B = "structure-query.bond-property."
BOND_PROPERTIES: dict[str, Any] = {
    B + "order": lambda: _c("order", "num"),
    B + "flags": lambda: Typed("num", F.coalesce(F.col("flags"), F.lit(1)).cast("double")),
    B + "length": lambda: Typed("num", F.col("length")),
}
A = "structure-query.atom-set."
G, M_, C_, FI = (f"structure-query.{x}." for x in ("generator", "modifier", "combinator", "filter"))
SET_SYMBOLS = {
    G + "all": set(), G + "empty": set(), G + "atom-groups": {"entity-test", "chain-test", "residue-test", "atom-test", "group-by"},
    G + "query-in-selection": {"in-complement"}, C_ + "merge": set(), M_ + "intersect-by": {"by"}, M_ + "except-by": {"by"}, M_ + "union": set(),
    M_ + "whole-residues": set(), M_ + "expand-property": {"property"}, M_ + "include-surroundings": {"radius", "atom-radius", "as-whole-residues"},
    M_ + "surrounding-ligands": {"radius", "include-water"}, M_ + "include-connected": {"bond-test", "layer-count", "fixed-point", "as-whole-residues"},
    FI + "pick": {"test"}, FI + "first": set(), FI + "within": {"target", "min-radius", "max-radius", "atom-radius", "invert"}, FI + "intersected-by": {"by"},
    FI + "with-same-atom-properties": {"source", "property"}, FI + "is-connected-to": {"target", "bond-test", "disjunct", "invert"},
}


def supported_symbols() -> list[str]:
    return sorted({*PURE, *ATOM_PROPERTIES, *BOND_PROPERTIES, A + "atom-count", A + "property-set", *SET_SYMBOLS})


def scalar(tree: Any, bond: bool = False) -> Typed:
    """Compile a scalar tree over the columns of atoms_wide (or of the bonds)."""
    if not isinstance(tree, (list, tuple, dict)):
        return literal(tree)
    name, args, named = split(tree)
    if name in PURE:
        least, most, make = PURE[name]
        if named or not least <= len(args) <= most:
            raise ExpressionError(f"{name}: wrong arguments")
        return make([scalar(a, bond) for a in args])
    table = BOND_PROPERTIES if bond else ATOM_PROPERTIES
    if name in table:
        if args or named:
            raise ExpressionError(f"{name} takes no argument")
        return table[name]()
    raise ExpressionError(f"unknown symbol {name}")


def predicate(tree: Any, bond: bool = False) -> Column:
    t = scalar(tree, bond)
    return js.truth(t.col, t.kind)


class Evaluator:
    """Set expressions over the atoms of one structure (an input relation of atoms_wide)."""

    def __init__(self, s: Structure, universe: DataFrame | None = None):
        self.s = s
        base = s.wide() if universe is None else universe
        if "entityId" in base.columns and "entityKey" not in base.columns:
            first = s.chains.groupBy("entityId").agg(F.min("chain").alias("__c"))
            keys = first.withColumn("entityKey", F.row_number().over(Window.orderBy("__c")) - 1).drop("__c")
            base = base.join(F.broadcast(keys), "entityId", "left")
        self.input = base

    def __call__(self, tree: Any) -> Sets:
        name, args, named = split(tree)
        if name not in SET_SYMBOLS:
            raise ExpressionError(f"unknown symbol {name}")
        if extra := named.keys() - SET_SYMBOLS[name]:
            raise ExpressionError(f"{name}: unknown arguments {sorted(extra)}")
        return getattr(self, "_" + name.split(".")[-1].replace("-", "_"))(args, named)

    def _number(self, tree: Any, default: float) -> float:
        return default if tree is None else float(literal(tree).value)

    def _narrowed(self, atoms: DataFrame) -> Evaluator:
        return Evaluator(self.s, self.input.join(atoms.select("atom").distinct(), "atom", "left_semi"))

    def _all(self, args, named) -> Sets:
        return Sets(self.input.select(F.col("atom").alias("set_id"), "atom"), True)

    def _empty(self, args, named) -> Sets:
        return Sets(self.input.select(F.col("atom").alias("set_id"), "atom").limit(0), True)

    def _atom_groups(self, args, named) -> Sets:
        """Entity, chain and residue tests see the first atom of every consecutive run."""
        rows = self.input
        for level, key in (("entity-test", "entityKey"), ("chain-test", "chain"), ("residue-test", "residue")):
            if level not in named:
                continue
            # Runs are numbered within a chain, whose atoms are consecutive; a chain is one task's work.
            w = Window.partitionBy("chain").orderBy("atom")
            new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
            rows = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
            first = rows.filter("__new = 1").filter(predicate(named[level])).select(F.col("chain").alias("__ch"), F.col("__run").alias("__r"))
            rows = rows.join(first, (F.col("chain") == F.col("__ch")) & (F.col("__run") == F.col("__r")), "left_semi").drop("__new", "__run")
        if "atom-test" in named:
            rows = rows.filter(predicate(named["atom-test"]))
        if "group-by" not in named:
            return Sets(rows.select(F.col("atom").alias("set_id"), "atom"), True)
        rows = rows.select("atom", scalar(named["group-by"]).col.alias("__g"))
        first = rows.groupBy("__g").agg(F.min("atom").alias("set_id"))
        return Sets(rows.join(first, rows["__g"].eqNullSafe(first["__g"])).select("set_id", "atom"), False)

    def _query_in_selection(self, args, named) -> Sets:
        outer = self(args[0]).flat()
        if named.get("in-complement"):
            outer = self.input.select("atom").join(outer, "atom", "left_anti")
        return self._narrowed(outer)(args[1])

    def _merge(self, args, named) -> Sets:
        parts = [self(a) for a in args]
        if not parts:
            return self._empty([], {})
        if all(p.singletons for p in parts):
            rows = parts[0].rows
            for p in parts[1:]:
                rows = rows.union(p.rows)
            return Sets(rows.distinct(), True)
        rows = None
        for k, p in enumerate(parts):
            named_ = p.rows.select(F.struct(F.lit(k).alias("k"), F.col("set_id").alias("s")).alias("set_id"), "atom")
            rows = named_ if rows is None else rows.union(named_)
        return Sets(unique_sets(rows), False)

    def _by(self, args, named, how: str) -> Sets:
        sets, by = self(args[0]), self(named["by"]).flat()
        return Sets(sets.rows.join(by, "atom", how).select("set_id", "atom"), sets.singletons)

    def _intersect_by(self, args, named) -> Sets:
        return self._by(args, named, "left_semi")

    def _except_by(self, args, named) -> Sets:
        return self._by(args, named, "left_anti")

    def _union(self, args, named) -> Sets:
        return Sets(self(args[0]).flat().select(F.lit(0).cast("long").alias("set_id"), "atom"), False)

    def _per_set(self, sets: Sets) -> DataFrame:
        """Singletons are one structure for operators that work set by set."""
        return sets.rows.select(F.lit(0).cast("long").alias("set_id"), "atom") if sets.singletons else sets.rows

    def _again(self, sets: Sets, rows: DataFrame) -> Sets:
        if sets.singletons:
            return Sets(rows.select(F.col("atom").alias("set_id"), "atom").distinct(), True)
        return Sets(rows.select("set_id", "atom").distinct(), False)

    def _whole(self, rows: DataFrame) -> DataFrame:
        touched = rows.join(self.input.select("atom", "residue"), "atom").select("set_id", "residue").distinct()
        return touched.join(self.input.select("atom", "residue"), "residue").select("set_id", "atom")

    def _whole_residues(self, args, named) -> Sets:
        sets = self(args[0])
        return self._again(sets, self._whole(self._per_set(sets)))

    def _expand_property(self, args, named) -> Sets:
        sets = self(args[0])
        values = self.input.select("atom", scalar(named["property"]).col.alias("__v"))
        have = self._per_set(sets).join(values, "atom").select("set_id", "__v").distinct()
        return self._again(sets, have.join(values, "__v").select("set_id", "atom"))

    def _radii(self, tree: Any) -> Column:
        return F.lit(0.0) if tree is None else js.num(scalar(tree).col)

    def _include_surroundings(self, args, named) -> Sets:
        sets, radius = self(args[0]), self._number(named.get("radius"), 0)
        extra = self._radii(named.get("atom-radius"))
        points = self.input.select("atom", "x", "y", "z", extra.alias("rad"))
        own = self._per_set(sets).join(points, "atom")
        reach = radius
        if "atom-radius" in named:
            reach += 2 * (points.agg(F.max("rad")).first()[0] or 0)
        gap = F.sqrt(spatial.squared_distance("l", "r")) - F.col("l.rad") - F.col("r.rad") <= radius if "atom-radius" in named else None
        near = spatial.near_pairs(points, own, reach, gap).select(F.col("r_set_id").alias("set_id"), F.col("l_atom").alias("atom"))
        rows = near.union(self._per_set(sets)).distinct()
        return self._again(sets, self._whole(rows) if named.get("as-whole-residues") else rows)

    def _surrounding_ligands(self, args, named) -> Sets:
        """The query, and ligands that a near residue leads to by listed covalent or metallic connections.

        Near are the whole residues within the radius; a ligand is a residue of a chain whose entity
        is neither polymer nor water.  On request also the water atoms near all of these.
        """
        if "entityType" not in self.input.columns:
            raise ExpressionError("surrounding-ligands needs chains.entityType")
        radius = self._number(named.get("radius"), 5)
        inner = graph.cut(self(args[0]).flat().distinct())
        kind = F.coalesce(F.col("entityType"), F.lit(""))
        code = F.when(kind == "water", 1).when(kind == "polymer", 2).otherwise(0)
        base = graph.cut(self.input.select("atom", "residue", code.alias("__kind"), "x", "y", "z"))
        seeds = graph.cut(base.join(inner, "atom", "left_semi").select("atom", "x", "y", "z"))
        start = spatial.near_rows(base.filter("__kind = 0"), seeds, radius).select(F.col("residue").alias("node")).distinct()
        reached = start
        if self.s.links is not None:
            links = self.s.links.filter("source = 'struct_conn' AND flags IN (1, 2)").select("a", "b").distinct()
            ends = links.select("a", "b", F.posexplode(F.array("a", "b")).alias("end", "atom")).join(self.s.atoms.select("atom", "residue"), "atom")
            residue = [F.max(F.when(F.col("end") == k, F.col("residue"))).alias(n) for k, n in enumerate(("ra", "rb"))]
            steps = graph.cut(ends.groupBy("a", "b").agg(*residue).filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
            reached = graph.cut(graph.reach(graph.cut(start), steps))
        grown = base.filter("__kind <> 1").join(reached.select(F.col("node").alias("residue")), "residue", "left_semi").select("atom", "x", "y", "z")
        rows = inner.union(grown.select("atom"))
        if named.get("include-water"):
            rows = rows.union(spatial.near_rows(base.filter("__kind = 1"), grown.union(seeds), radius).select("atom"))
        rows = rows.distinct()
        return Sets(rows.select(F.lit(0).cast("long").alias("set_id"), "atom"), False)

    def _edges(self, test: Any) -> DataFrame:
        """Both directions of the bonds inside the input that pass a test (default: covalent)."""
        bonds = graph.with_lengths(graph.bond_graph(self.s), self.input)
        bonds = bonds.filter(predicate(test, True)) if test is not None else bonds.filter(F.expr("(flags & 1) <> 0"))
        both = bonds.select("a", "b").union(bonds.select(F.col("b").alias("a"), F.col("a").alias("b")))
        inside = self.input.select(F.col("atom").alias("b"))
        return both.join(inside, "b", "left_semi").select("a", "b")

    def _include_connected(self, args, named) -> Sets:
        sets, edges = self(args[0]), self._edges(named.get("bond-test"))
        rows = self._per_set(sets).distinct()
        if named.get("fixed-point"):
            parts = graph.components(edges, self.input.select(F.col("atom").alias("node")))
            have = rows.join(parts.withColumnRenamed("node", "atom"), "atom").select("set_id", "component").distinct()
            rows = have.join(parts.withColumnRenamed("node", "atom"), "component").select("set_id", "atom")
        else:
            for _ in range(max(1, int(self._number(named.get("layer-count"), 1) or 1))):
                step = rows.join(edges.withColumnRenamed("a", "atom"), "atom").select("set_id", F.col("b").alias("atom"))
                rows = rows.union(step).distinct()
        return self._again(sets, self._whole(rows) if named.get("as-whole-residues") else rows)

    def _kept(self, sets: Sets, ids: DataFrame, how: str = "left_semi") -> Sets:
        return Sets(sets.rows.join(ids.select("set_id").distinct(), "set_id", how).select("set_id", "atom"), sets.singletons)

    def _pick(self, args, named) -> Sets:
        sets = self(args[0])
        aggs = [F.count("*").alias("__n")]
        test = self._set_scalar(named["test"], aggs)
        stats = sets.rows.join(self.input, "atom").groupBy("set_id").agg(*aggs)
        return self._kept(sets, stats.filter(js.truth(test.col, test.kind)))

    def _set_scalar(self, tree: Any, aggs: list) -> Typed:
        """A scalar over the current set: atom-count and property-set become aggregates."""
        if not isinstance(tree, (list, tuple, dict)):
            return literal(tree)
        name, args, named = split(tree)
        if name == A + "atom-count":
            return Typed("num", F.col("__n").cast("double"))
        if name == A + "property-set":
            alias = f"__p{len(aggs)}"
            aggs.append(F.collect_set(scalar(args[0] if args else named["property"]).col).alias(alias))
            return Typed("list", F.col(alias))
        if name not in PURE:
            raise ExpressionError(f"unknown symbol {name}")
        return PURE[name][2]([self._set_scalar(a, aggs) for a in args])

    def _first(self, args, named) -> Sets:
        sets = self(args[0])
        order = sets.rows.groupBy("set_id").agg(F.min("atom").alias("m"))
        return self._kept(sets, order.agg(F.min_by("set_id", "m").alias("set_id")).filter("set_id is not null"))

    def _within(self, args, named) -> Sets:
        """Without min-radius: within max plus the atom's own radius; no target fails.

        With min-radius 0: a gap (distance less both radii) of at most max; no target passes.
        Above 0: some gap below max and none below min; no target passes.
        """
        sets, target = self(args[0]), self(named["target"]).flat()
        most, low = self._number(named.get("max-radius"), 0), named.get("min-radius")
        invert = bool(named.get("invert"))
        mode_a = low is None
        rad = S.by_number(F.col("element"), S.QUERY_RADII) if mode_a else self._radii(named.get("atom-radius"))
        # No comparison with NaN holds: an atom whose radius is unknown is in no pair.
        points = self.input.select("atom", "x", "y", "z", F.coalesce(rad, F.lit(0.0)).alias("rad")).filter(~F.isnan("rad"))
        own = sets.rows.join(points, "atom")
        there = points.join(target, "atom", "left_semi") if not mode_a else self.input.select("atom", "x", "y", "z", F.lit(0.0).alias("rad")).join(target, "atom", "left_semi")
        widest = points.agg(F.max("rad")).first()[0] or 0.0
        distance = F.sqrt(spatial.squared_distance("l", "r"))
        if mode_a:
            near = spatial.near_pairs(own, there, most + widest, distance <= F.lit(most) + F.col("l.rad"))
            return self._kept(sets, near.select(F.col("l_set_id").alias("set_id")), "left_anti" if invert else "left_semi")
        least = self._number(low, 0)
        if target.isEmpty():
            return self._kept(sets, sets.rows, "left_anti" if invert else "left_semi")
        pairs = spatial.near_pairs(own, there, most + 2 * widest)
        d = F.greatest(F.lit(0.0), F.sqrt("d2") - F.col("l_rad") - F.col("r_rad"))
        if least <= 0:
            good = pairs.filter(d <= most).select(F.col("l_set_id").alias("set_id"))
        else:
            tested = pairs.groupBy(F.col("l_set_id").alias("set_id")).agg(F.max((d < least).cast("int")).alias("close"), F.max((d < most).cast("int")).alias("near"))
            good = tested.filter("close = 0 AND near = 1").select("set_id")
        return self._kept(sets, good, "left_anti" if invert else "left_semi")

    def _intersected_by(self, args, named) -> Sets:
        sets, by = self(args[0]), self(named["by"]).flat()
        return self._kept(sets, sets.rows.join(by, "atom", "left_semi"))

    def _with_same_atom_properties(self, args, named) -> Sets:
        sets, source = self(args[0]), self(named["source"]).flat()
        values = self.input.select("atom", scalar(named["property"]).col.alias("__v"))
        known = values.join(source, "atom", "left_semi").select("__v").distinct().withColumn("__ok", F.lit(1))
        tested = sets.rows.join(values, "atom").join(known, "__v", "left").groupBy("set_id").agg(F.min(F.coalesce("__ok", F.lit(0))).alias("ok"))
        return self._kept(sets, tested.filter("ok = 1"))

    def _is_connected_to(self, args, named) -> Sets:
        if named.get("invert"):
            raise ExpressionError("filter.is-connected-to: invert is not supported")
        sets, target = self(args[0]), self(named["target"]).flat()
        edges = self._edges(named.get("bond-test")).join(target.select(F.col("atom").alias("b")), "b", "left_semi")
        hit = sets.rows.join(edges.withColumnRenamed("a", "atom"), "atom").select("set_id", F.col("b").alias("atom"))
        if named.get("disjunct"):
            hit = hit.join(sets.rows, ["set_id", "atom"], "left_anti")
        return self._kept(sets, hit)


def unique_sets(rows: DataFrame) -> DataFrame:
    """(set_id, atom) with each distinct set once, under a number of its own.

    Sets are told apart by their size and two digests of their atoms; sets with equal ones are
    compared atom by atom, so no set needs to fit a row.
    """
    rows = graph.cut(rows.distinct())
    sums = rows.groupBy("set_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("atom")).alias("x"), F.sum(F.xxhash64("atom", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    lead = sums.groupBy("n", "x", "s").agg(F.min("set_id").alias("lead"))
    of = graph.cut(sums.join(lead, ["n", "x", "s"]).select("set_id", "lead", "n"))
    copies = of.filter(F.col("set_id") != F.col("lead"))
    there = rows.select(F.col("set_id").alias("lead"), "atom")
    shared = rows.join(copies, "set_id").join(there, ["lead", "atom"]).groupBy("set_id", "n").agg(F.count("*").alias("m")).filter("m = n")
    kept = graph.cut(of.join(shared, "set_id", "left_anti").select("set_id")).withColumn("number", F.monotonically_increasing_id())
    return rows.join(kept, "set_id").select(F.col("number").alias("set_id"), "atom")


def evaluate(s: Structure, tree: Any, universe: DataFrame | None = None) -> Sets:
    return Evaluator(s, universe)(tree)
