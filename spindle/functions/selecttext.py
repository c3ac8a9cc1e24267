"""Selection text in the PyMOL and VMD manner, parsed to named selections.

Precedence: not, then and, then or; ``byres``, ``bound_to``, ``within`` and what follows an operand
(``around``, ``expand``, ``extend``, ``within``, ``near_to``, ``beyond``) bind like not.  Only the words below
are known; anything else is an error that names its position.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import graph
from ..operators import selection as Q

TOKEN = re.compile(r"\s*(?:(\()|(\))|'([^']*)'|\"([^\"]*)\"|(<=|>=|==|!=|<|>|=)|([^\s()<>=!]+))")
COMPARE = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "=": "eq", "==": "eq", "!=": "ne"}
NUMBERS = {"b": "bfactor", "beta": "bfactor", "q": "occupancy", "occupancy": "occupancy", "x": "x", "y": "y", "z": "z"}


class SelectionSyntaxError(ValueError):
    """Text that isn't a selection."""


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SelectionSyntaxError(f"column {at + 1}: {text[at:at + 12]!r}")
        out.append(next(g for g in m.groups() if g is not None))
        at = m.end()
    return out


def _word(name: str, *words: str) -> Q.Query:
    wild = [w for w in words if "*" in w]
    plain = [w for w in words if "*" not in w]
    def test(s):
        col = F.coalesce(F.col("comp"), F.col("residueComp")) if name == "comp" else F.col(name)
        out = col.isin(*plain) if plain else F.lit(False)
        for w in wild:
            out = out | col.like(w.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
        return out

    return Q.Query("atom", f"{name} {' '.join(words)}", test)


def _ranges(words: list[str]) -> Q.Query:
    parts = None
    for w in words:
        m = re.fullmatch(r"(-?\d+)(?:[-:](-?\d+))?", w)
        if not m:
            raise SelectionSyntaxError(f"bad residue range {w!r}")
        one = Q.residues(int(m[1]), int(m[2] or m[1]))
        parts = one if parts is None else parts | one
    return parts


def _by_residue(q: Q.Query) -> Q.Query:
    def rows(s, universe):
        touched = universe.select("atom", "residue").join(Q._atoms(q, s, universe), "atom", "left_semi").select("residue").distinct()
        return universe.join(touched, "residue", "left_semi").select("atom")

    return Q.Query("atom", f"byres {q.label}", rows=rows, view=q.view, reads=q.reads)


def _bonded(q: Q.Query, layers: int, keep: bool) -> Q.Query:
    """Atoms up to ``layers`` covalent bonds from ``q``, with its own atoms or, of one layer, without asking for them."""

    def rows(s, universe):
        bonds = graph.bond_graph(s).filter(F.expr("(flags & 1) <> 0")).select("a", "b")
        seeds = Q._atoms(q, s, universe).select(F.col("atom").alias("node"))
        if keep:
            found = graph.expand(seeds, bonds, layers)
        else:
            both = bonds.union(bonds.select("b", "a"))
            found = both.join(seeds.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        return universe.select("atom").join(found.select(F.col("node").alias("atom")), "atom", "left_semi")

    return Q.Query("atom", f"bonds of {q.label}", rows=rows, view=q.view, reads=q.reads | {"positions"})


def _elements(words: list[str]) -> Q.Query:
    numbers = {s: i + 1 for i, s in enumerate(S.ELEMENT_SYMBOLS)}
    found = [numbers.get(w.upper(), 0) for w in words]
    return Q.Query("atom", f"elem {' '.join(words)}", lambda s: F.col("element").isin(*found))


SIMPLE = {
    "all": lambda: Q.all_(), "none": lambda: Q.Query("atom", "none", lambda s: F.lit(False)), "protein": Q.protein, "nucleic": Q.nucleic,
    "water": Q.water, "waters": Q.water, "solvent": Q.water, "ligand": Q.ligand, "organic": Q.ligand,
    "polymer": lambda: Q.Query("atom", "polymer", lambda s: F.col("polymer") != "other"), "hetatm": lambda: Q.Query("atom", "hetatm", lambda s: F.col("het")),
    "helix": lambda: Q.secondary_structure("helix"), "sheet": lambda: Q.secondary_structure("sheet"), "coil": lambda: Q.secondary_structure("coil"),
    "backbone": lambda: Q.protein() & _word("name", "N", "CA", "C", "O"), "hydrogen": lambda: Q.element(1), "hydrogens": lambda: Q.element(1), "hydro": lambda: Q.element(1),
    "hetero": lambda: Q.Query("atom", "hetero", lambda s: F.col("het")),
}
LISTS = {
    "chain": lambda w: _word("authId", *w), "segi": lambda w: _word("labelId", *w), "name": lambda w: _word("name", *w), "resn": lambda w: _word("comp", *w),
    "resname": lambda w: _word("comp", *w), "alt": lambda w: _word("altloc", *w), "elem": _elements, "element": _elements, "resi": _ranges, "resid": _ranges,
    "index": lambda w: Q.Query("atom", "index", lambda s: F.col("atom").isin(*map(int, w))),
}
AFTER = ("around", "expand", "extend", "within", "near_to", "beyond")
STOP = {"and", "or", "not", "of", ")", "(", "&", "|", "!", "byres", "bound_to", *AFTER}


class _Parser:
    def __init__(self, text: str):
        self.words, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self, *want: str) -> str:
        w = self.peek()
        if w is None or (want and w.lower() not in want):
            raise SelectionSyntaxError(f"expected {' or '.join(want) or 'a word'}, got {w!r}")
        self.at += 1
        return w

    def any_of(self) -> Q.Query:
        out = self.all_of()
        while (self.peek() or "").lower() in ("or", "|"):
            self.take()
            out = out | self.all_of()
        return out

    def all_of(self) -> Q.Query:
        out = self.one()
        while (self.peek() or "").lower() in ("and", "&"):
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Q.Query:
        w = self.take()
        low = w.lower()
        if low in ("not", "!"):
            return ~self.one()
        if low in ("byres", "br."):
            return _by_residue(self.one())
        if low == "same":
            self.take("residue")
            self.take("as")
            return _by_residue(self.one())
        if low == "within":
            reach = float(self.take())
            self.take("of")
            return Q.within(reach, self.one())
        if low == "bound_to":
            return _bonded(self.one(), 1, False)
        out = self.basic(w, low)
        while (self.peek() or "").lower() in AFTER:
            out = self.after(out, self.take().lower(), self.take())
        return out

    def after(self, out: Q.Query, how: str, size: str) -> Q.Query:
        """What follows an operand: its surroundings, or a test against another operand."""
        if how == "extend":
            return _bonded(out, int(size), True)
        if how in ("around", "expand"):
            near = Q.within(float(size), out)
            return near & ~out if how == "around" else near | out
        self.take("of")
        other = self.one()
        near = Q.within(float(size), other)
        return out & (near if how == "within" else ~near if how == "beyond" else near & ~other)

    def basic(self, w: str, low: str) -> Q.Query:
        if w == "(":
            out = self.any_of()
            self.take(")")
            return out
        if low in SIMPLE:
            return SIMPLE[low]()
        if low in NUMBERS and self.peek() in COMPARE:
            op, value = COMPARE[self.take()], float(self.take())
            col = NUMBERS[low]
            test = {"lt": lambda c: c < value, "le": lambda c: c <= value, "gt": lambda c: c > value, "ge": lambda c: c >= value, "eq": lambda c: c == value, "ne": lambda c: c != value}[op]
            return Q.Query("atom", f"{low} {op} {value}", lambda s: test(F.col(col).cast("double")), reads=frozenset({"positions" if col in "xyz" else "topology"}))
        if low in LISTS:
            got = []
            while self.peek() is not None and self.peek().lower() not in STOP:
                for part in re.split(r"[+,]", self.take()):
                    if part.lower() == "to" and got:
                        got[-1] = f"{got[-1]}-{self.take()}"
                    elif part:
                        got.append(part)
            if not got:
                raise SelectionSyntaxError(f"{w}: expected values")
            return LISTS[low](got)
        raise SelectionSyntaxError(f"unknown word {w!r}")


def parse(text: str) -> Q.Query:
    p = _Parser(text)
    out = p.any_of()
    if p.peek() is not None:
        raise SelectionSyntaxError(f"unexpected {p.peek()!r}")
    return out
