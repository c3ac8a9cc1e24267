"""Derivations along chains: dihedrals, traces, tangents, gaps, secondary structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..structure import Structure
from . import vectors as V

GUIDES = {"protein": ("CA",), "rna": ("P", "C4'"), "dna": ("P", "C4'")}


def backbone(s: Structure, names: tuple[str, ...] = ("N", "CA", "C")) -> DataFrame:
    """One row per residue with the coordinates of the first atom of each name."""
    at = s.atoms.filter(F.col("name").isin(*names))
    aggs = []
    for n in names:
        for c in "xyz":
            aggs.append(F.min_by(F.when(F.col("name") == n, F.col(c).cast("double")), F.when(F.col("name") == n, F.col("atom"))).alias(f"{n}_{c}"))
    sites = at.groupBy("residue").agg(*aggs)
    return s.residues.filter("polymer = 'protein'").join(sites, "residue", "left")


def dihedrals(s: Structure) -> DataFrame:
    """(residue, phi, psi, omega) of every residue; null where an atom or neighbour is missing."""
    rows = backbone(s)
    w = Window.partitionBy("chain").orderBy("labelSeq", "residue")
    cols = [f"{n}_{c}" for n in ("N", "CA", "C") for c in "xyz"]
    for c in cols:
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    at = lambda p, n: tuple(F.col(f"{p}{n}_{c}") for c in "xyz")
    near = lambda a, b: V.length(V.sub(a, b)) <= S.PEPTIDE_BREAK
    before, after = near(at("prev_", "C"), at("", "N")), near(at("", "C"), at("next_", "N"))
    phi = F.when(before, V.dihedral(at("prev_", "C"), at("", "N"), at("", "CA"), at("", "C")))
    psi = F.when(after, V.dihedral(at("", "N"), at("", "CA"), at("", "C"), at("next_", "N")))
    omega = F.when(before, V.dihedral(at("prev_", "CA"), at("prev_", "C"), at("", "N"), at("", "CA")))
    found = rows.select("residue", phi.alias("phi"), psi.alias("psi"), omega.alias("omega"))
    return s.residues.select("residue").join(found, "residue", "left")


def ramachandran(s: Structure) -> DataFrame:
    return dihedrals(s).filter("phi IS NOT NULL AND psi IS NOT NULL AND NOT isnan(phi) AND NOT isnan(psi)")


def guide_atoms(s: Structure) -> DataFrame:
    """(residue, chain, labelSeq, polymer, atom, x, y, z): the guide atom of each polymer residue."""
    rows = s.atoms.join(s.residues.select("residue", "chain", "labelSeq", "polymer"), "residue")
    rank = F.lit(None).cast("int")
    for kind, names in GUIDES.items():
        for k, n in enumerate(names):
            rank = F.when((F.col("polymer") == kind) & (F.col("name") == n), k).otherwise(rank)
    rows = rows.withColumn("rank", rank).filter("rank IS NOT NULL")
    best = rows.groupBy("residue", "chain", "labelSeq", "polymer").agg(F.min_by(F.struct("atom", "x", "y", "z"), F.struct("rank", "atom")).alias("g"))
    return best.select("residue", "chain", "labelSeq", "polymer", "g.*")


def trace(s: Structure) -> DataFrame:
    """Guide atoms with run (within the chain), k along the run and tangent tx, ty, tz."""
    w = Window.partitionBy("chain").orderBy("labelSeq", "residue")
    rows = guide_atoms(s)
    new = (F.lag("labelSeq").over(w) + 1 == F.col("labelSeq")) & (F.lag("polymer").over(w) == F.col("polymer"))
    rows = rows.withColumn("__new", F.when(new, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w)).drop("__new")
    r = Window.partitionBy("chain", "run").orderBy("labelSeq", "residue")
    rows = rows.withColumn("k", F.row_number().over(r) - 1)
    d = {c: F.coalesce(F.lead(c).over(r), F.col(c)).cast("double") - F.coalesce(F.lag(c).over(r), F.col(c)).cast("double") for c in "xyz"}
    rows = rows.withColumns({f"d{c}": d[c] for c in "xyz"})
    t = V.normalize(V.vec("d"))
    return rows.withColumns({f"t{c}": v for c, v in zip("xyz", t)}).drop("dx", "dy", "dz")


def central_difference(df: DataFrame, value: str, partition: list[str], order: str, name: str = "diff") -> DataFrame:
    """Half the difference of the neighbours; one-sided at the ends."""
    w = Window.partitionBy(*partition).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    both = (after - before) / 2
    return df.withColumn(name, F.coalesce(both, after - F.col(value), F.col(value) - before, F.lit(0.0)))


def sequence_gaps(s: Structure, most: float = 2.0) -> DataFrame:
    """(chain, residue, next_residue, distance): consecutive residues not linked C to N."""
    rows = backbone(s)
    w = Window.partitionBy("chain").orderBy("residue")
    for c in "xyz":
        rows = rows.withColumn(f"next_{c}", F.lead(f"N_{c}").over(w))
    rows = rows.withColumn("next_residue", F.lead("residue").over(w)).filter("next_residue IS NOT NULL")
    d = V.length(V.sub(tuple(F.col(f"C_{c}") for c in "xyz"), V.vec("next_")))
    return rows.withColumn("distance", d).filter(F.col("distance").isNull() | (F.col("distance") > most)).select("chain", "residue", "next_residue", "distance")


def chain_ends(s: Structure) -> DataFrame:
    return s.residues.filter("polymer <> 'other'").groupBy("chain").agg(F.min("residue").alias("first"), F.max("residue").alias("last"))


# The atoms that a residue's direction goes from and to.
DIRECTIONS = {"protein": (("C",), ("O", "OC1", "O1", "OX1", "OXT", "OT1")), "rna": (("C4'", "C4*"), ("C3'", "C3*")), "dna": (("C3'", "C3*"), ("C1'", "C1*"))}


def structure_trace(s: Structure) -> DataFrame:
    """The trace with ss (kind), first and last (of a block of one kind in a run) and directions dx, dy, dz.

    Residues without both atoms, or with both in one place, have the direction (0, 0, 1).
    """
    rows = trace(s)
    kind = S.ss_kind(F.col("ssCode")) if "ssCode" in s.residues.columns else F.lit("coil")
    rows = rows.join(s.residues.select("residue", kind.alias("ss")), "residue")
    w = Window.partitionBy("chain", "run").orderBy("k")
    rows = rows.withColumn("first", ~F.lag("ss").over(w).eqNullSafe(F.col("ss"))).withColumn("last", ~F.lead("ss").over(w).eqNullSafe(F.col("ss")))
    at = s.atoms.join(s.residues.select("residue", "polymer"), "residue")
    role = lambda n: _any(F.col("polymer"), n)
    ends = at.groupBy("residue").agg(*(F.min_by(F.when(role(n), F.col(c).cast("double")), F.when(role(n), F.col("atom"))).alias(f"{e}{c}") for n, e in ((0, "f"), (1, "t")) for c in "xyz"))
    rows = rows.join(ends.withColumnsRenamed({f"t{c}": f"to{c}" for c in "xyz"}), "residue", "left")
    d = V.sub(V.vec("to"), V.vec("f"))
    size, n = V.length(d), V.normalize(d)
    rows = rows.withColumns({f"d{c}": F.when(size > 1e-6, v).otherwise(F.lit(float(c == "z"))) for c, v in zip("xyz", n)})
    return rows.drop(*(f"{e}{c}" for e in ("f", "to") for c in "xyz"))


def _any(polymer, which: int):
    out = F.lit(False)
    for kind, names in DIRECTIONS.items():
        out = out | ((polymer == kind) & F.col("name").isin(*names[which]))
    return out


def trace_frames(s: Structure) -> DataFrame:
    """The trace with normals nx, ny, nz carried along each run (parallel transport)."""
    rows = trace(s)

    def carry(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("k", ignore_index=True)
        t = run[["tx", "ty", "tz"]].to_numpy(float)
        axis = np.eye(3)[np.abs(t[0]).argmin()]
        normal, out = np.cross(t[0], np.cross(axis, t[0])), np.zeros_like(t)
        for i, ti in enumerate(t):
            normal = normal - ti * (normal @ ti)
            size = np.linalg.norm(normal)
            normal = normal / size if size > 1e-9 else np.cross(ti, np.eye(3)[np.abs(ti).argmin()])
            out[i] = normal
        return run.assign(nx=out[:, 0], ny=out[:, 1], nz=out[:, 2])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("chain", "run").applyInPandas(carry, f"{schema}, nx double, ny double, nz double")


HBOND_FACTOR, HBOND_LIMIT, HBOND_LEAST = -27.9, -0.5, -9.9


def _hbond(o, c, n, h) -> np.ndarray:
    d = lambda a, b: np.maximum(np.linalg.norm(a - b, axis=-1), 0.5)
    e = HBOND_FACTOR * (1 / d(h, o) - 1 / d(h, c) + 1 / d(n, c) - 1 / d(n, o))
    return np.maximum(e, HBOND_LEAST)


def dssp(s: Structure) -> DataFrame:
    """(residue, ssCode 0..7) of protein residues, by hydrogen-bond patterns within each chain.

    Kabsch-Sander energies between residues whose CA atoms lie within 9 A give turns, helices
    (G, H, I), bridges and strands (B, E), bends (S); the strongest kinds win.
    """
    rows = backbone(s, ("N", "CA", "C", "O", "OXT"))
    need = [f"{n}_{c}" for n in ("N", "CA", "C", "O", "OXT") for c in "xyz"]

    def assign(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["labelSeq", "residue"], ignore_index=True)
        xyz = {n: table[[f"{n}_{c}" for c in "xyz"]].to_numpy(float) for n in ("N", "CA", "C", "O")}
        m = len(table)
        code = np.zeros(m, int)
        terminal = table["OXT_x"].notna().to_numpy()  # a C-terminal residue accepts no bond
        whole = ~np.isnan(np.concatenate([xyz[n] for n in xyz], axis=1)).any(1)
        linked = np.zeros(m, bool)
        if m > 1:
            linked[1:] = whole[1:] & whole[:-1] & (np.linalg.norm(xyz["C"][:-1] - xyz["N"][1:], axis=1) <= S.PEPTIDE_BREAK)
        part = np.cumsum(~linked)
        hyd = xyz["N"].copy()
        if m > 1:
            co = xyz["C"][:-1] - xyz["O"][:-1]
            hyd[1:] = np.where(linked[1:, None], xyz["N"][1:] + co / np.maximum(np.linalg.norm(co, axis=1, keepdims=True), 1e-9), xyz["N"][1:])
        donor = linked & (table["comp"].to_numpy() != "PRO")
        bonds = set()
        cell = np.floor(np.nan_to_num(xyz["CA"]) / 9).astype(int)
        bins: dict = {}
        for i in np.flatnonzero(whole):
            bins.setdefault(tuple(cell[i]), []).append(i)
        for i in np.flatnonzero(whole & donor):
            near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in bins.get((cell[i][0] + dx, cell[i][1] + dy, cell[i][2] + dz), ())]
            near = np.array([j for j in near if abs(j - i) > 1 and not terminal[j]], int)
            near = near[np.linalg.norm(xyz["CA"][near] - xyz["CA"][i], axis=1) <= 9] if len(near) else near
            if len(near):
                e = _hbond(xyz["O"][near], xyz["C"][near], xyz["N"][i], hyd[i])
                for j in near[np.argsort(e, kind="stable")[:2]][np.sort(e)[:2] < HBOND_LIMIT]:
                    bonds.add((i, int(j)))
        has = lambda d, a: (d, a) in bonds
        same = lambda a, b: 0 <= a <= b < m and part[a] == part[b]
        turn = {n: np.array([same(i, i + n) and has(i + n, i) for i in range(m)]) for n in (3, 4, 5)}
        bend = np.zeros(m, bool)
        for i in range(2, m - 2):
            if same(i - 2, i + 2):
                a, b = xyz["CA"][i] - xyz["CA"][i - 2], xyz["CA"][i + 2] - xyz["CA"][i]
                bend[i] = np.degrees(np.arccos(np.clip(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12), -1, 1))) > 70
        bridge: dict[int, set] = {}
        for i in range(1, m - 1):
            if not same(i - 1, i + 1):
                continue
            for j in {a for d, a in bonds if d in (i, i + 1)} | {d for d, a in bonds if a in (i, i - 1)} | {a + 1 for d, a in bonds if d == i + 1} | {d - 1 for d, a in bonds if a == i - 1}:
                if abs(i - j) < 3 or not same(j - 1, j + 1):
                    continue
                parallel = (has(i + 1, j) and has(j, i - 1)) or (has(j + 1, i) and has(i, j - 1))
                anti = (has(i, j) and has(j, i)) or (has(i + 1, j - 1) and has(j + 1, i - 1))
                if parallel or anti:
                    bridge.setdefault(i, set()).add((j, parallel))
                    bridge.setdefault(j, set()).add((i, parallel))
        code[bend] = 7
        for n in (3, 4, 5):
            for i in np.flatnonzero(turn[n]):
                inner = slice(i + 1, i + n)
                code[inner] = np.where(np.isin(code[inner], (0, 7)), 6, code[inner])
        for n, value in ((5, 5), (3, 4), (4, 1)):
            for i in range(1, m):
                if turn[n][i] and turn[n][i - 1]:
                    spot = code[i : i + n]
                    if n == 4 or np.isin(spot, (0, 6, 7, value)).all():
                        code[i : i + n] = value
        for i, partners in bridge.items():
            strand = any((j + (step if par else -step), par) in bridge.get(i + step, ()) for j, par in partners for step in (-1, 1))
            if code[i] != 1:
                code[i] = 3 if strand else (code[i] if code[i] == 3 else 2)
        return pd.DataFrame({"residue": table["residue"], "ssCode": code.astype("int32")})

    return rows.select("residue", "chain", "labelSeq", "comp", *need).groupBy("chain").applyInPandas(assign, "residue long, ssCode int")


def with_secondary_structure(s: Structure, mode: str = "auto") -> Structure:
    """auto: keep a column that the model brought, compute otherwise; dssp: compute."""
    brought = "ssCode" in s.residues.columns
    if mode == "model" or (mode == "auto" and brought):
        return s
    return s.with_attributes({"ssCode": dssp(s)}, "residue", "dssp")
