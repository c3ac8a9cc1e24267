"""Charges of small molecules against known ones and against a plain version of the method."""

import itertools
import random

import pytest

from spindle.operators import gasteiger
from spindle.structure import create_structure

# Elements, bonds (a, b, order, aromatic), formal charges and known charges of molecules.
MOLECULES = {
    "ethanol": ([6, 6, 8], [(0, 1, 1, 0), (1, 2, 1, 0)], {}, [0.03428138, 0.15236002, -0.18664140]),
    "benzene": ([6] * 6, [(i, (i + 1) % 6, 4, 1) for i in range(6)], {}, [0.0] * 6),
    "pyrrole": ([6, 6, 6, 7, 6], [(0, 1, 1, 1), (1, 2, 2, 1), (2, 3, 1, 1), (3, 4, 1, 1), (4, 0, 2, 1)], {}, [0.019137, 0.019137, 0.082026, -0.202326, 0.082026]),
    "pyrrole of order 4": ([6, 6, 6, 7, 6], [(i, (i + 1) % 5, 4, 1) for i in range(5)], {}, [0.019137, 0.019137, 0.082026, -0.202326, 0.082026]),
    "thiophene": ([6, 6, 6, 16, 6], [(0, 1, 1, 1), (1, 2, 2, 1), (2, 3, 1, 1), (3, 4, 1, 1), (4, 0, 2, 1)], {}, [0.011626, 0.011626, 0.064602, -0.152454, 0.064602]),
    "furan": ([6, 6, 6, 8, 6], [(0, 1, 1, 1), (1, 2, 2, 1), (2, 3, 1, 1), (3, 4, 1, 1), (4, 0, 2, 1)], {}, [0.041799, 0.041799, 0.19452, -0.472638, 0.19452]),
    "methanesulfonamide": ([6, 16, 7, 8, 8], [(0, 1, 1, 0), (1, 2, 1, 0), (1, 3, 2, 0), (1, 4, 2, 0)], {}, [0.175946, 0.205681, 0.044283, -0.212955, -0.212955]),
    "methyl phosphate": ([6, 8, 15, 8, 8, 8], [(0, 1, 1, 0), (1, 2, 1, 0), (2, 3, 2, 0), (2, 4, 1, 0), (2, 5, 1, 0)], {}, [0.208389, -0.290497, 0.468805, -0.228345, -0.079176, -0.079176]),
    "enolate": ([6, 6, 8], [(0, 1, 1, 0), (1, 2, 2, 0)], {0: -1}, [-0.711459, 0.049707, -0.338248]),
    "acetate": ([6, 6, 8, 8], [(0, 1, 1, 0), (1, 2, 2, 0), (1, 3, 1, 0)], {3: -1}, [0.06267546, 0.0382786, -0.55047703, -0.55047703]),
}
REFUSED = {
    "order 0": ([6, 8], [(0, 1, 0, 0)], "unknown-bond-order"),
    "iron": ([26, 6], [(0, 1, 1, 0)], "missing-parameters"),
    "CO of order 3": ([6, 8], [(0, 1, 3, 0)], "unsupported-valence"),
    "imidazole": ([6, 6, 7, 6, 7], [(i, (i + 1) % 5, 4, 1) for i in range(5)], "unknown-bond-order"),
    "odd ring": ([6] * 5, [(i, (i + 1) % 5, 4, 1) for i in range(5)], "unknown-bond-order"),
    "apart": ([6, 6], [], "unknown-bond-order"),
}


def structure(spark, molecules, polymer=lambda name: "other", altlocs=None):
    """One residue a molecule; atoms are numbered on."""
    atoms, residues, links, formal = [], [], [], []
    for r, (name, (elements, bonds, *rest)) in enumerate(molecules.items()):
        base = len(atoms)
        for i, e in enumerate(elements):
            alt = (altlocs or {}).get(name, [""] * len(elements))[i]
            atoms.append((base + i, str(base + i), f"A{i}", alt, r, e, 1.0, 0.0, 1.5, None, float(base), float(i), 0.0))
            formal.append((base + i, (rest[0] if rest and isinstance(rest[0], dict) else {}).get(i, 0)))
        residues.append((r, 0, r, str(r), "", "LIG", polymer(name), True))
        links += [(len(links) + k, base + a, base + b, o, 1 | 16 * flag, "component") for k, (a, b, o, flag) in enumerate(bonds)]
    s = create_structure(spark, {"atoms": atoms, "residues": residues, "chains": [(0, 1, "A", "A", "", "", "")], "links": links}, check=False)
    return s.with_attributes({"formalCharge": spark.createDataFrame(formal, "atom long, value int")})


def nothing(spark):
    return spark.createDataFrame([], "atom long")


def test_known_charges(spark):
    s = structure(spark, MOLECULES)
    out = gasteiger.gasteiger_charges(s, nothing(spark))
    got = {r["atom"]: r["charge"] for r in out.charges.collect()}
    assert out.refused.isEmpty()
    at = itertools.count()
    for name, (_, _, _, want) in MOLECULES.items():
        for x in want:
            assert abs(got[next(at)] - x) < 1e-3, name


def test_refusals(spark):
    s = structure(spark, REFUSED | {"MSE": ([6, 8], [(0, 1, 1, 0)]), "fine": ([6, 8], [(0, 1, 1, 0)])}, lambda n: "protein" if n == "MSE" else "other")
    out = gasteiger.gasteiger_charges(s, nothing(spark))
    got = {}
    for r in out.refused.collect():
        got.setdefault(r["residue"], set()).add(r["reason"])
    assert got == {r: {v[-1]} for r, v in enumerate(REFUSED.values())} | {len(REFUSED): {"modified-polymer"}}
    assert out.charges.count() == 2
    for bad in (0, 101, 1.5, True):
        with pytest.raises(ValueError):
            gasteiger.gasteiger_charges(s, nothing(spark), bad)


def test_components_that_others_cover(spark):
    two = {"a": ([6, 8], [(0, 1, 1, 0)]), "b": ([6, 8], [(0, 1, 1, 0)]), "c": ([6], [(0, -1, 1, 0)])}
    s = structure(spark, two, lambda n: "protein" if n == "b" else "other")  # c's atom is bound to b's last
    out = gasteiger.gasteiger_charges(s, spark.createDataFrame([(0,)], "atom long"))
    assert {(r["residue"], r["reason"]) for r in out.refused.collect()} == {(0, "template-covered"), (1, "polymer-linked"), (2, "polymer-linked")}
    out = gasteiger.gasteiger_charges(s, spark.createDataFrame([(0,), (1,)], "atom long"))
    assert {r["residue"] for r in out.refused.collect()} == {1, 2}


def test_conformers_are_molecules(spark):
    s = structure(spark, {"x": ([6, 6, 8, 8], [(0, 1, 1, 0), (1, 2, 1, 0), (1, 3, 1, 0)])}, altlocs={"x": ["", "", "A", "B"]})
    got = {r["atom"]: r["charge"] for r in gasteiger.gasteiger_charges(s, nothing(spark)).charges.collect()}
    for i, want in enumerate([0.03428138, 0.15236002, -0.18664140, -0.18664140]):
        assert abs(got[i] - want) < 1e-4


def plain(elements, bonds, rounds=12):
    """Chains and rings without formal charges, by loops over atoms; None: a valence doesn't fit."""
    n = len(elements)
    near = [[] for _ in range(n)]
    for k, (a, b, o, ar) in enumerate(bonds):
        near[a].append((b, o, ar, k)), near[b].append((a, o, ar, k))
    total = [sum(o for _, o, _, _ in x) for x in near]
    hydrogens = []
    for p, z in enumerate(elements):
        if z == 1:
            hydrogens.append(0)
            continue
        fit = [v for v in gasteiger.VALENCES[z] if v >= total[p]]
        if not fit or fit[0] - total[p] > 4:
            return None
        hydrogens.append(fit[0] - total[p])
    degree = [len(x) + h for x, h in zip(near, hydrogens)]

    def fits(p):
        v = gasteiger.VALENCES[elements[p]][0]
        lone = max(gasteiger.OUTER[elements[p]] - v, 0)
        return elements[p] <= 10 and v > 1 and degree[p] <= 3 and total[p] + hydrogens[p] <= v and v - degree[p] + lone > 0

    conj = {k for k, b in enumerate(bonds) if b[3]}
    for p in range(n):
        if fits(p) and degree[p] >= 2:
            for (_, o, ar, k), (q, _, _, j) in itertools.permutations(near[p], 2):
                if (o >= 2 or ar) and fits(q):
                    conj |= {k, j}
    params = []
    for p, z in enumerate(elements):
        lone = max(0, (gasteiger.OUTER[z] - total[p] - hydrogens[p]) // 2)
        orbitals = degree[p] + lone
        sp2 = orbitals == 3 or orbitals == 4 and degree[p] <= 3 and any(k in conj for *_, k in near[p])
        mode = "*" if z == 1 else "sp" if orbitals == 2 else "sp2" if sp2 else "sp3"
        if (z, mode) not in gasteiger.PARAMETERS:
            return None
        params.append(gasteiger.PARAMETERS[z, mode])
    ion = [20.02 if z == 1 else sum(p) for z, p in zip(elements, params)]
    q, hq, damp = [0.0] * n, [0.0] * n, 0.5
    curve = lambda p, x: p[0] + x * (p[1] + p[2] * x)
    for _ in range(rounds):
        e = [curve(p, x) for p, x in zip(params, q)]
        for p in range(n):
            move = sum((e[j] - e[p]) / (ion[j] if e[j] < e[p] else ion[p]) for j, *_ in near[p])
            if hydrogens[p]:
                dx = curve(gasteiger.PARAMETERS[1, "*"], hq[p] / hydrogens[p]) - e[p]
                pull = hydrogens[p] * dx / (20.02 if dx < 0 else ion[p])
                move += pull
                hq[p] -= pull * damp
            q[p] += damp * move
        damp /= 2
    return [x + y for x, y in zip(q, hq)]


def test_random_molecules(spark):
    rng = random.Random(8)
    molecules = {}
    for k in range(60):
        n = rng.randint(2, 12)
        elements = [rng.choice([6, 6, 6, 7, 8, 16, 1, 9, 17, 15]) for _ in range(n)]
        bonds = [(rng.randrange(i), i, rng.choice([1, 1, 1, 2, 2, 3]), 0) for i in range(1, n)]
        molecules[k] = (elements, bonds)
    s = structure(spark, molecules)
    out = gasteiger.gasteiger_charges(s, nothing(spark))
    got = {r["atom"]: r["charge"] for r in out.charges.collect()}
    refused = {r["residue"] for r in out.refused.collect()}
    at = 0
    for k, (elements, bonds) in molecules.items():
        want = plain(elements, bonds)
        assert (want is None) == (k in refused)
        for i in range(len(elements)):
            assert (at + i in got) == (want is not None)
            if want:
                assert abs(got[at + i] - want[i]) < 1e-9
        at += len(elements)
    assert 10 < len(refused) < 60


@pytest.mark.parametrize("most", [0, 3, 1_000])
def test_molecules_together_and_apart(spark, monkeypatch, most):
    """A molecule's charges don't depend on whether it is held together or its rounds are joins; batches may end anywhere."""
    monkeypatch.setattr(gasteiger, "MOLECULE", most)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        nodes, bonds, want = [], [], {}
        for m in range(9):
            n = m % 5 + 1
            k = [(100 * m + i, float(7 + i + m / 10), 9.0, 1.5, 18.0 + i, i % 3, 0.1 * i) for i in range(n)]
            nodes += [(x, str(m), x + 1, 0, a, b, c, ion, h, q) for x, a, b, c, ion, h, q in k]
            pairs = [(100 * m + i, 100 * m + i + 1) for i in range(n - 1)]
            bonds += pairs + [(q, p) for p, q in pairs]
        q = {r[0]: r[9] for r in nodes}
        hq, of = dict.fromkeys(q, 0.0), {r[0]: r for r in nodes}
        for k in range(5):
            e = {x: r[4] + q[x] * (r[5] + r[6] * q[x]) for x, r in of.items()}
            pull = lambda x, v, ion: (v - e[x]) / (ion if v < e[x] else of[x][7])
            heavy = {x: sum(pull(x, e[b], of[b][7]) for a, b in bonds if a == x) for x in q}
            each = {x: hq[x] / of[x][8] if of[x][8] else 0.0 for x in q}
            light = {x: of[x][8] * pull(x, 7.17 + each[x] * (6.24 - 0.56 * each[x]), 20.02) for x in q}
            q = {x: q[x] + 0.5 ** (k + 1) * (heavy[x] + light[x]) for x in q}
            hq = {x: hq[x] - 0.5 ** (k + 1) * light[x] for x in q}
        want = {x + 1: q[x] + hq[x] for x in q}
        frame = spark.createDataFrame(nodes, "x long, m string, atom long, rank long, a double, b double, c double, ion double, h int, q double")
        got = gasteiger.equalised(frame, spark.createDataFrame(bonds, "p long, q long"), 5).collect()
        assert len(got) == len(want) and {r["atom"]: r["charge"] for r in got} == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
