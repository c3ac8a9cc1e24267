"""Charges of PQR records on the atoms of another structure."""

import pytest

from spindle.sources import pqr
from spindle.structure import create_structure


def line(k, name, comp, chain, seq, x, q):
    return f"ATOM {k:6d} {name:4s} {comp} {chain} {seq:4d}    {x:8.3f}   0.000   0.000 {q:7.4f}  1.5000"


def structure(spark, chains=(("A", "A"),)):
    names = [("N", "", 0.0), ("CA", "A", 1.4), ("CA", "B", 1.5), ("O", "", 2.6)]
    atoms, residues, rows = [], [], []
    for c, (label, auth) in enumerate(chains):
        rows.append((c, 1, label, auth, "", "", ""))
        for r in range(2):
            residues.append((2 * c + r, c, r + 1, str(r + 1), "", "GLY", "protein", False))
            for n, alt, x in names:
                atoms.append((len(atoms), str(len(atoms)), n, alt, 2 * c + r, 7 if n == "N" else 6, 0.5, 0.0, 1.5, None, x + 10 * r, 0.0, 0.0))
    return create_structure(spark, {"atoms": atoms, "residues": residues, "chains": rows}, check=False)


RECORDS = [line(1, "N", "GLY", "A", 1, 0.0, -0.5), line(2, "H", "GLY", "A", 1, -1.0, 0.25), line(3, "CA", "GLY", "A", 1, 1.45, 0.1), line(4, "HA", "GLY", "A", 1, 1.45 + 1.0, 0.05), line(5, "O", "GLY", "A", 1, 2.6, -0.4), line(6, "HX", "GLY", "A", 1, 9.0, 0.3), line(7, "CB", "GLY", "A", 7, 0.0, 0.2)]


def test_charges_and_report(spark):
    records = pqr.parse(spark.createDataFrame([("f", "\n".join(RECORDS))], "file string, value string"))
    out, report = pqr.apply_charges(structure(spark), records)
    got = {r["atom"]: round(r["partialCharge"], 5) for r in out.atoms.collect()}
    # H folds onto N, HA onto O (nearer than CA); residue 2 has no record.
    assert got == {0: -0.25, 1: 0.1, 2: 0.1, 3: -0.35, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}
    assert out.attributes["partialCharge"] == ("atom", "imported:pqr")
    assert report["matched"].first()["n"] == 4
    assert sorted(r["atom"] for r in report["unmatched_atoms"].collect()) == [4, 5, 6, 7]
    assert sorted((r["seq"], r["name"]) for r in report["unmatched_records"].collect()) == [("1", "HX"), ("7", "CB")]
    delta = sorted((r["residue"], r["altloc"], round(r["pqr"], 3), round(r["assigned"], 3)) for r in report["residue_delta"].collect())
    assert delta == [(0, "A", -0.2, -0.5), (0, "B", -0.2, -0.5)]


def test_records_without_chains(spark):
    bare = [r.replace(" A ", "   ", 1) if " A " in r else r for r in RECORDS[:5]]
    records = pqr.parse(spark.createDataFrame([("f", "\n".join(bare))], "file string, value string"))
    out, _ = pqr.apply_charges(structure(spark), records)
    assert round(out.atoms.filter("atom = 0").first()["partialCharge"], 3) == -0.25
    with pytest.raises(pqr.IoError, match="AMBIGUOUS_CHAIN"):
        pqr.apply_charges(structure(spark, (("A", "A"), ("B", "B"))), records)
