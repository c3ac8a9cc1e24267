import math

import numpy as np
import pytest

from spindle.sources import bcif
from spindle.sources.pqr import IoError

from . import bcif_fixture as fx

ROWS = [
    (1, "A", "1", 1, "10", "ALA", "N", ".", "N", 1.0, 0.0, 0.0, "ATOM"),
    (1, "A", "1", 1, "10", "ALA", "CA", "A", "C", 2.0, 0.5, 0.0, "ATOM"),
    (1, "A", "1", 1, "10", "ALA", "CA", "B", "C", 2.0, 0.7, 0.0, "ATOM"),
    (1, "A", "1", 2, "11", "CYS", "N", ".", "N", 3.0, 0.0, 0.25, "ATOM"),
    (1, "A", "1", 2, "11", "CYS", "SG", ".", "S", 3.5, 0.0, 0.0, "ATOM"),
    (1, "B", "2", None, "201", "HEM", "FE", ".", "FE", 9.0, -1.5, 0.0, "HETATM"),
    (1, "C", "3", None, "301", "HOH", "O", ".", "O", 7.0, 0.0, 0.0, "HETATM"),
    (1, "C", "3", None, "302", "HOH", "O", ".", "O", 8.0, 0.0, 0.0, "HETATM"),
    (2, "A", "1", 1, "10", "ALA", "N", ".", "N", 1.1, 0.0, 0.0, "ATOM"),
    (2, "A", "1", 2, "11", "CYS", "SG", ".", "S", 3.6, 0.0, 0.0, "ATOM"),
]
TABLES = {
    "atom_site": fx.atom_site(ROWS),
    "entity": {"id": ["1", "2", "3"], "type": ["Polymer", "non-polymer", "water"]},
    "entity_poly": {"entity_id": ["1"], "type": ["polypeptide(L)"]},
    "struct_conf": {"conf_type_id": ["HELX_P"], "pdbx_PDB_helix_class": ["5"], "beg_label_asym_id": ["A"], "beg_label_seq_id": [1], "end_label_seq_id": [1]},
    "struct_sheet_range": {"beg_label_asym_id": ["A"], "beg_label_seq_id": [2], "end_label_seq_id": [2]},
    "chem_comp_bond": {"comp_id": ["ALA", "CYS"], "atom_id_1": ["N", "SG"], "atom_id_2": ["CA", "N"], "value_order": ["sing", "doub"], "pdbx_aromatic_flag": ["N", "Y"]},
    "struct_conn": {
        "conn_type_id": ["metalc"], "ptnr1_label_asym_id": ["A"], "ptnr1_label_seq_id": ["2"], "ptnr1_auth_seq_id": ["11"], "ptnr1_label_comp_id": ["CYS"], "ptnr1_label_atom_id": ["SG"],
        "ptnr2_label_asym_id": ["B"], "ptnr2_label_seq_id": ["."], "ptnr2_auth_seq_id": ["201"], "ptnr2_label_comp_id": ["HEM"], "ptnr2_label_atom_id": ["FE"],
    },
    "pdbx_struct_assembly_gen": {"assembly_id": ["1", "2"], "oper_expression": ["1,2", "(1-2)(P)"], "asym_id_list": ["A,B", "A"]},
    "pdbx_struct_oper_list": {"id": ["1", "2", "P"]}
    | {f"matrix[{i}][{j}]": [float(i == j), float(i == j) * (1 if i == 3 else -1), float(i == j)] for i in (1, 2, 3) for j in (1, 2, 3)}
    | {f"vector[{i}]": [0.0, 0.0, 5.0 if i == 1 else 0.0] for i in (1, 2, 3)},
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = tmp_path_factory.mktemp("bcif") / "x.bcif"
    out.write_bytes(fx.file(**TABLES))
    return str(out)


def test_encodings():
    for values in ([5, 5, 5, 300, -700, 127, -128, 0], [0], list(range(400))):
        e = fx.integers(values)
        assert bcif.decoded(e["data"], e["encoding"]).tolist() == values
    e = fx.decimals([1.5, -2.25, 0.001])
    assert np.allclose(bcif.decoded(e["data"], e["encoding"]), [1.5, -2.25, 0.001])
    data, enc = fx.array([0, 1, 4], "u1", 4)
    q = [{"kind": "IntervalQuantization", "min": -1.0, "max": 1.0, "numSteps": 5, "srcType": 33}, *enc]
    assert bcif.decoded(data, q).tolist() == [-1.0, -0.5, 1.0]
    e = fx.strings(["a", "bc", "a", ""])
    assert bcif.decoded(e["data"], e["encoding"]).tolist() == ["a", "bc", "a", ""]
    data, enc = fx.array([255, 255, 3, 7], "u1", 4)
    assert bcif.decoded(data, [{"kind": "IntegerPacking", "byteCount": 1, "isUnsigned": True, "srcSize": 2}, *enc]).tolist() == [513, 7]
    value = {"a": [1, -5, 2**40, None, True, 0.5, "x" * 40, b"yz"], "b": {"c": "d"}}
    assert bcif.unpack(fx.packed(value))[0] == value


def test_tables(spark, path):
    s = bcif.read_structure(spark, path)
    atoms = s.atoms.orderBy("atom").collect()
    assert [a["name"] for a in atoms] == [r[6] for r in ROWS]
    assert [a["altloc"] for a in atoms] == [r[7].strip(".") for r in ROWS]
    assert [a["residue"] for a in atoms] == [0, 0, 0, 1, 1, 2, 3, 4, 5, 6]
    assert [a["element"] for a in atoms] == [7, 6, 6, 7, 16, 26, 8, 8, 7, 16]
    assert all(math.isclose(a[c], r[9 + k], abs_tol=1e-3) for a, r in zip(atoms, ROWS) for k, c in enumerate("xyz"))
    assert {(a["occupancy"], a["bfactor"]) for a in atoms} == {(1.0, 0.0)}
    residues = s.residues.orderBy("residue").collect()
    assert [(r["labelSeq"], r["authSeq"], r["comp"], r["het"]) for r in residues[:4]] == [(1, "10", "ALA", False), (2, "11", "CYS", False), (-1, "201", "HEM", True), (-1, "301", "HOH", True)]
    assert [r["ssCode"] for r in residues] == [4, 3, 0, 0, 0, 4, 3]
    chains = s.chains.orderBy("chain").collect()
    assert [(c["model"], c["labelId"], c["authId"], c["entityType"], c["entitySubtype"]) for c in chains] == [
        (1, "A", "a", "polymer", "polypeptide(L)"), (1, "B", "b", "non-polymer", "other"), (1, "C", "c", "water", "other"), (2, "A", "a", "polymer", "polypeptide(L)"),
    ]
    assert s.instances.count() == 4 and {r["operatorId"] for r in s.instances.collect()} == {"identity"}
    assert s.attributes["ssCode"] == ("residue", "imported:mmcif") and s.attributes["formalCharge"] == ("atom", "default")


def test_links(spark, path):
    s = bcif.read_structure(spark, path)
    got = sorted((r["a"], r["b"], r["order"], r["flags"], r["source"]) for r in s.links.collect())
    assert got == [(0, 1, 1, 1, "component"), (0, 2, 1, 1, "component"), (3, 4, 2, 17, "component"), (4, 5, 1, 2, "struct_conn")]


def test_assemblies(spark, path):
    s = bcif.read_structure(spark, path, assembly="1")
    got = [(r["chain"], r["operatorId"]) for r in s.instances.orderBy("instance").collect()]
    assert got == [(0, "1"), (0, "2"), (3, "1"), (3, "2"), (1, "1"), (1, "2")]
    s = bcif.read_structure(spark, path, assembly="2")
    rows = s.instances.orderBy("instance").collect()
    assert [r["operatorId"] for r in rows] == ["1xP", "2xP", "1xP", "2xP"]
    assert rows[0]["transform"][12] == 5 and rows[1]["transform"][12] == -5 and rows[1]["transform"][0] == -1
    with pytest.raises(IoError, match="UNKNOWN_ASSEMBLY"):
        bcif.read_structure(spark, path, assembly="9")
    assert bcif.operators_of("1,3-4") == [["1"], ["3"], ["4"]]


def test_defaults_and_errors(spark, tmp_path):
    bare = tmp_path / "bare.bcif"
    bare.write_bytes(fx.file(atom_site={"Cartn_x": [1.0, 2.0], "Cartn_y": [0.0, 0.0], "Cartn_z": [0.0, 0.0], "label_atom_id": ["A", "B"]}))
    s = bcif.read_structure(spark, str(bare))
    r = s.residues.collect()
    assert len(r) == 1 and (r[0]["comp"], r[0]["labelSeq"], r[0]["authSeq"], r[0]["ssCode"]) == ("UNK", -1, "-1", 0)
    assert [(a["id"], a["element"]) for a in s.atoms.orderBy("atom").collect()] == [("1", 0), ("2", 0)]
    none = tmp_path / "none.bcif"
    none.write_bytes(fx.file(entity={"id": ["1"], "type": ["polymer"]}))
    with pytest.raises(IoError, match="MISSING_ATOM_SITE"):
        bcif.read_structure(spark, str(none))
    assert bcif.categories(fx.file(entity={"id": ["1"]}))["entity"][""] == 1
    with pytest.raises(IoError, match="INVALID_BCIF"):
        bcif.categories(b"\x93\x01\x02\x03")
