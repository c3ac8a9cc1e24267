"""Selection text against the expected atoms of a small structure."""

import pytest

from spindle.functions import selecttext
from spindle.operators import selection as Q
from spindle.structure import create_structure


@pytest.fixture(scope="module")
def s(spark):
    names, elements = ["N", "CA", "C", "O"], [7, 6, 6, 8]
    atoms = [(i, str(i), names[i % 4], "", i // 4, elements[i % 4], 1.0, float(i), None, None, float(i), 0.0, 0.0) for i in range(12)]
    res = [(0, 0, 1, "10", "", "ALA", "protein", False), (1, 0, 2, "11", "", "GLY", "protein", False), (2, 1, 1, "12", "", "HOH", "other", True)]
    return create_structure(spark, {"atoms": atoms, "residues": res, "chains": [(0, 1, "A", "A", None, None, None), (1, 1, "B", "W", None, None, None)]})


@pytest.mark.parametrize(
    "text, want",
    [
        ("all", list(range(12))), ("chain A and resi 10-11 and name CA", [1, 5]), ("name CA or elem O", [1, 3, 5, 7, 9, 11]), ("not chain A", [8, 9, 10, 11]),
        ("resn ALA+GLY & name N", [0, 4]), ("water", [8, 9, 10, 11]), ("byres (name N and resid 11)", [4, 5, 6, 7]), ("b > 9", [10, 11]),
        ("within 1 of index 5", [4, 5, 6]), ("index 5 around 1", [4, 6]), ("resid 10 to 11 and backbone and not name 'O'", [0, 1, 2, 4, 5, 6]), ("name C*", [1, 2, 5, 6, 9, 10]),
        ("same residue as index 9", [8, 9, 10, 11]), ("none", []),
    ],
)
def test_text(s, text, want):
    assert sorted(r["atom"] for r in Q.resolve(selecttext.parse(text), s).ids.collect()) == want


@pytest.mark.parametrize("text", ["", "name", "colour red", "(all", "all )", "resi x", "within of all"])
def test_errors(text):
    with pytest.raises(ValueError):
        selecttext.parse(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("index 5 expand 1", [4, 5, 6]), ("name N within 3 of index 5", [4, 8]), ("all near_to 1 of index 5", [4, 6]), ("name CA beyond 3 of index 5", [1, 9]),
        ("index 0 extend 2", [0, 1, 2]), ("bound_to index 1", [0, 2]), ("name CA within 1 of name N or index 11", [1, 5, 9, 11]), ("hydro", []),
    ],
)
def test_what_follows_an_operand(s, spark, text, want):
    from dataclasses import replace

    bonds = spark.createDataFrame([(i, i, i + 1, 1, 1) for i in range(11) if i % 4 != 3], "bond long, a long, b long, order int, flags int")
    got = Q.resolve(selecttext.parse(text), replace(s, bonds=bonds)).ids.collect()
    assert sorted(r["atom"] for r in got) == want
