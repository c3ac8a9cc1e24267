"""Operators against small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import bonding, curves, dynamics, electrostatics
from spindle.structure import create_structure

def test_normals_follow_the_inverse_error_function():
    words = np.array([0, 1 << 31, (1 << 32) - 1, 0x9E3779B9], np.uint64)
    z = dynamics.word_normals(words)
    assert z[0] == -z[2] and abs(z[1]) < 1e-6 and abs(z[0] + 5.2946) < 0.01
    many = dynamics.normals(7, 3, 20_000)
    assert abs(many.mean()) < 0.02 and abs(many.std() - 1) < 0.02
    assert (dynamics.normals(7, 3, 5) == many[:5]).all() and (dynamics.normals(7, 4, 5) != many[:5]).any()


def test_minimum_image_of_a_skew_box():
    box = np.array([[10.0, 0, 0], [9.0, 4, 0], [2.0, 3.5, 5]])
    d = np.random.default_rng(2).normal(0, 20, (60, 3))
    got = dynamics.minimum_image_triclinic(d, box)
    shifts = np.stack(np.meshgrid(*[np.arange(-25, 26)] * 3, indexing="ij"), -1).reshape(-1, 3) @ box
    for x, y in zip(d, got):
        best = ((x - shifts) ** 2).sum(1).min()
        assert np.isclose((y**2).sum(), best)
        assert np.allclose(np.round((x - y) @ np.linalg.inv(box)), (x - y) @ np.linalg.inv(box), atol=1e-6)
    assert dynamics.minimum_image_triclinic(np.array([[5.0, 0, 0]]), np.eye(3) * 10)[0].tolist() == [5, 0, 0]


def test_electrostatics_options():
    E = electrostatics.Electrostatics
    assert E().epsilon == 4 and E().kappa == 0 and abs(E("vacuum", unit="kcal/mol/e").scale - 332.0637) < 1e-3
    assert abs(E("debye").kappa - 0.1273) < 1e-3 and E(cutoff=12.0).switch_on == 10
    for bad, kind in ((dict(model="x"), TypeError), (dict(unit="J"), TypeError), (dict(epsilon=0.0), ValueError), (dict(switch_width=1.0), TypeError), (dict(cutoff=2.0), ValueError), (dict(ionic_strength=-1.0), ValueError)):
        with pytest.raises(kind):
            E(**bad)


def test_field_is_the_slope_of_the_potential(spark):
    p = electrostatics.Electrostatics("distance", cutoff=6.0, switch_width=3.0)
    charges = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (2.0, 1.0, 0.0, -2.0)], "x double, y double, z double, q double")
    h = 1e-4
    at = [(3.0, 1.5, 0.5), (4.0, -2.0, 1.0)]
    points = spark.createDataFrame([(6 * k + 2 * a + s, *(v + (2 * s - 1) * h * (i == a) for i, v in enumerate(x))) for k, x in enumerate(at) for a in range(3) for s in (0, 1)], "point long, x double, y double, z double")
    phi = {r["point"]: r["phi"] for r in electrostatics.potential(points, charges, p).collect()}
    here = spark.createDataFrame([(k, *x) for k, x in enumerate(at)], "point long, x double, y double, z double")
    for r in electrostatics.field(here, charges, p).collect():
        for a, c in enumerate("xyz"):
            k = 6 * r["point"] + 2 * a
            assert abs(r[f"e{c}"] + (phi[k + 1] - phi[k]) / (2 * h)) < 1e-3


def test_curve_frames_are_orthonormal():
    rng = np.random.default_rng(4)
    p = np.cumsum(rng.normal(0, 2, (6, 5, 3)), axis=1)
    points, tangents = curves.points_and_tangents(p, np.zeros(6, bool), np.ones(6, bool), 8, 0.5, 0.5)
    assert np.allclose(points[:, 4], p[:, 2]) and np.allclose(np.linalg.norm(tangents, axis=-1), 1)
    normals, binormals = curves.normals_and_binormals(tangents, np.tile([0, 0, 1.0], (6, 1)), np.tile([0, 1.0, 0], (6, 1)))
    assert np.allclose((tangents * normals).sum(-1)[:, [0, -1]], 0, atol=1e-9) and np.allclose(np.linalg.norm(binormals, axis=-1), 1)
    assert curves.sizes((0.0, 1.0, 3.0), 4) == [0.5, 0.75, 1.0, 1.5, 2.0]


def test_bond_rules(spark):
    """Template residues keep to their bonds, but for unbound hydrogens; metals coordinate; altlocs stay apart."""
    atom = lambda i, r, e, x, alt="", occ=1.0: (i, str(i), f"a{i}", alt, r, e, occ, 0.0, 1.5, None, x, 0.0, 0.0)
    tables = {
        "atoms": [atom(0, 0, 6, 0.0), atom(1, 0, 6, 1.5), atom(2, 0, 6, 0.7), atom(3, 0, 1, -1.0), atom(4, 1, 26, 3.2), atom(5, 1, 7, 5.2), atom(6, 2, 6, 20.0, "A"), atom(7, 2, 6, 21.4, "B"), atom(8, 2, 1, 19.0, "A"), atom(9, 2, 1, 18.6, "A")],
        "residues": [(r, 0, r, str(r), "", c, "other", False) for r, c in ((0, "XX"), (1, "YY"), (2, "ZZ"))],
        "chains": [(0, 1, "A", "A", "", "", "")],
        "links": [(0, 0, 1, 2, 1, "component")],
    }
    s = create_structure(spark, tables, check=False)
    got = {(r["a"], r["b"]): (r["flags"], r["order"]) for r in bonding.computed_bonds(s).collect()}
    assert got == {(0, 1): (1, 2), (0, 3): (33, 1), (1, 4): (34, 1), (4, 5): (34, 1), (6, 8): (33, 1)}
    moved = s.with_positions(s.atoms.select("atom", (F.col("x") * 100).alias("x"), "y", "z"))
    kept = bonding.preserve_bond_graph(s, moved)
    assert kept.edges.count() == len(got) and moved.edges is None
    with pytest.raises(TypeError):
        bonding.preserve_bond_graph(s, create_structure(spark, tables, check=False))
