"""Selections, expressions, fields and sources on small hand-made structures."""

import math
import struct

import numpy as np
import pytest

from spindle import views
from spindle.functions import expr, timeline
from spindle.operators import dynamics, fields, graph, selection as Q, spatial
from spindle.sources import pqr, trajectory
from spindle.structure import StructureError, create_structure


@pytest.fixture(scope="module")
def six(spark):
    xs, elements, residues = [0, 1, 2, 3, 10, 11], [7, 6, 16, 6, 16, 8], [0, 0, 1, 1, 2, 2]
    atoms = [(i, str(i), f"A{i}", "", residues[i], elements[i], 1.0, float(i), None, None, float(xs[i]), 0.0, 0.0) for i in range(6)]
    res = [(i, 0, i + 1, str(i + 1), "", c, "protein", False) for i, c in enumerate(["CYS", "GLY", "CYS"])]
    bonds = [(k, a, a + 1, 1, "component", 1) for k, a in enumerate((0, 2, 4))]
    return create_structure(spark, {"atoms": atoms, "residues": res, "chains": [(0, 1, "A", "A", None, None, None)], "bonds": bonds})


def ids(sel):
    return sorted(r[0] for r in sel.ids.collect())


def test_builders(six):
    assert ids(Q.resolve(Q.element(16), six)) == [2, 4]
    assert ids(Q.resolve(Q.comp(["CYS"]), six)) == [0, 2]
    assert ids(Q.to_atoms(Q.resolve(Q.comp(["CYS"]), six))) == [0, 1, 4, 5]
    assert ids(Q.resolve(Q.within(1.5, Q.element(16)), six)) == [1, 2, 3, 4, 5]
    assert ids(Q.resolve(~Q.within(1.5, Q.element(16)), six)) == [0]
    assert ids(Q.resolve(Q.element(16) | Q.element(8), six)) == [2, 4, 5]
    assert ids(Q.to_bonds(Q.resolve(Q.element(16), six), "either")) == [1, 2]
    assert ids(Q.to_bonds(Q.resolve(Q.element(16), six))) == []


def test_scopes_and_staleness(six):
    with pytest.raises(Q.ScopeConflict):
        Q.model(1) & Q.model(2)
    sel = Q.resolve(Q.within(1.0, Q.element(16)), six)
    moved = six.with_positions(six.atoms.select("atom", "x", "y", "z"))
    assert sel.is_stale(moved) and not sel.is_stale(six)
    with pytest.raises(ValueError):
        Q.union(sel, Q.resolve(Q.within(1.0, Q.element(16)), moved))


def test_validation(spark, six):
    bad = six.bonds.union(spark.createDataFrame([(9, 3, 3, 1, "component", 1)], six.bonds.schema))
    with pytest.raises(StructureError):
        create_structure(spark, {"atoms": six.atoms, "residues": six.residues, "chains": six.chains, "bonds": bad})


@pytest.mark.parametrize(
    "tree, want",
    [
        (["core.math.div", 1, 0], math.inf), (["core.math.div", 0, 0], math.nan), (["core.math.mod", -7, 3], -1), (["core.math.round-int", -2.5], -2),
        (["core.math.trunc", -2.7], -2), (["core.math.log", 0], -math.inf), (["core.math.log", -1], math.nan), (["core.math.min"], math.inf),
        (["core.math.max", 1, math.nan], math.nan), (["core.math.sub", 3], -3), (["core.math.mult"], 1), (["core.logic.and"], True), (["core.logic.or"], False),
        (["core.rel.eq", math.nan, math.nan], False), (["core.rel.neq", math.nan, math.nan], True), (["core.rel.eq", "1", 1], False),
        (["core.type.num", "12"], 12), (["core.type.num", "x"], math.nan), (["core.type.bool", ""], False), (["core.str.concat", "a", 1], "a1"),
        (["core.flags.has-any", 6, 0], True), (["core.flags.has-all", 6, 0], False), (["core.flags.has-all", 6, 2], True),
        (["core.str.match", ["core.type.regex", "^c", "i"], "CYS"], True), (["core.set.has", ["core.type.set", "a", "b"], "b"], True),
    ],
)
def test_scalars(spark, tree, want):
    got = spark.range(1).select(expr.scalar(tree).col.alias("v")).first()["v"]
    assert (got != got and want != want) or got == want


def test_language_errors(six):
    for tree in (["core.math.nope", 1], ["core.math.div", 1], ["structure-query.generator.atom-groups", {"colour-test": True}]):
        with pytest.raises(expr.ExpressionError):
            expr.scalar(tree) if tree[0].startswith("core") else expr.evaluate(six, tree)
    assert len(expr.supported_symbols()) > 90


def flat(s, tree):
    return sorted(r["atom"] for r in expr.evaluate(s, tree).flat().collect())


def test_sets(six):
    g, m, f = "structure-query.generator.", "structure-query.modifier.", "structure-query.filter."
    el = lambda z: [g + "atom-groups", {"atom-test": ["core.rel.eq", ["structure-query.atom-property.core.atomic-number"], z]}]
    assert flat(six, [m + "whole-residues", el(7)]) == [0, 1]
    assert flat(six, [m + "include-connected", el(7)]) == [0, 1]
    assert flat(six, [m + "include-surroundings", el(8), {"radius": 1}]) == [4, 5]
    assert flat(six, [f + "within", el(6), {"target": el(16), "max-radius": 0}]) == [1, 3]
    assert flat(six, [f + "within", el(6), {"target": [g + "empty"], "max-radius": 5}]) == []
    assert flat(six, [f + "within", el(6), {"target": [g + "empty"], "max-radius": 5, "min-radius": 0}]) == [1, 3]
    assert flat(six, [g + "query-in-selection", [g + "empty"], el(6), {"in-complement": True}]) == [1, 3]
    assert flat(six, [f + "first", el(16)]) == [2]
    merged = expr.evaluate(six, ["structure-query.combinator.merge", [m + "union", el(7)], [m + "union", el(7)]])
    assert merged.rows.select("set_id").distinct().count() == 1


def test_altloc_ties(spark):
    atoms = [(i, "", "CA", a, 0, 6, o, 0.0, None, None, 0.0, 0.0, 0.0) for i, (a, o) in enumerate([("B", 0.5), ("A", 0.5)])]
    atoms.append((2, "", "N", "", 0, 7, 1.0, 0.0, None, None, 1.0, 0.0, 0.0))
    s = create_structure(spark, {"atoms": atoms, "residues": [(0, 0, 1, "1", "", "ALA", "protein", False)], "chains": [(0, 1, "A", "A", None, None, None)]})
    assert sorted(r["atom"] for r in views.active_atoms(s).collect()) == [1, 2]


def test_spatial_against_brute_force(spark):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(-8, 8, (150, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "atom long, x double, y double, z double")
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if d2[i, j] <= 9}
    assert {(r["a"], r["b"]) for r in spatial.pairs_within(df, 3.0).collect()} == want
    with pytest.raises(spatial.PairLimitError):
        spatial.pairs_within(df, 3.0, most=1)
    points, atoms = df.filter("atom < 40").withColumnRenamed("atom", "point"), df.filter("atom >= 40")
    got = {r["point"]: r["atom"] for r in spatial.nearest(points, atoms, 1.0).collect()}
    assert got == {i: 40 + int(d2[i, 40:].argmin()) for i in range(40)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (6, 5), (5, 4), (9, 9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    got = {r["node"]: r["component"] for r in graph.components(edges, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 9}


def test_kabsch_and_unwrap(spark):
    rng = np.random.default_rng(2)
    ref = rng.normal(size=(20, 3))
    a = 0.7
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    moved = ref @ r.T + [3, -2, 1]
    frames = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(moved)], "frame int, atom long, x double, y double, z double")
    base = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(ref)], "atom long, x double, y double, z double")
    assert dynamics.fit_kabsch(frames, base).first()["rmsd"] < 1e-6
    fitted = np.array([[q["x"], q["y"], q["z"]] for q in dynamics.superposed(frames, base).orderBy("atom").collect()])
    assert np.abs(fitted - ref).max() < 1e-4
    chain = np.array([[0.5, 0, 0], [9.5, 0, 0], [8.6, 0, 0]])
    f = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(chain)], "frame int, atom long, x double, y double, z double")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    tree = dynamics.spanning_tree(edges, graph.components(edges))
    box = spark.createDataFrame([(0, [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0])], "frame int, box array<double>")
    got = {q["atom"]: round(q["x"], 6) for q in dynamics.unwrap(f, tree, box).collect()}
    assert got == {0: 0.5, 1: -0.5, 2: -1.4}


def test_elastic_modes_and_langevin(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(8)], "atom long, x double, y double, z double")
    modes = dynamics.elastic_modes(nodes, 1.5, count=2).select("mode", "eigenvalue").distinct().orderBy("mode").collect()
    assert abs(modes[0]["eigenvalue"] - (2 - 2 * math.cos(math.pi / 8))) < 1e-9
    springs = dynamics.elastic_pairs(nodes, 1.5)
    one = dynamics.langevin(nodes, springs, [1, 2], 5).orderBy("replica", "atom").collect()
    two = dynamics.langevin(nodes, springs, [2, 1], 5).orderBy("replica", "atom").collect()
    assert one == two and len(one) == 16
    assert hex(int(dynamics.philox(np.zeros((1, 4), np.uint64), (0, 0))[0, 0])) == "0x6627e8d5"


def test_fields(spark):
    df = spark.createDataFrame([(0, 6, -1.0), (1, 7, 0.25), (2, 8, 3.5)], "atom long, element int, bfactor double")
    b = fields.attribute("bfactor")
    out = fields.evaluate(df, "atom", c=fields.categorical(fields.attribute("element"), {"7": 2, "6": 1}, 0), w=fields.linear(b, overflow="wrap"), l=fields.linear(b)).orderBy("atom").collect()
    assert [tuple(r)[1:] for r in out] == [(1, 0, 0), (2, 0.25, 0.25), (0, 0.5, 1)]
    with pytest.raises(fields.FieldError):
        fields.attribute("ssCode", "atom", False, "residue")
    with pytest.raises(fields.FieldError):
        fields.join_annotation(df, df.union(df), ["atom"], "bfactor")
    assert fields.curve([(0, 0), (2, 4)], 1).value is not None
    with pytest.raises(ValueError):
        timeline.checked([timeline.Keyframe(1, 0), timeline.Keyframe(1, 2)])


PQR = """REMARK
ATOM      1  N   ALA A   1       0.000   0.000   0.000  0.1000 1.5000
ATOM      2  CA  ALA A   1       1.450   0.000   0.000 -0.2000 0.0000
TER
HETATM12345  O   HOH     2A    -100.123-200.456   3.000  0.1000 1.6000
MODEL 2
ATOM      1  N   GLY A   1       0.000   5.000   0.000  0.0000 1.5000
"""


def test_pqr(spark, tmp_path):
    (tmp_path / "a.pqr").write_text(PQR)
    records = pqr.read_records(spark, str(tmp_path / "a.pqr"))
    rows = records.orderBy("line").collect()
    assert [(r["name"], r["chain"], r["seq"], r["insertion"], r["model"], r["segment"]) for r in rows] == [
        ("N", "A", 1, "", 1, 0), ("CA", "A", 1, "", 1, 0), ("O", "", 2, "A", 1, 1), ("N", "A", 1, "", 2, 2)]
    assert (rows[2]["x"], rows[2]["y"]) == (-100.123, -200.456)
    s = pqr.structure(records)
    assert (s.atoms.count(), s.residues.count(), s.chains.count()) == (4, 3, 3)
    assert pqr.report(records).first()["radius_fallbacks"] == 1
    with pytest.raises(pqr.IoError):
        (tmp_path / "b.pqr").write_text("ATOM 1 N ALA 1 0.0 0.0\n")
        pqr.structure(pqr.read_records(spark, str(tmp_path / "b.pqr")))


def test_dcd_and_ccp4(spark, tmp_path):
    block = lambda b, e: struct.pack(e + "i", len(b)) + b + struct.pack(e + "i", len(b))
    for e in "<>":
        head = b"CORD" + struct.pack(e + "9i", 99, 0, 1, 0, 0, 0, 0, 0, 0) + struct.pack(e + "f", 0.5) + struct.pack(e + "10i", *[0] * 9, 24)
        data = block(head, e) + block(struct.pack(e + "i", 1) + b" " * 80, e) + block(struct.pack(e + "i", 2), e)
        for f in range(2):
            for k in range(3):
                data += block(struct.pack(e + "2f", f + k, f + k + 0.5), e)
        path = tmp_path / f"{'le' if e == '<' else 'be'}.dcd"
        path.write_bytes(data + b"\0" * 7)
        got = trajectory.read_frames(spark, str(path)).orderBy("frame", "atom").collect()
        assert [(r["frame"], r["time"], r["atom"], r["x"], r["z"]) for r in got] == [(0, 0, 0, 0, 2), (0, 0, 1, 0.5, 2.5), (1, 0.5, 0, 1, 3), (1, 0.5, 1, 1.5, 3.5)]
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 2, 1, 3, 2)
    struct.pack_into("<3i", head, 64, 3, 2, 1)
    (tmp_path / "m.map").write_bytes(bytes(head) + struct.pack("<6f", *range(6)))
    got = trajectory.read_ccp4(spark, str(tmp_path / "m.map")).collect()
    assert {(r["i"], r["j"], r["k"]): r["v"] for r in got} == {(s, 0, c): s * 2 + c for s in range(3) for c in range(2)}


def test_stream(spark, tmp_path):
    from spindle.streaming import frames as S

    rows = spark.createDataFrame([(f"2024-01-01 00:00:0{f}", f, a, float(a + f), 0.0, 0.0) for f in range(3) for a in range(2)], "ts string, frame int, atom long, x double, y double, z double")
    rows.selectExpr("CAST(ts AS TIMESTAMP) AS ts", "frame", "atom", "x", "y", "z").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, frame int, atom long, x double, y double, z double").parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "atom long, x double, y double, z double")
    q = S.frame_metrics(source, ref).writeStream.format("memory").queryName("metrics").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["frame"]: r["rmsd"] for r in spark.table("metrics").collect()} == {0: 0, 1: 1, 2: 2}
    shots = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "owner string, generation int, v int")
    assert sorted(r["v"] for r in S.latest_snapshots(shots).collect()) == [6, 7]


def test_nearest_leaves_out_what_has_no_place(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, 90.0, 0.0, 0.0)], "point long, x double, y double, z double")
    atoms = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (8, float("inf"), 0.0, 0.0), (9, None, None, None)], "atom long, x double, y double, z double")
    got = {r["point"]: r["atom"] for r in spatial.nearest(points, atoms, 2.0).collect()}
    assert got == {1: 7, 4: 7}
