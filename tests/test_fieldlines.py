import numpy as np

from spindle.operators import fieldlines, volume

GRID = volume.Grid((21, 21, 21), (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, -10, -10, -10, 1))


def test_lines_of_a_linear_potential_are_straight(spark):
    samples = volume.grid_points(spark, GRID).selectExpr("i", "j", "k", "2.0 * x AS v")
    seeds = spark.createDataFrame([(0, 0.0, 1.0, 2.0), (1, 50.0, 0.0, 0.0)], "line long, x double, y double, z double")
    rows = fieldlines.field_lines(seeds, samples, GRID, steps=30, h=0.5).orderBy("line", "k").collect()
    line = np.array([[r["x"], r["y"], r["z"], r["field"]] for r in rows if r["line"] == 0])
    assert len(line) == 61 and np.allclose(line[:, 1:3], [1, 2])
    # The field points to lower potentials; the line stops a sample before the grid's faces.
    assert np.allclose(line[30 : 30 + 20, 0], -0.5 * np.arange(20)) and np.allclose(line[30 : 30 + 20, 3], 2)
    assert line[0, 0] == line[1, 0] == 9.5 and line[0, 3] == -1 and line[-1, 0] == -9.5
    assert {r["field"] for r in rows if r["line"] == 1} == {-1.0}


def test_lines_around_a_charge_are_radial(spark):
    samples = volume.grid_points(spark, GRID).selectExpr("i", "j", "k", "10 / greatest(1, sqrt(x * x + y * y + z * z)) AS v")
    seeds = spark.createDataFrame([(0, 3.0, 1.0, 2.0)], "line long, x double, y double, z double")
    rows = fieldlines.field_lines(seeds, samples, GRID, steps=10, h=0.4, most=5.0).orderBy("k").collect()
    p = np.array([[r["x"], r["y"], r["z"]] for r in rows if r["field"] >= 0])
    way = p / np.linalg.norm(p, axis=1, keepdims=True)
    assert (way @ (np.array([3.0, 1, 2]) / np.sqrt(14)) > 0.995).all()
    assert (np.diff(np.linalg.norm(p, axis=1)) > 0).all() and np.linalg.norm(p, axis=1).min() >= 1.9


def test_lattice(spark):
    seeds = fieldlines.lattice_seeds(spark, GRID, 5.0, 1_000).collect()
    assert len(seeds) == 64 and {r["x"] for r in seeds} == {-7.5, -2.5, 2.5, 7.5}
    few = fieldlines.lattice_seeds(spark, GRID, 5.0, 10).collect()
    assert [r["line"] for r in few] == list(range(10)) and fieldlines.lattice_seeds(spark, GRID, 500.0, 10).count() == 1
