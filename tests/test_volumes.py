"""Maps written here, read by slabs and sampled from a stored volume."""

import struct

import numpy as np
import pytest

from spindle.operators import volume
from spindle.sources import volumes as V
from spindle.sources.pqr import IoError

SKEW = dict(lengths=(20.0, 24.0, 30.0), angles=(80.0, 95.0, 110.0), grid=(10, 12, 20), start=(3, -2, 5), axes=(3, 1, 2))


def ccp4(values, lengths=(10.0, 10.0, 10.0), angles=(90.0, 90.0, 90.0), grid=None, start=(0, 0, 0), axes=(1, 2, 3), origin=(0, 0, 0), mode=2, end="<", extra=0, scaled=None):
    """``values`` by (section, row, column); ``start`` in the same order as the dimensions."""
    ns, nr, nc = values.shape
    grid = grid or values.transpose([2 - axes.index(a) for a in (1, 2, 3)]).shape
    head = bytearray(1024)
    for at, kind, words in ((0, "i", (nc, nr, ns, mode, *start, *grid)), (40, "f", (*lengths, *angles)), (64, "i", axes), (92, "i", (extra,)), (196, "f", origin)):
        struct.pack_into(end + f"{len(words)}{kind}", head, at, *words)
    if scaled:
        struct.pack_into(end + "2f", head, 76, *scaled)
        struct.pack_into(end + "2i", head, 156, -128, 127)
    head[208:212] = b"MAP "
    head[212:214] = b"\x44\x41" if end == "<" else b"\x11\x11"
    return bytes(head) + bytes(extra) + values.astype(np.dtype(end + ("i1" if scaled else V.TYPES[mode]))).tobytes()


def read(spark, path, **options):
    return {(r["i"], r["j"], r["k"]): r["v"] for r in V.read_slabs(spark, str(path), **options).collect()}


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("mode", [0, 1, 2])
def test_slabs_of_permuted_axes(spark, tmp_path, end, mode):
    values = np.random.default_rng(5).integers(-90, 90, (4, 5, 6))
    (tmp_path / "m.map").write_bytes(ccp4(values, mode=mode, end=end, extra=80, **SKEW))
    width = V.WIDTHS[mode]
    got = read(spark, tmp_path / "m.map", task_bytes=3 * 6 * width)
    # Columns run along z, rows along x, sections along y.
    assert got == {(r, s, c): float(values[s, r, c]) for s in range(4) for r in range(5) for c in range(6)}
    cut = V.slabs(V.read_headers(spark, str(tmp_path / "m.map")), 3 * 6 * width).select("first", "last").collect()
    assert sorted(map(tuple, cut)) == [(k, min(k + 3, 20)) for k in range(0, 20, 3)]


def test_affine_of_a_skew_cell(spark, tmp_path):
    values = np.zeros((4, 5, 6))
    (tmp_path / "a.map").write_bytes(ccp4(values, **SKEW))
    (tmp_path / "b.map").write_bytes(ccp4(values, origin=(4.0, -6.0, 1.5), **SKEW))
    rows = {r["file"][-5]: r for r in V.read_headers(spark, str(tmp_path)).collect()}
    a, b, c = (np.array(V.cell_matrix(SKEW["lengths"], SKEW["angles"])).T)
    assert np.allclose([np.linalg.norm(v) for v in (a, b, c)], SKEW["lengths"])
    for (v, w), angle in zip(((b, c), (a, c), (a, b)), SKEW["angles"]):
        assert np.isclose(np.degrees(np.arccos(v @ w / np.linalg.norm(v) / np.linalg.norm(w))), angle)
    # Starts belong to columns (z), rows (x) and sections (y).
    for name, first in (("a", (-2, 5, 3)), ("b", (4.0 / 2, -6.0 / 2, 1.5 / 1.5))):
        grid = V.grid_of(rows[name])
        assert grid.dims == (5, 4, 6)
        for index in ((0, 0, 0), (4, 3, 5), (1, 2, 0)):
            u = [(i + s) / n for i, s, n in zip(index, first, SKEW["grid"])]
            assert np.allclose((grid.matrix() @ [*index, 1])[:3], u[0] * a + u[1] * b + u[2] * c, atol=1e-5)


def test_scaled_bytes(spark, tmp_path):
    values = np.array([[[-128, 0, 127]]])
    (tmp_path / "m.map").write_bytes(ccp4(values, scaled=(-2.0, 3.1)))
    got = read(spark, tmp_path / "m.map")
    assert np.allclose([got[k, 0, 0] for k in range(3)], [-2.0, -2.0 + 5.1 * 128 / 255, 3.1], atol=1e-5)


def test_refusals():
    good = ccp4(np.zeros((4, 5, 6)))
    change = lambda at, data: good[:at] + data + good[at + len(data) :]
    for data, code in (
        (good[:500], "INVALID_MAP"), (good[:-1], "INVALID_MAP"), (change(208, b"\0"), "INVALID_MAP"), (change(68, struct.pack("<i", 1)), "INVALID_MAP"),
        (change(12, struct.pack("<i", 4)), "UNSUPPORTED_MODE"), (change(0, struct.pack("<i", 0)), "INVALID_MAP"), (change(40, struct.pack("<f", 0)), "INVALID_MAP"),
    ):
        with pytest.raises(IoError) as e:
            V.parse_header(data[:1024], len(data))
        assert e.value.code == code
    with pytest.raises(IoError) as e:
        V.parse_header(good[:1024], len(good), 100)
    assert e.value.code == "VOLUME_TOO_LARGE"
    assert V.parse_header(good[:1024], len(good), 120)["nx"] == 6


def test_a_stored_volume_is_sampled_in_part(spark, tmp_path):
    n = 40
    k, j, i = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    (tmp_path / "m.map").write_bytes(ccp4((2 * i - 3 * j + k).astype(float), lengths=(80.0, 80.0, 80.0), angles=(75.0, 90.0, 100.0)))
    grid = V.grid_of(V.read_headers(spark, str(tmp_path / "m.map")).first())
    V.store_volume(V.read_slabs(spark, str(tmp_path / "m.map"), task_bytes=1 << 14), str(tmp_path / "v"), side=8, files=16)
    held = spark.read.parquet(str(tmp_path / "v"))
    assert held.count() == n**3
    at = [(3.25, 4.5, 6.0), (7.0, 5.75, 2.5), (300.0, 0.0, 0.0)]
    points = spark.createDataFrame([(p, *map(float, (grid.matrix() @ [*u, 1])[:3])) for p, u in enumerate(at)], "point long, x double, y double, z double")
    near = V.around(held, points, grid)
    assert near.count() < 1000
    assert len({r[0] for r in near.selectExpr("input_file_name()").collect()}) < 6
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i," in plan
    got = {r["point"]: r["value"] for r in volume.sample(points, near, grid).collect()}
    assert all(np.isclose(got[p], 2 * u[0] - 3 * u[1] + u[2], atol=1e-4) for p, u in enumerate(at[:2])) and got[2] == 0
    assert V.around(held, points.filter("point = 2"), grid).count() == 0
