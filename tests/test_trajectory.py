"""Trajectory files written here are read back frame by frame."""

import struct

import numpy as np
import pytest

from spindle.sources import trajectory as T
from spindle.sources.pqr import IoError

RNG = np.random.default_rng(3)


def dcd(frames, end="<", cell=None, delta=0.5, cut=0, fixed=0):
    n = len(frames[0])
    words = [0] * 20
    words[0], words[1], words[2], words[8], words[10], words[19] = 7, 10, 5, fixed, int(cell is not None), 24
    head = bytearray(struct.pack(end + "20i", *words))
    struct.pack_into(end + "f", head, 36, delta)
    out = struct.pack(end + "i", 84) + b"CORD" + bytes(head) + struct.pack(end + "i", 84)
    out += struct.pack(end + "ii", 84, 1) + b"t" * 80 + struct.pack(end + "i", 84)
    out += struct.pack(end + "3i", 4, n, 4)
    for f in frames:
        if cell is not None:
            out += struct.pack(end + "i6di", 48, *cell, 48)
        for k in range(3):
            out += struct.pack(end + f"i{n}fi", 4 * n, *f[:, k].tolist(), 4 * n)
    return out[: len(out) - cut]


def trr(frames, velocities=True, double=False, box=True, empty=()):
    out = b""
    for k, f in enumerate(frames):
        real, n = (8 if double else 4), len(f)
        x = 0 if k in empty else 3 * n * real
        sizes = [0, 0, 9 * real if box else 0, 0, 0, 0, 0, x, 3 * n * real if velocities else 0, 0, n, k, 0]
        body = np.array([k * 2.0, 0.0] + ([3, 0, 0, 0, 4, 0, 0, 0, 5] if box else []), f">f{real}").tobytes()
        body += (f / 10).astype(f">f{real}").tobytes() if x else b""
        body += (f / 20).astype(f">f{real}").tobytes() if velocities else b""
        out += struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file" + struct.pack(">13i", *sizes) + body
    return out


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> k) & 1 for k in range(width - 1, -1, -1)]

    def mixed(self, width, sizes, v):
        value = (v[0] * sizes[1] + v[1]) * sizes[2] + v[2]
        while width > 8:
            self.put(value & 255, 8)
            value, width = value >> 8, width - 8
        self.put(value, width)

    def data(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes()


def xtc_body(q, small=20):
    """Runs of up to two small differences, the first one swapped with its neighbour."""
    low, high = q.min(0), q.max(0)
    sizes = [int(h - m + 1) for h, m in zip(high, low)]
    width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    w, i, size = Writer(), 0, T.XTC_SIZES[small]
    half = size // 2
    near = lambda a, b: ((q[a] - q[b] >= -half) & (q[a] - q[b] < size - half)).all()
    state = 0
    while i < len(q):
        run = 0
        if i + 1 < len(q) and near(i, i + 1):
            run = 1
            if i + 2 < len(q) and near(i + 2, i):
                run = 2
        first = i + 1 if run else i
        w.mixed(width, sizes, [int(x) for x in q[first] - low])
        if run * 3 == state:
            w.put(0, 1)
        else:
            w.put(1, 1), w.put(run * 3 + 1, 5)
            state = run * 3
        if run:
            w.mixed(small, (size,) * 3, [int(x) for x in q[i] - q[i + 1] + half])
        if run == 2:
            w.mixed(small, (size,) * 3, [int(x) for x in q[i + 2] - q[i] + half])
        i += run + 1
    data = w.data()
    return struct.pack(">3i3iii", *low.tolist(), *high.tolist(), small, len(data)) + data + bytes(-len(data) % 4)


def xtc(frames, precision=1000.0):
    out = b""
    for k, f in enumerate(frames):
        n = len(f)
        out += struct.pack(">3if9f", 1995, n, k, k * 0.5, 3, 0, 0, 0, 4, 0, 0, 0, 5) + struct.pack(">i", n)
        out += (f / 10).astype(">f4").tobytes() if n <= 9 else struct.pack(">f", precision) + xtc_body(np.round(f / 10 * precision).astype(np.int64))
    return out


def walk(n):
    return np.cumsum(RNG.normal(0, 0.4, (n, 3)) + (RNG.random((n, 1)) < 0.2) * RNG.normal(0, 8, (n, 3)), axis=0).astype(np.float32)


def read(spark, tmp_path, data, name, **kw):
    path = tmp_path / name
    path.write_bytes(data)
    rows = T.read_frames(spark, str(path), **kw).orderBy("frame", "atom").collect()
    return str(path), rows


def positions(rows, n):
    return np.array([[r["x"], r["y"], r["z"]] for r in rows]).reshape(-1, n, 3)


@pytest.mark.parametrize("end", "<>")
def test_dcd(spark, tmp_path, end):
    frames = [walk(12), walk(12), walk(12)]
    path, rows = read(spark, tmp_path, dcd(frames, end, (10, 0, 20, 0, 0, 30), cut=5), "a.dcd", picoseconds=True)
    assert np.allclose(positions(rows, 12), frames[:2])
    assert sorted({round(r["time"], 6) for r in rows}) == [round((10 + 5 * k) * 0.5 * T.AKMA_PS, 6) for k in range(2)]
    boxes = T.read_boxes(spark, path).orderBy("frame").collect()
    assert [np.round(b["box"], 6).tolist() for b in boxes] == [[10, 0, 0, 0, 20, 0, 0, 0, 30]] * 2


def test_dcd_cells_and_errors(spark):
    assert T.dcd_box([0] * 6) is None
    assert np.allclose(T.dcd_box([10, 90, 20, 90, 90, 30]), [10, 0, 0, 0, 20, 0, 0, 0, 30])
    assert T.dcd_box([10, -2, 20, 1, 3, 30]) == [10, -2, 1, -2, 20, 3, 1, 3, 30]
    assert np.allclose(T.dcd_box([10, 0.5, 10, 0, 0, 10]), T.box_matrix(10, 10, 10, 90, 90, 60))
    at = lambda d: (lambda a, n: d[a : a + n])
    for data, code in ((dcd([walk(3)], fixed=2), "UNSUPPORTED"), (dcd([walk(3)], cut=9), "TRUNCATED"), (b"x" * 100, "INVALID"), (b"x" * 10, "TRUNCATED")):
        with pytest.raises(IoError, match=code):
            T.dcd_index(at(data), len(data))


@pytest.mark.parametrize("double", [False, True])
def test_trr(spark, tmp_path, double):
    frames = [walk(11), walk(11), walk(11)]
    path, rows = read(spark, tmp_path, trr(frames, True, double, empty=(1,)) + b"\0\0\7\xc9", f"{double}.trr", velocities=True)
    assert np.allclose(positions(rows, 11), [frames[0], frames[2]], atol=1e-4)
    assert np.allclose([r["vx"] for r in rows[:11]], frames[0][:, 0] / 2, atol=1e-4)
    assert sorted({r["time"] for r in rows}) == [0.0, 4.0]
    assert [b["box"] for b in T.read_boxes(spark, path).orderBy("frame").collect()] == [[30, 0, 0, 0, 40, 0, 0, 0, 50]] * 2
    path, rows = read(spark, tmp_path, trr(frames, False, double, False), f"{double}n.trr", velocities=True)
    assert {r["vx"] for r in rows} == {None} and T.read_boxes(spark, path).isEmpty()


@pytest.mark.parametrize("n", [4, 9, 10, 400])
def test_xtc(spark, tmp_path, n):
    frames = [walk(n), walk(n)]
    path, rows = read(spark, tmp_path, xtc(frames) + b"\0\0\7\xcb", f"{n}.xtc")
    assert np.allclose(positions(rows, n), frames, atol=0.0051)
    assert sorted({r["time"] for r in rows}) == [0.0, 0.5]
    assert [b["box"] for b in T.read_boxes(spark, path).orderBy("frame").collect()] == [[30, 0, 0, 0, 40, 0, 0, 0, 50]] * 2


def test_xtc_frames_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "TASK_BYTES", 500)
    frames = [walk(40) for _ in range(12)]
    path, rows = read(spark, tmp_path, xtc(frames), "many.xtc")
    assert np.allclose(positions(rows, 40), frames, atol=0.0051)
    index = T.frame_index(spark, path)
    assert index.count() == 12 and index.selectExpr("count(distinct floor(place / 500)) n").first()["n"] > 3
    with pytest.raises(IoError, match="INVALID"):
        T.xtc_index(lambda a, n: (b"\0" * 200)[a : a + n], 200)
    with pytest.raises(ValueError, match="unknown"):
        T.read_frames(spark, "x.abc")
