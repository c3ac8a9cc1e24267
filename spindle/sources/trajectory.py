"""Trajectory and volume files: DCD, XTC and TRR frames, CCP4 maps.

A trajectory is read in two steps: one task per file walks the frame headers and returns the
frames' places, then tasks read ranges of frames, wherever the file is long.  Both
use range reads where the file system has them, else Spark's binary reader.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pqr import IoError

FRAME_ROWS = "file string, frame int, time double, atom long, x float, y float, z float"
VELOCITY_ROWS = FRAME_ROWS + ", vx float, vy float, vz float"
#: One unit of CHARMM's time step in picoseconds.
AKMA_PS = 0.0488882129
#: Bytes of frames that one task reads.
TASK_BYTES = 64 << 20
MOST_TASKS = 100_000
#: File systems whose files are read by ranges.
RANGED = ("file", "hdfs", "s3", "gs")
#: Fixed values of the XTC format: sizes of small differences, about 2^(i / 3).
XTC_SIZES = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580,
    3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280,
    416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
)
XTC_FIRST = 9

Read = Callable[[int, int], bytes]


def bad(message: str, code: str = "INVALID_TRAJECTORY") -> IoError:
    return IoError(code, message)


def box_matrix(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[float]:
    """Cell lengths and angles (degrees) -> nine values, column-major."""
    ca, cb, cg = (np.cos(np.radians(x)) for x in (alpha, beta, gamma))
    sg = np.sin(np.radians(gamma))
    cy = (ca - cb * cg) / sg
    cz = np.sqrt(max(0.0, 1 - cb * cb - cy * cy))
    return [float(x) for x in (a, 0, 0, b * cg, b * sg, 0, c * cb, c * cy, c * cz)]


def dcd_box(cell) -> list[float] | None:
    """The box of a DCD cell record in any of its three forms: cosines, a symmetric matrix, or degrees."""
    c = [float(x) for x in cell]
    if not any(c):
        return None
    if all(-1 <= c[i] <= 1 for i in (1, 3, 4)):
        return box_matrix(c[0], c[2], c[5], *(float(np.degrees(np.arccos(c[i]))) for i in (4, 3, 1)))
    if min(c) < 0 or max(c[1], c[3], c[4]) > 180:
        return [c[0], c[1], c[3], c[1], c[2], c[4], c[3], c[4], c[5]]
    return box_matrix(c[0], c[2], c[5], *(90.0 if abs(c[i]) < 1e-6 else c[i] for i in (4, 3, 1)))


def dcd_index(read: Read, size: int, unit: float = 1.0) -> list[tuple[int, int, float, int]]:
    """(place, bytes, time, atoms) of every whole frame; the file's size tells how many there are.

    Times are in the file's own unit, or ``unit`` of another for each of it; in steps where
    the file has no time step.
    """
    if size < 92:
        raise bad("DCD: shorter than its header", "TRUNCATED_TRAJECTORY")
    head = read(0, 92)
    end = "<" if struct.unpack_from("<i", head)[0] == 84 else ">"
    if struct.unpack_from(end + "i", head)[0] != 84 or head[4:8] != b"CORD" or struct.unpack_from(end + "i", head, 88)[0] != 84:
        raise bad("not a DCD file")
    words = struct.unpack_from(end + "20i", head, 8)
    charmm = words[19] != 0
    if words[8] > 0:
        raise bad("DCD: fixed atoms", "UNSUPPORTED_TRAJECTORY")
    delta = struct.unpack_from(end + ("f" if charmm else "d"), head, 44)[0]
    title = struct.unpack(end + "i", read(92, 4))[0]
    at = 92 + title + 8
    atoms = struct.unpack(end + "3i", read(at, 12))[1]
    at += 12
    cell, four = charmm and words[10] != 0, charmm and words[11] == 1
    stride = (56 if cell else 0) + (4 if four else 3) * (8 + 4 * atoms)
    frames = (size - at) // stride if atoms > 0 else 0
    if frames < 1:
        raise bad("DCD: no complete frame", "TRUNCATED_TRAJECTORY")
    unit = delta * unit if 0 < delta < float("inf") else 1.0
    step = max(1, words[2])
    return [(at + i * stride, stride, (words[1] + i * step) * unit, atoms) for i in range(frames)]


def dcd_frame(data: bytes, atoms: int) -> tuple:
    """(box, positions, velocities) of one frame, either byte order; a cell record comes first."""
    n4 = 4 * atoms
    cell = len(data) - 3 * (8 + n4) >= 56 and 48 in (struct.unpack_from("<i", data)[0], struct.unpack_from(">i", data)[0]) and n4 != 48
    cell = cell or (n4 == 48 and len(data) in (56 + 3 * 56, 56 + 4 * 56) and len(data) - 56 == 3 * 56)
    first = 48 if cell else n4
    end = "<" if struct.unpack_from("<i", data)[0] == first else ">"
    if struct.unpack_from(end + "i", data)[0] != first:
        raise bad("DCD: malformed record")
    box = dcd_box(struct.unpack_from(end + "6d", data, 4)) if cell else None
    at = 56 if cell else 0
    for k in range(3):
        if struct.unpack_from(end + "i", data, at + k * (n4 + 8))[0] != n4:
            raise bad("DCD: malformed coordinate record")
    xyz = np.stack([np.frombuffer(data, end + "f4", atoms, at + 4 + k * (n4 + 8)) for k in range(3)], axis=1)
    return box, xyz.astype(np.float32), None


def trr_index(read: Read, size: int) -> list[tuple[int, int, float, int]]:
    """(place, bytes, time, atoms) of the frames that have positions."""
    at, found = 0, []
    while at + 84 <= size:
        head = read(at, min(size - at, 4096))
        if struct.unpack_from(">i", head)[0] != 1993:
            raise bad("not a TRR file")
        body = 12 + (struct.unpack_from(">i", head, 8)[0] + 3) // 4 * 4
        s = struct.unpack_from(">13i", head, body)
        if s[0] or s[1] or s[5] or s[6]:
            raise bad("TRR: energy or topology blocks", "UNSUPPORTED_TRAJECTORY")
        width = trr_width(s)
        time = struct.unpack_from(">d" if width == 8 else ">f", head, body + 52)[0]
        length = body + 52 + 2 * width + s[2] + s[3] + s[4] + s[7] + s[8] + s[9]
        if at + length > size:
            break
        if s[7]:
            if found and found[0][3] != s[10]:
                raise bad("TRR: frames of different atom counts")
            found.append((at, length, float(time), s[10]))
        at += length
    if not found:
        raise bad("TRR: no complete frame", "TRUNCATED_TRAJECTORY")
    return found


def trr_width(s) -> int:
    n3 = 3 * s[10]
    width = s[2] // 9 if s[2] else next((b // n3 for b in s[7:10] if b), 4)
    if width not in (4, 8):
        raise bad("TRR: cannot tell the float size")
    return width


def trr_frame(data: bytes, atoms: int) -> tuple:
    body = 12 + (struct.unpack_from(">i", data, 8)[0] + 3) // 4 * 4
    s = struct.unpack_from(">13i", data, body)
    width = trr_width(s)
    at = body + 52 + 2 * width
    block = lambda n, place: (np.frombuffer(data, f">f{width}", n, place) * 10).astype(np.float32)
    box = block(9, at) if s[2] else None
    at += s[2] + s[3] + s[4]
    xyz = block(3 * atoms, at).reshape(-1, 3)
    v = block(3 * atoms, at + s[7]).reshape(-1, 3) if s[8] else None
    return (box.tolist() if box is not None and box.any() else None), xyz, v


def xtc_index(read: Read, size: int) -> list[tuple[int, int, float, int]]:
    """(place, bytes, time, atoms) of every whole frame; a partial last one is ignored."""
    at, found = 0, []
    while size - at >= 56:
        head = read(at, min(92, size - at))
        magic, atoms = struct.unpack_from(">2i", head)
        if magic != 1995 or atoms <= 0:
            raise bad(f"XTC: bad header of frame {len(found)}")
        if found and found[0][3] != atoms:
            raise bad("XTC: frames of different atom counts")
        if atoms <= 9:
            length = 56 + 12 * atoms
        elif len(head) < 92:
            break
        else:
            packed = struct.unpack_from(">i", head, 88)[0]
            if packed < 0:
                raise bad("XTC: negative compressed size")
            length = 92 + (packed + 3) // 4 * 4
        if at + length > size:
            break
        found.append((at, length, float(struct.unpack_from(">f", head, 12)[0]), atoms))
        at += length
    if not found:
        raise bad("XTC: no complete frame", "TRUNCATED_TRAJECTORY")
    return found


class Bits:
    """Numbers of a given width from a byte string, most significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def take(self, width: int) -> int:
        first, shift = self.at >> 3, self.at & 7
        size = (shift + width + 7) >> 3
        self.at += width
        return (int.from_bytes(self.data[first : first + size], "big") >> (8 * size - shift - width)) & ((1 << width) - 1)

    def mixed(self, width: int, sizes: tuple[int, int, int]) -> tuple[int, int, int]:
        """Three numbers below ``sizes`` that share ``width`` bits, whole bytes little end first."""
        value = shift = 0
        while width > 8:
            value |= self.take(8) << shift
            width, shift = width - 8, shift + 8
        value |= self.take(width) << shift
        value, c = divmod(value, sizes[2])
        a, b = divmod(value, sizes[1])
        return a, b, c


def xtc_frame(data: bytes, atoms: int) -> tuple:
    """(box, positions in Angstrom, None); small differences to the last atom come in runs."""
    box = (np.frombuffer(data, ">f4", 9, 16) * 10).astype(np.float32)
    box = box.tolist() if box.any() else None
    if atoms <= 9:
        return box, (np.frombuffer(data, ">f4", 3 * atoms, 56).reshape(-1, 3) * 10).astype(np.float32), None
    precision = struct.unpack_from(">f", data, 56)[0]
    low, high = struct.unpack_from(">3i", data, 60), struct.unpack_from(">3i", data, 72)
    small = struct.unpack_from(">i", data, 84)[0]
    bits = Bits(data[92 : 92 + struct.unpack_from(">i", data, 88)[0]])
    sizes = tuple(h - m + 1 for h, m in zip(high, low))
    apart = max(sizes) > 0xFFFFFF
    widths = [s.bit_length() for s in sizes]
    together = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    out = np.empty((atoms, 3), np.int64)
    i, run = 0, 0
    while i < atoms:
        here = [bits.take(w) for w in widths] if apart else bits.mixed(together, sizes)
        here = tuple(h + m for h, m in zip(here, low))
        change = 0
        if bits.take(1):
            run = bits.take(5)
            change = run % 3 - 1
            run -= run % 3
        before, rest = here, run // 3
        half, size = XTC_SIZES[small] // 2, (XTC_SIZES[small],) * 3
        # The first of a run is stored after its neighbour.
        placed = []
        for k in range(rest):
            step = bits.mixed(small, size)
            now = tuple(p + s - half for p, s in zip(before, step))
            placed.append(now)
            if k == 0:
                placed.append(before)
            before = now
        placed = placed or [here]
        if i + len(placed) > atoms:
            raise bad("XTC: more atoms than the header says")
        out[i : i + len(placed)] = placed
        i += len(placed)
        small += change
        if not XTC_FIRST <= small < len(XTC_SIZES) and change:
            raise bad("XTC: size of differences out of range")
    return box, (out * (10.0 / precision)).astype(np.float32), None


INDEX = {"dcd": dcd_index, "trr": trr_index, "xtc": xtc_index}
DECODE = {"dcd": dcd_frame, "trr": trr_frame, "xtc": xtc_frame}


def format_of(path: str, kind: str | None = None) -> str:
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in INDEX:
        raise ValueError(f"unknown trajectory format {kind!r}")
    return kind


def opened(path: str):
    """A random-access file of any file system that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _read_at(file) -> Read:
    return lambda at, n: file.read_at(n, at)


def frame_index(spark: SparkSession, path: str, kind: str | None = None, picoseconds: bool = False) -> DataFrame:
    """(file, frame, place, bytes, time, atoms) of every whole frame of the files under ``path``."""
    index = INDEX[format_of(path, kind)]
    if picoseconds and index is dcd_index:
        index = partial(dcd_index, unit=AKMA_PS)
    names = ["file", "frame", "place", "bytes", "time", "atoms"]
    files = spark.read.format("binaryFile").load(path)
    ranged = _is_ranged(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, *content in zip(*(c.to_pylist() for c in batch.columns)):
                if ranged:
                    with opened(name) as f:
                        found = index(_read_at(f), size)
                else:
                    found = index(lambda at, n, data=content[0]: data[at : at + n], size)
                cols = list(zip(*found))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(range(len(found)), pa.int32()), *map(pa.array, cols, kinds)], names)

    rows = files.select("path", "length") if ranged else files.select("path", "length", "content")
    return rows.mapInArrow(run, "file string, frame int, place long, bytes long, time double, atoms long")


def _is_ranged(path: str) -> bool:
    return (path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file") in RANGED


def _frames(spark: SparkSession, path: str, kind: str | None, picoseconds: bool, emit, schema: str) -> DataFrame:
    """Rows that ``emit`` (file, frame, time, box, positions, velocities) makes of every frame."""
    decode = DECODE[format_of(path, kind)]
    index = frame_index(spark, path, kind, picoseconds)
    if not _is_ranged(path):
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
        index = index.join(files, "file").select(*index.columns, F.expr("substring(content, CAST(place AS INT) + 1, CAST(bytes AS INT))").alias("data"))
        held = index
    else:
        # The number is given since Spark would put the few rows of an index, whatever they stand for, into one task.
        total = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length"), F.count("length")).first()
        tasks = min(MOST_TASKS, (total[0] or 0) // TASK_BYTES + max(1, total[1]))
        lot = F.floor(F.col("place") / F.lit(TASK_BYTES))
        held = index.withColumn("lot", lot).repartition(int(tasks), "file", "lot").sortWithinPartitions("file", "place").drop("lot")

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, file = None, None
        for table in tables:
            for r in table.itertuples():
                if hasattr(r, "data"):
                    data = bytes(r.data)
                else:
                    if r.file != last:
                        last, file = r.file, opened(r.file)
                    data = file.read_at(r.bytes, r.place)
                box, xyz, v = decode(data, r.atoms)
                if not np.isfinite(xyz).all():
                    raise bad(f"frame {r.frame}: a coordinate is not finite")
                yield emit(r.file, r.frame, r.time, box, xyz, v)

    return held.mapInPandas(run, schema)


def read_frames(spark: SparkSession, path: str, kind: str | None = None, velocities: bool = False, picoseconds: bool = False) -> DataFrame:
    """Frames of one or many files; the format by name or by extension.

    Positions are in Angstrom, times in picoseconds (of DCD files in the file's unit unless
    ``picoseconds``, and in steps where it has no time step);
    velocities (null where a frame has none) in Angstrom a picosecond.
    """

    def emit(file, frame, time, box, xyz, v):
        rows = {"file": file, "frame": frame, "time": time, "atom": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}
        if velocities:
            rows |= {f"v{c}": None if v is None else v[:, k] for k, c in enumerate("xyz")}
        return pd.DataFrame(rows)

    return _frames(spark, path, kind, picoseconds, emit, VELOCITY_ROWS if velocities else FRAME_ROWS)


def read_boxes(spark: SparkSession, path: str, kind: str | None = None, picoseconds: bool = False) -> DataFrame:
    """(file, frame, time, box) of the frames that have one: nine values, column-major."""

    def emit(file, frame, time, box, xyz, v):
        return pd.DataFrame({"file": [file], "frame": [frame], "time": [time], "box": [box]}).iloc[: int(box is not None)]

    return _frames(spark, path, kind, picoseconds, emit, "file string, frame int, time double, box array<double>")


def read_ccp4(spark: SparkSession, path: str, most: int = 256**3) -> DataFrame:
    """(file, i, j, k, v) of CCP4/MRC maps, x fastest in i; modes 0, 1 and 2, either byte order."""

    def run(tables):
        for table in tables:
            for file, content in zip(table["path"], table["content"]):
                data = bytes(content)
                end = "<" if 0 <= struct.unpack_from("<i", data, 12)[0] <= 6 else ">"
                nc, nr, ns, mode = struct.unpack_from(end + "4i", data)
                axes = struct.unpack_from(end + "3i", data, 64)
                extra = struct.unpack_from(end + "i", data, 92)[0]
                if mode not in (0, 1, 2) or sorted(axes) != [1, 2, 3]:
                    raise ValueError(f"{file}: unsupported map")
                if nc * nr * ns > most:
                    raise ValueError(f"{file}: more than {most} samples")
                v = np.frombuffer(data, end + {0: "i1", 1: "i2", 2: "f4"}[mode], nc * nr * ns, 1024 + extra).reshape(ns, nr, nc)
                s, r, c = np.meshgrid(*(np.arange(m) for m in (ns, nr, nc)), indexing="ij")
                at = {axes[0]: c.ravel(), axes[1]: r.ravel(), axes[2]: s.ravel()}
                yield pd.DataFrame({"file": file, "i": at[1], "j": at[2], "k": at[3], "v": v.ravel().astype(np.float32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i int, j int, k int, v float")


def validate_frames(frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rows of frames whose atom isn't in the topology; empty when all is well."""
    return frames.join(atoms.select("atom"), "atom", "left_anti")


def with_partial_frames(frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """Every atom in every frame: rows of the frame move, others keep their coordinates."""
    every = frames.select("frame").distinct().join(atoms.select("atom", *(F.col(c).alias(f"o{c}") for c in "xyz")))
    out = every.join(frames.select("frame", "atom", "x", "y", "z"), ["frame", "atom"], "left")
    return out.select("frame", "atom", *(F.coalesce(c, f"o{c}").alias(c) for c in "xyz"))
