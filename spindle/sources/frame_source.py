"""Trajectory files as a Spark data source: partitions of frames, selections that skip frames and atoms, streams of growing files.

``register`` makes the format ``spindle_frames`` known; options are ``path`` (a file, or a folder whose
files of the format are read), ``kind`` (by default the extension), ``velocities``,
``picoseconds``, ``index`` (a table from ``store_index``) and ``task_bytes``.

Selections are options of a load: ``frames`` and ``atoms`` as ``"3,7,20:40"`` (stops excluded), ``times`` as
``"from:to"`` (both included; either may be missing). Frames outside them open no partition, and of DCD frames only the part from
the first to the last wanted atom is read. They are not taken from ``filter``: Spark 4.1 keeps the filters that it hands
to a Python source with the loaded table, so that a second query of one DataFrame would see those of the first.
Without a stored index the planner walks the frame headers (of DCD files it computes them); for many or long files
store the index, which takes a task a file.

Streams hand out each whole frame once, in order of the file. Files may grow and appear; a file that has
become shorter is an error. The offset holds one entry a file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from . import trajectory as T
from .pqr import IoError

NAME = "spindle_frames"
#: Rows of one Arrow batch.
BATCH = 1 << 20


def written(wanted: int | Iterable[int]) -> str:
    """Numbers as text: ``"3,7,20:40"``; consecutive ones become a range."""
    if isinstance(wanted, range) and wanted.step == 1:
        return f"{wanted.start}:{max(wanted.start, wanted.stop)}"
    numbers = np.unique(np.atleast_1d(np.array([wanted] if isinstance(wanted, int) else list(wanted), np.int64)))
    runs = np.split(numbers, np.flatnonzero(np.diff(numbers) != 1) + 1) if len(numbers) else []
    return ",".join(f"{r[0]}:{r[-1] + 1}" for r in runs) or "0:0"


def ranges(text: str | None) -> list[tuple[int, int]] | None:
    """(first, stop) of each part of such a text; None where all are wanted."""
    if text is None:
        return None
    out = []
    for part in text.split(","):
        first, colon, stop = part.strip().partition(":")
        if not first.isdigit() or (colon and not stop.isdigit()):
            raise ValueError(f"not a selection: {text!r}")
        out.append((int(first), int(stop) if colon else int(first) + 1))
    return out


def within(column: np.ndarray, wanted: list[tuple[int, int]] | None) -> np.ndarray:
    mask = np.full(len(column), wanted is None)
    for first, stop in wanted or ():
        mask |= (column >= first) & (column < stop)
    return mask


def listed(path: str, kind: str | None) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder's files of the format; local names as Spark writes them."""
    local = path.startswith("file:") or "://" not in path
    plain = "/" + path[5:].lstrip("/") if path.startswith("file:") else os.path.abspath(path) if local else path
    where, name = fs.FileSystem.from_uri(plain)
    head = "file:" if local else path[: path.index("://") + 3] if where.type_name == "s3" else path[: len(path) - len(name)]
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise T.bad(f"no such file: {path}", "MISSING_TRAJECTORY")
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name, recursive=True))
    ends = f".{kind}" if kind else tuple(f".{k}" for k in T.INDEX)
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or f.path.lower().endswith(ends)))


@dataclass
class Lot(ds.InputPartition):
    """Frames of one file that one task reads: (frame, place, bytes, time) columns."""

    file: str
    kind: str
    atoms: int
    frames: list
    places: list
    sizes: list
    times: list


def lots(file: str, kind: str, index: dict[str, np.ndarray], task_bytes: int) -> Iterator[Lot]:
    """The index cut by bytes of frames that are read, whole frames each."""
    if not len(index["frame"]):
        return
    cut = (np.cumsum(index["bytes"]) - index["bytes"]) // task_bytes
    for _, at in sorted({c: np.flatnonzero(cut == c) for c in np.unique(cut)}.items()):
        columns = [index[c][at].tolist() for c in ("frame", "place", "bytes", "time")]
        yield Lot(file, kind, int(index["atoms"][at[0]]), *columns)


def walked(file: str, size: int, kind: str, picoseconds: bool, first: int = 0, at: int = 0) -> dict[str, np.ndarray]:
    """Frames from number ``first``, which starts at byte ``at`` of an XTC or TRR file; none where no whole one follows."""
    with T.opened(file) as f:
        shift = 0 if kind == "dcd" else at
        index = partial(T.dcd_index, unit=T.AKMA_PS) if picoseconds and kind == "dcd" else T.INDEX[kind]
        try:
            found = index(lambda place, n: f.read_at(n, place + shift), size - shift)
        except IoError as e:
            if e.code != "TRUNCATED_TRAJECTORY":
                raise
            found = []
        except struct.error:  # the header itself is not whole yet
            found = []
    if kind == "dcd":
        found = found[first:]
    place, length, time, atoms = zip(*found) if found else ((), (), (), ())
    out = {"place": np.array(place, np.int64) + shift, "bytes": np.array(length, np.int64), "time": np.array(time, float), "atoms": np.array(atoms, np.int64)}
    return out | {"frame": first + np.arange(len(found), dtype=np.int64)}


def dcd_part(file, place: int, size: int, atoms: int, low: int, high: int) -> np.ndarray:
    """Positions of atoms ``low`` to ``high`` of a DCD frame, read from the three coordinate records alone."""
    length = 8 + 4 * atoms
    at = place + (56 if size - 56 in (3 * length, 4 * length) else 0)
    out = np.empty((high - low, 3), np.float32)
    for k in range(3):
        record = at + k * length
        mark = file.read_at(4, record)
        end = next((e for e in "<>" if struct.unpack(e + "i", mark)[0] == 4 * atoms), None)
        if end is None:
            raise T.bad("DCD: malformed coordinate record")
        out[:, k] = np.frombuffer(file.read_at(4 * (high - low), record + 4 + 4 * low), end + "f4")
    return out


def batches(lot: Lot | None, velocities: bool, wanted: list[tuple[int, int]] | None) -> Iterator[pa.RecordBatch]:
    """Rows of the wanted atoms in a lot's frames."""
    if lot is None or not lot.frames:
        return
    atoms = np.flatnonzero(within(np.arange(lot.atoms, dtype=np.int64), wanted))
    if not len(atoms):
        return
    low, high = int(atoms[0]), int(atoms[-1]) + 1
    # With 12 atoms a cell record is as long as a coordinate record; such frames are read whole.
    part = lot.kind == "dcd" and lot.atoms != 12 and high - low < lot.atoms
    with T.opened(lot.file) as file:
        for frame, place, size, time in zip(lot.frames, lot.places, lot.sizes, lot.times):
            if part:
                xyz, v = dcd_part(file, place, size, lot.atoms, low, high)[atoms - low], None
            else:
                _, xyz, v = T.DECODE[lot.kind](file.read_at(size, place), lot.atoms)
                xyz, v = xyz[atoms], v[atoms] if v is not None else None
            if not np.isfinite(xyz).all():
                raise T.bad(f"frame {frame}: a coordinate is not finite")
            for i in range(0, len(atoms), BATCH):
                held = slice(i, i + BATCH)
                n = len(atoms[held])
                columns = {"file": pa.array([lot.file] * n), "frame": pa.array(np.full(n, frame, np.int32)), "time": pa.array(np.full(n, time)), "atom": pa.array(atoms[held])}
                columns |= {c: pa.array(np.ascontiguousarray(xyz[held, k], np.float32)) for k, c in enumerate("xyz")}
                if velocities:
                    none = pa.nulls(n, pa.float32())
                    columns |= {f"v{c}": none if v is None else pa.array(np.ascontiguousarray(v[held, k], np.float32)) for k, c in enumerate("xyz")}
                yield pa.RecordBatch.from_pydict(columns)


class FrameSource(ds.DataSource):
    """Rows (file, frame, time, atom, x, y, z), and (vx, vy, vz) with ``velocities``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return T.VELOCITY_ROWS if _flag(self.options, "velocities") else T.FRAME_ROWS

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(dict(self.options))


def _flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class _Options:
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.kind, self.index = options["path"], options.get("kind"), options.get("index")
        self.velocities, self.picoseconds = _flag(options, "velocities"), _flag(options, "picoseconds")
        self.task_bytes = int(options.get("task_bytes", T.TASK_BYTES))
        if self.task_bytes < 1:
            raise ValueError("task_bytes must be positive")
        self.frames, self.atoms = ranges(options.get("frames")), ranges(options.get("atoms"))
        first, _, last = options.get("times", ":").partition(":")
        self.times = float(first or "-inf"), float(last or "inf")

    def selected(self, index: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        mask = within(index["frame"], self.frames) & (index["time"] >= self.times[0]) & (index["time"] <= self.times[1])
        return {c: v[mask] for c, v in index.items()}


class FrameReader(_Options, ds.DataSourceReader):
    def partitions(self) -> list[Lot]:
        return [lot for file, kind, index in self._indexes() for lot in lots(file, kind, self.selected(index), self.task_bytes)]

    def _indexes(self) -> Iterator[tuple[str, str, dict[str, np.ndarray]]]:
        if self.index:
            yield from _stored(self.index, self.kind, self.frames)
            return
        for file, size in listed(self.path, self.kind):
            kind = T.format_of(file, self.kind)
            index = walked(file, size, kind, self.picoseconds)
            if not len(index["frame"]):
                raise T.bad(f"{file}: no complete frame", "TRUNCATED_TRAJECTORY")
            yield file, kind, index

    def read(self, partition: Lot | None) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.velocities, self.atoms)


def _stored(path: str, kind: str | None, frames: list[tuple[int, int]] | None) -> Iterator[tuple[str, str, dict[str, np.ndarray]]]:
    """Frames of a stored index, a file at a time; the selected numbers skip its row groups."""
    where, name = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    table = pyarrow.dataset.dataset(name, filesystem=where, format="parquet")
    field, test = pyarrow.dataset.field("frame"), None
    if frames is not None:
        test = (field >= min(f for f, _ in frames)) & (field < max(s for _, s in frames))
    rows = table.to_table(filter=test)
    for file in sorted(rows["file"].unique().to_pylist()):
        part = rows.filter(pc.equal(rows["file"], file)).sort_by("frame")
        yield file, T.format_of(file, kind), {c: part[c].to_numpy() for c in ("frame", "place", "bytes", "time", "atoms")}


class FrameStream(_Options, ds.DataSourceStreamReader):
    """Offsets: {file: {"frames": whole frames seen, "end": the byte after them}}."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.seen: dict[str, dict[str, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.seen)
        for file, size in listed(self.path, self.kind):
            before = out.get(file, {"frames": 0, "end": 0})
            if size < before["end"]:
                raise T.bad(f"{file} has become shorter")
            index = walked(file, size, T.format_of(file, self.kind), self.picoseconds, before["frames"], before["end"])
            if len(index["frame"]):
                out[file] = {"frames": int(index["frame"][-1]) + 1, "end": int(index["place"][-1] + index["bytes"][-1])}
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        out = []
        for file, upto in sorted(end.items()):
            since = start.get(file, {"frames": 0, "end": 0})
            if upto["frames"] > since["frames"]:
                kind = T.format_of(file, self.kind)
                index = walked(file, upto["end"], kind, self.picoseconds, since["frames"], since["end"])
                out += lots(file, kind, self.selected(index), self.task_bytes)
        return out

    def read(self, partition: Lot | None) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.velocities, self.atoms)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(FrameSource)


def store_index(spark: SparkSession, path: str, out: str, kind: str | None = None, picoseconds: bool = False) -> None:
    """Write the frame index of the files under ``path`` as a table, one task a file."""
    T.frame_index(spark, path, kind, picoseconds).sortWithinPartitions("file", "frame").write.mode("overwrite").parquet(out)


def _options(frames, atoms, times, options) -> dict[str, str]:
    out = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    out |= {k: written(v) for k, v in (("frames", frames), ("atoms", atoms)) if v is not None}
    if times is not None:
        out["times"] = ":".join("" if t is None else repr(float(t)) for t in times)
    return out


def scan_frames(spark: SparkSession, path: str, frames=None, atoms=None, times: tuple | None = None, **options) -> DataFrame:
    """Frames of the files under ``path``: all, or those of the numbers ``frames`` and ``atoms`` and between ``times``."""
    register(spark)
    return spark.read.format(NAME).options(**_options(frames, atoms, times, options)).load(path)


def stream_frames(spark: SparkSession, path: str, frames=None, atoms=None, times: tuple | None = None, **options) -> DataFrame:
    """A stream of the whole frames that files under ``path`` gain, selected likewise."""
    register(spark)
    return spark.readStream.format(NAME).options(**_options(frames, atoms, times, options)).load(path)
