"""CCP4/MRC maps by slabs: headers with the cell's affine, samples by ranges of rows, stored volumes in spatial order.

A header is 1,024 bytes of a file, read by one task a file; samples are read by tasks of at most ``task_bytes`` that each fetch their own rows of
the file, so neither a map nor one of its sections needs to fit a task. Files are read by
ranges (see ``trajectory.RANGED``); ``trajectory.read_ccp4`` reads whole files of other systems.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.volume import Grid
from . import trajectory as T
from .pqr import IoError

HEADER = (
    "file string, nx int, ny int, nz int, transform array<double>, columns long, rows long, sections long, axes array<int>, "
    "mode int, little boolean, place long, width int, scale double, shift double"
)
SAMPLES = "file string, i int, j int, k int, v float"
#: Fixed values of the format: bytes of a sample by mode, and its type.
WIDTHS = {0: 1, 1: 2, 2: 4}
TYPES = {0: "i1", 1: "i2", 2: "f4"}
#: Samples of one batch of rows.
BATCH = 1 << 18


def cell_matrix(lengths, angles) -> np.ndarray:
    """Columns are the cell's edges; the first along x, the second in the xy plane."""
    box = T.box_matrix(*(float(v) for v in (*lengths, *angles)))
    return np.array(box).reshape(3, 3).T


def parse_header(data: bytes, size: int, most: int | None = None) -> dict:
    """A header's fields and the column-major affine from sample index to world.

    ``size`` is the file's length. Where ORIGIN is nonzero it takes the place of the start indices.
    """
    if len(data) < 1024:
        raise IoError("INVALID_MAP", "shorter than the header")
    if data[208:211] != b"MAP":
        raise IoError("INVALID_MAP", "no MAP marker")
    stamp = data[212:214]
    little = stamp == b"\x44\x41" or (stamp != b"\x11\x11" and struct.unpack_from("<i", data, 12)[0] <= 16)
    e = "<" if little else ">"
    word = struct.unpack_from(e + "56i", data)
    real = struct.unpack_from(e + "56f", data)
    dims, mode, starts, grid, axes = word[0:3], word[3], word[4:7], word[7:10], word[16:19]
    if min(dims) < 1:
        raise IoError("INVALID_MAP", "dimensions must be positive")
    if sorted(axes) != [1, 2, 3]:
        raise IoError("INVALID_MAP", "axes must be a permutation of 1, 2, 3")
    scaled = word[39] == -128 and word[40] == 127
    if not scaled and mode not in WIDTHS:
        raise IoError("UNSUPPORTED_MODE", f"mode {mode}")
    if most is not None and math.prod(dims) > most:
        raise IoError("VOLUME_TOO_LARGE", f"{math.prod(dims)} samples, more than {most}")
    if min(grid) < 1 or not all(math.isfinite(v) and v > 0 for v in real[10:16]):
        raise IoError("INVALID_MAP", "no cell")
    width, place = 1 if scaled else WIDTHS[mode], 1024 + max(0, word[23])
    if size < place + math.prod(dims) * width:
        raise IoError("INVALID_MAP", "truncated")
    by_axis = lambda values: [values[axes.index(a)] for a in (1, 2, 3)]
    grid = np.array(grid, float)
    origin = np.array(real[49:52], float)
    first = origin / (np.array(real[10:13], float) / grid) if origin.any() else np.array(by_axis(starts), float)
    step = cell_matrix(real[10:13], real[13:16]) / grid
    affine = np.eye(4)
    affine[:3, :3], affine[:3, 3] = step, step @ first
    if not np.isfinite(affine).all() or abs(np.linalg.det(step)) < 1e-12:
        raise IoError("INVALID_MAP", "the cell has no volume")
    # Bytes that stand for the range from the header's least to its greatest value.
    scale = (real[20] - real[19]) / 255 if scaled else 1.0
    shift = (real[19] + real[20] + scale) / 2 if scaled else 0.0
    nx, ny, nz = by_axis(dims)
    return {
        "nx": nx, "ny": ny, "nz": nz, "transform": affine.T.ravel().tolist(), "columns": dims[0], "rows": dims[1], "sections": dims[2], "axes": list(axes),
        "mode": 0 if scaled else mode, "little": little, "place": place, "width": width, "scale": float(scale), "shift": float(shift),
    }


def read_headers(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """One row a map under ``path``: dimensions, affine and where its samples are; maps of over ``most`` samples are refused."""
    if not T._is_ranged(path):
        raise IoError("UNSUPPORTED_FILE_SYSTEM", path)

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for file, size in zip(table["path"], table["length"]):
                with T.opened(file) as f:
                    try:
                        yield pd.DataFrame([{"file": file, **parse_header(f.read_at(min(size, 1024), 0), size, most)}])
                    except IoError as e:
                        raise IoError(e.code, f"{file}: {e}") from None

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(run, HEADER)


def grid_of(header) -> Grid:
    """The grid of a header's row."""
    return Grid((header["nx"], header["ny"], header["nz"]), tuple(header["transform"]))


def slabs(headers: DataFrame, task_bytes: int = T.TASK_BYTES) -> DataFrame:
    """The headers' rows once per slab: rows ``first`` to ``last`` (excluded) of the file's ``rows * sections``."""
    per = F.greatest(F.lit(1), F.floor(F.lit(task_bytes) / (F.col("columns") * F.col("width")))).cast("long")
    every = F.col("rows") * F.col("sections")
    out = headers.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), every - 1, per)))
    return out.withColumn("last", F.least(F.col("first") + per, every))


def read_slabs(spark: SparkSession, path: str, task_bytes: int = T.TASK_BYTES, most: int | None = None) -> DataFrame:
    """(file, i, j, k, v) of every sample of the maps under ``path``, indices along the cell's axes."""
    cut = slabs(read_headers(spark, path, most), task_bytes)
    tasks = min(T.MOST_TASKS, max(1, cut.count()))

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for r in table.itertuples():
                kind = np.dtype(("<" if r.little else ">") + TYPES[r.mode])
                lines = max(1, BATCH // r.columns)
                with T.opened(r.file) as f:
                    for at in range(r.first, r.last, lines):
                        n = min(lines, r.last - at)
                        data = f.read_at(n * r.columns * r.width, r.place + at * r.columns * r.width)
                        v = np.frombuffer(data, kind).astype(np.float32)
                        if r.scale != 1.0 or r.shift:
                            v = (v * r.scale + r.shift).astype(np.float32)
                        line = at + np.repeat(np.arange(n), r.columns)
                        along = {r.axes[0]: np.tile(np.arange(r.columns), n), r.axes[1]: line % r.rows, r.axes[2]: line // r.rows}
                        yield pd.DataFrame({"file": r.file, "i": along[1], "j": along[2], "k": along[3], "v": v})

    # By number, or Spark would put the few rows that stand for slabs into one task.
    return cut.repartition(tasks, "file", "first").mapInPandas(run, SAMPLES)


def store_volume(samples: DataFrame, out: str, side: int = 16, files: int | None = None) -> None:
    """Write samples as a table in order of bricks of ``side`` samples a side, so that boxes of them are few row groups."""
    ordered = samples.withColumn("brick", spatial.morton([F.expr(f"{c} div {side}") for c in "ijk"], 16))
    keys = [c for c in ("file",) if c in samples.columns] + ["brick"]
    held = ordered.repartitionByRange(files, *keys) if files else ordered.repartitionByRange(*keys)
    held.sortWithinPartitions(*keys, "k", "j", "i").write.mode("overwrite").parquet(out)


def around(samples: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """The samples in the index box of all points that lie in the grid; on a stored volume the scan skips the other row groups.

    Enough for trilinear sampling at these points. None where no point lies in the grid.
    """
    u = grid.to_index(*(F.col(c).cast("double") for c in "xyz"))
    inside = F.lit(True)
    for c, n in zip(u, grid.dims):
        inside = inside & (c >= -1) & (c <= n)
    bounds = points.filter(inside).agg(*(f(F.floor(c)).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k, c in zip("ijk", u))).first()
    if bounds["lowi"] is None:
        return samples.filter(F.lit(False))
    # Numbers of the columns' own type, so that the scan gets them.
    for c in "ijk":
        samples = samples.filter(F.col(c).between(F.lit(int(bounds[f"low{c}"]) - 1), F.lit(int(bounds[f"high{c}"]) + 2)))
    return samples
