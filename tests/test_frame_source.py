"""Frames through the data source: partitions that are opened, selections, growing files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.sources import frame_source as S
from spindle.sources import trajectory as T

from .test_trajectory import dcd, trr

RNG = np.random.default_rng(11)


def frames(n, atoms=6):
    return [RNG.normal(0, 9, (atoms, 3)).astype(np.float32) for _ in range(n)]


def opened(df):
    return df.rdd.getNumPartitions()


def rows(df):
    return sorted((r["frame"], r["atom"], r["x"], r["y"], r["z"]) for r in df.collect())


@pytest.mark.parametrize("end", ["<", ">"])
def test_one_frame_of_many_opens_one_partition(spark, tmp_path, end):
    f = frames(10_000)
    path = str(tmp_path / "a.dcd")
    (tmp_path / "a.dcd").write_bytes(dcd(f, end=end, cell=[20, 0, 21, 0, 0, 22]))
    every, one = S.scan_frames(spark, path, task_bytes=100_000), S.scan_frames(spark, path, 7321, task_bytes=100_000)
    assert opened(every) > 10 and opened(one) == 1
    want = lambda *at: [(k, a, *map(float, f[k][a])) for k, a in at]
    assert rows(one) == want(*((7321, a) for a in range(6)))
    assert rows(S.scan_frames(spark, path, 7321, range(2, 4))) == want((7321, 2), (7321, 3))
    assert rows(S.scan_frames(spark, path, [9999, 3], [5, 1])) == want((3, 1), (3, 5), (9999, 1), (9999, 5))
    assert rows(every.filter("frame < 2 AND x > 0")) == [r for r in want(*((k, a) for k in range(2) for a in range(6))) if r[2] > 0]
    assert every.count() == 60_000
    assert S.scan_frames(spark, path, 10_000).count() == S.scan_frames(spark, path, [0], [99]).count() == S.scan_frames(spark, path, []).count() == 0


def test_same_rows_as_the_plain_reader(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k in range(3):
        (tmp_path / "t" / f"{k}.trr").write_bytes(trr(frames(5), empty=(1,)))
    (tmp_path / "t" / "notes.txt").write_text("not a trajectory")
    got = S.scan_frames(spark, str(tmp_path / "t"), kind="trr", velocities=True)
    want = T.read_frames(spark, str(tmp_path / "t" / "*.trr"), "trr", velocities=True)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    S.store_index(spark, str(tmp_path / "t" / "*.trr"), str(tmp_path / "index"), "trr")
    held = S.scan_frames(spark, str(tmp_path / "t"), kind="trr", velocities=True, index=str(tmp_path / "index"))
    assert held.exceptAll(want).isEmpty() and want.exceptAll(held).isEmpty()
    for index in ({}, {"index": str(tmp_path / "index")}):
        part = S.scan_frames(spark, str(tmp_path / "t"), range(3), times=(3, None), kind="trr", **index).select("file", "frame").distinct()
        assert part.exceptAll(want.filter("time >= 3 AND frame < 3").select("file", "frame").distinct()).isEmpty() and part.count() == 6


def test_a_stream_hands_out_each_whole_frame_once(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    f, g = frames(6), frames(4)
    whole = trr(f, velocities=False)
    size = len(whole) // 6
    (place / "a.trr").write_bytes(whole[: 2 * size + 40])

    def run():
        q = S.stream_frames(spark, str(place)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [(r["frame"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("file", "frame").agg(F.count("*").alias("n")).orderBy("file", "frame").collect()]

    assert run() == [(0, 6), (1, 6)]
    (place / "a.trr").write_bytes(whole)
    (place / "b.dcd").write_bytes(dcd(g))
    assert run() == [(k, 6) for k in range(6)] + [(k, 6) for k in range(4)]
    assert run() == [(k, 6) for k in range(6)] + [(k, 6) for k in range(4)]
    got = spark.read.parquet(str(tmp_path / "out")).filter("file LIKE '%a.trr'")
    assert np.allclose([r[2:] for r in rows(got)], np.concatenate(f), atol=1e-5)


def test_refusals(spark, tmp_path):
    with pytest.raises(Exception, match="no such file"):
        S.scan_frames(spark, str(tmp_path / "none.dcd")).count()
    (tmp_path / "short.dcd").write_bytes(dcd(frames(1))[:120])
    with pytest.raises(Exception, match="no complete frame"):
        S.scan_frames(spark, str(tmp_path / "short.dcd")).count()
    with pytest.raises(Exception, match="not a selection"):
        spark.read.format(S.NAME).option("frames", "3:x").load(str(tmp_path / "short.dcd")).count()
    with pytest.raises(Exception, match="task_bytes"):
        S.scan_frames(spark, str(tmp_path / "short.dcd"), task_bytes=0).count()
