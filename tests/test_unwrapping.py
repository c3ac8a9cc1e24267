"""Unwrapping against a walk from atom to atom; rings, boxes, recentring."""

import numpy as np

from spindle.operators import unwrapping

FRAME = "frame int, atom long, x double, y double, z double"
BOX = "frame int, box array<double>"


def walked(x, edges, box):
    """Breadth first from the least atom of each component."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b), near.setdefault(b, []).append(a)
    out, inverse = {}, np.linalg.inv(box)
    for root in sorted(x):
        if root in out:
            continue
        out[root] = x[root]
        queue = [root]
        for n in queue:
            for m in near.get(n, ()):
                if m not in out:
                    d = x[m] - x[n]
                    around = np.stack(np.meshgrid(*[np.arange(-2, 3)] * 3, indexing="ij"), -1).reshape(-1, 3) - np.round(d @ inverse)
                    images = d + around @ box
                    out[m] = out[n] + images[(images**2).sum(1).argmin()]
                    queue.append(m)
    return out


def frames_of(spark, frames):
    return spark.createDataFrame([(f, a, *map(float, p)) for f, x in frames.items() for a, p in x.items()], FRAME).repartition(3)


def test_equals_a_walk(spark):
    rng = np.random.default_rng(5)
    boxes = {0: np.diag([10.0, 9, 8]), 1: np.array([[10.0, 0, 0], [3, 9, 0], [2, 1, 8]])}
    edges = [(i, i + 1) for i in range(40)] + [(50, 90), (90, 60), (60, 55), (55, 99)] + [(i, 120) for i in range(121, 130)]
    atoms = sorted({a for e in edges for a in e}) + [200]
    frames = {}
    for f, box in boxes.items():
        whole = {a: rng.normal(0, 1, 3) + 5 for a in atoms}
        for a, b in edges:
            whole[b] = whole[a] + rng.normal(0, 0.8, 3)
        frames[f] = {a: (lambda u: (u - np.floor(u)) @ box)(p @ np.linalg.inv(box)) for a, p in whole.items()}
    out = unwrapping.unwrap_frames(frames_of(spark, frames), spark.createDataFrame(edges + edges[:2] + [(3, 3)], "a long, b long"), spark.createDataFrame([(f, b.ravel().tolist()) for f, b in boxes.items()], BOX))
    got = {(r["frame"], r["atom"]): np.array([r["x"], r["y"], r["z"]]) for r in out.positions.collect()}
    for f, box in boxes.items():
        want = walked(frames[f], edges, box)
        assert all(np.allclose(got[f, a], want[a]) for a in atoms)
    assert {(r["frame"], r["status"]) for r in out.status.collect()} == {(0, "ok"), (1, "ok")}


def test_a_long_chain(spark):
    n = 100_000
    rng = np.random.default_rng(6)
    steps = rng.uniform(-2, 2, (n, 3))
    whole = np.cumsum(steps, 0)
    wrapped = whole % 10.0
    df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(wrapped.tolist())], FRAME)
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    out = unwrapping.unwrap_frames(df, edges, spark.createDataFrame([(0, [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0])], BOX)).positions.toPandas().sort_values("atom")
    assert np.allclose(out[["x", "y", "z"]].to_numpy(), whole - whole[0] + wrapped[0], atol=1e-6)
    assert set(out["component"]) == {0}


def test_rings_boxes_and_centres(spark):
    ring = {0: (1.0, 1, 1), 1: (4.5, 1, 1), 2: (8.0, 1, 1)}  # closes around the cell
    fine = {0: (0.5, 1, 1), 1: (9.5, 1, 1), 2: (9.9, 2, 1)}
    frames = frames_of(spark, {0: ring, 1: fine, 2: fine, 3: fine})
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "a long, b long")
    boxes = spark.createDataFrame([(0, [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0]), (1, [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0]), (2, [0.0] * 9)], BOX)
    out = unwrapping.unwrap_frames(frames, edges, boxes)
    assert {r["frame"]: (r["status"], r["ambiguous"]) for r in out.status.collect()} == {0: ("ambiguous", 1), 1: ("ok", 0), 2: ("invalid-box", 0), 3: ("missing-box", 0)}
    at = {(r["frame"], r["atom"]): r["x"] for r in out.positions.collect()}
    assert np.allclose([at[1, k] for k in range(3)], [0.5, -0.5, -0.1]) and np.allclose([at[2, k] for k in range(3)], [0.5, 9.5, 9.9])
    moved = unwrapping.unwrap_frames(frames, edges, boxes, spark.createDataFrame([(1,), (2,)], "atom long"))
    at = {(r["frame"], r["atom"]): r["x"] for r in moved.positions.collect()}
    assert np.allclose([at[1, k] for k in range(3)], [10.5, 9.5, 9.9])


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    """Chains, branches and rings over blocks of few atoms, of ids far apart; a chain takes joins between its blocks only."""
    rng = np.random.default_rng(9)
    ids = sorted({int(v) for v in rng.integers(0, 1 << 50, 300)}) + [0, 1, 2]
    edges = [(ids[i], ids[i + 1]) for i in range(200)] + [(ids[int(rng.integers(k))], ids[k]) for k in range(210, 290)]
    box = np.diag([10.0, 9.0, 8.0])
    place = {a: rng.uniform(0, 1, 3) @ box for a in ids}
    df, tables = frames_of(spark, {0: place, 1: place}), spark.createDataFrame([(f, box.ravel().tolist()) for f in (0, 1)], BOX)
    want = walked(place, edges, box)
    for size in (7, 1_000_000):
        monkeypatch.setattr(unwrapping, "BLOCK", size)
        seen = []
        own = unwrapping.potentials
        monkeypatch.setattr(unwrapping, "potentials", lambda n, e: seen.append(e.count()) or own(n, e))
        out = unwrapping.unwrap_frames(df, spark.createDataFrame(edges, "a long, b long"), tables)
        got = {(r["frame"], r["atom"]): (r["x"], r["y"], r["z"]) for r in out.positions.collect()}
        monkeypatch.setattr(unwrapping, "potentials", own)
        assert len(got) == 2 * len(place) and all(np.allclose(got[f, a], want[a]) for f, a in got)
        assert {r["status"] for r in out.status.collect()} == {"ok"}
        assert seen[0] < 2 * len(edges) if size == 7 else seen[0] == 0
