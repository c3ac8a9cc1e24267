"""Nearest neighbours against brute force: recall, ties, copies and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.llm import nn_descent
from spindle.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>"
SMALL = {"trees": 6, "leaf": 256, "turns": 2, "degree": 32, "back": 24}


def frame(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def brute(vectors, ids, every=20, k=20):
    x = np.array(vectors, np.float32).astype(float)
    ids = np.array(ids)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    assert got.keys() == want.keys()
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_recall_on_unit_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, want = answers(nn_descent.nearest(frame(spark, x), **SMALL)), brute(x, range(len(x)))
    assert recall(got, want) > 0.95
    for q, found in got.items():
        exact = {j: float(np.float32(x[q]).astype(float) @ np.float32(x[j]).astype(float)) for j, _ in found}
        assert len(found) == 20 and found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - exact[j]) < 1e-12 for j, s in found)


def test_norms_that_differ(spark):
    """A few long vectors are nearest to most."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2_000, 16)) * np.where(np.arange(2_000) % 100 == 3, 1e4, 1.0)[:, None]
    assert recall(answers(nn_descent.nearest(frame(spark, x), **SMALL)), brute(x, range(len(x)))) > 0.9


def test_copies_ties_and_few_rows(spark):
    """Copies tie and come by id, a query's own copies among them; few candidates are all returned."""
    x = [[1.0, 0.0, 0.5]] * 45 + [[0.0, 1.0, 0.25]] * 5 + [[-1.0, 0.5, 0.0]]
    got, want = answers(nn_descent.op11(frame(spark, x))), brute(x, range(51))
    assert got == want and got[0][0] == (1, 1.25) and 0 not in [v for v, _ in got[0]]
    few = [[1.0, 2.0], [0.5, 0.25], [2.0, -1.0]]
    assert answers(nn_descent.op11(frame(spark, few, [20, 7, 40]))) == brute(few, [20, 7, 40])
    assert answers(nn_descent.op11(frame(spark, [[1.0, 2.0]], [20]))) == {}


def test_vectors_that_take_no_part(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.5], [2.0, 2.0]]
    bad = [None, [], [0.0, 0.0], [1.0, float("nan")], [float("inf"), 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    ids = [20, 1, 40, 3, 60, 80, 100, 120, 140, 160, 180]
    df = frame(spark, good + bad, ids).union(spark.createDataFrame([(None, [1.0, 1.0]), (20, [1.0, 2.0])], SCHEMA))
    clash = df.withColumns({c: F.lit(1) for c in ("node", "ids", "vec", "h", "s", "d1", "rank", "score")})
    assert answers(nn_descent.op11(clash)) == brute(good, ids[:4])
    assert nn_descent.op11(df.filter("false")).columns == ["query_id", "rank", "vec_id", "score"]
    assert nn_descent.op11(df.filter("false")).count() == 0


@pytest.mark.parametrize("leaf", [128, 4_096])
def test_queries_that_are_no_rows(spark, leaf):
    """New vectors start in the cells they fall into."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1_500, 12)).astype(np.float32)
    new = rng.normal(size=(40, 12)).astype(np.float32)
    index = nn_descent.Index(frame(spark, x), "vec_id", "embedding", 10, degree=24, trees=4, leaf=leaf, turns=2, back=16)
    asked = nn_descent.usable(frame(spark, new, range(5_000, 5_040)), "vec_id", "embedding")
    queries = stored(nn_descent.nodes_of(asked, 1).select(F.col("node").alias("q"), "vec", "d1", "d2", "h", "s"))
    got = answers(nn_descent.neighbours(index, queries))
    want = {5_000 + i: [(int(j), 0) for j in np.argsort(-(x.astype(float) @ v.astype(float)))[:10]] for i, v in enumerate(new)}
    assert recall(got, want) > 0.9
