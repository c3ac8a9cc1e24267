"""Pairs by blocks against all pairs; budget, dense places, odd points."""

import numpy as np
import pytest

from spindle.operators import blocks, spatial

SCHEMA = "atom long, x double, y double, z double"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(x)], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [1_024, 37])
def test_equals_all_pairs(spark, rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(-40, 40, (400, 3)), rng.normal(0, 0.3, (200, 3)), [[1e6, 0, 0], [1e6, 1, 0], [5.0, 5, 5], [5.0, 5, 5]]])
    y = np.concatenate([rng.uniform(-40, 40, (300, 3)), rng.normal(0, 0.3, (100, 3)), [[1e6, 0.5, 0]]])
    odd = spark.createDataFrame([(9_000, None, 0.0, 0.0), (9_001, float("nan"), 0.0, 0.0), (9_002, 0.0, float("inf"), 0.0)], SCHEMA)
    got = blocks.near_by_blocks(frame(spark, x).union(odd), frame(spark, y, 10_000), 3.0, rows=rows).collect()
    d2 = ((x[:, None] - y[None]) ** 2).sum(2)
    want = {(int(i), 10_000 + int(j)) for i, j in zip(*np.nonzero(d2 <= 9.0))}
    assert len(got) == len(want) and {(r["l"], r["r"]) for r in got} == want
    assert all(abs(r["d2"] - d2[r["l"], r["r"] - 10_000]) < 1e-9 for r in got)


def test_budget_and_empty_sides(spark):
    rng = np.random.default_rng(4)
    one = frame(spark, rng.uniform(0, 100, (500, 3)))
    with pytest.raises(spatial.PairLimitError):
        blocks.near_by_blocks(one, one, 5.0, budget=500, rows=20)
    assert blocks.near_by_blocks(one, one, 5.0, budget=250_000, rows=20).count() >= 500
    assert blocks.near_by_blocks(one.filter("atom < 0"), one, 5.0).isEmpty()
    with pytest.raises(ValueError):
        blocks.near_by_blocks(one, one, 0.0)
