"""Components of links: settled lot by lot, or by rounds where more than a lot is left."""

import random

import numpy as np
import pytest

from spindle.llm import common

RNG = random.Random(31)


def by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in {x for a, b in links if a != b for x in (a, b)}}


def graph(n):
    nodes = [RNG.randrange(-(1 << 62), 1 << 62) for _ in range(n)]
    chain = list(zip(nodes[: n // 3], nodes[1 : n // 3]))
    rest = [(RNG.choice(nodes), RNG.choice(nodes)) for _ in range(n // 4)]
    links = chain + rest + chain[:5] + [(b, a) for a, b in chain[:5]] + [(nodes[0], nodes[0])]
    RNG.shuffle(links)
    return links


@pytest.mark.parametrize("lot", [common.LOT, 40, 2])
def test_components_by_hand(spark, lot):
    links = graph(600)
    got = common.components(spark.createDataFrame(links, "a long, b long").repartition(7), lot).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == by_hand(links)
    assert common.components(spark.createDataFrame([], "a long, b long"), lot).isEmpty()


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    """One pass of the tasks over their links and one over what they leave (a chain of 200 took several rounds of joins before)."""
    made, plain = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: made.append(df) or plain(df))
    links = [(i, i + 1) for i in range(200)]
    RNG.shuffle(links)
    got = common.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r["node"]: r["component"] for r in got} == dict.fromkeys(range(201), 0)
    assert len(made) == 2


def test_least_of_cycles_and_chains():
    u, v = np.array([5, 4, 3, 9, 8, -1]), np.array([4, 3, 5, 8, 9, -7])
    nodes, least = common.least_of(u, v)
    assert dict(zip(nodes.tolist(), least.tolist())) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, -1: -7, -7: -7}
