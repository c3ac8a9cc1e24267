"""What round 4's findings named, each on a small input that went wrong before."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.functions import js
from spindle.llm import compact_windows as cw
from spindle.operators import gasteiger, graph
from spindle.plans.catalog import QUERIES

from .test_gasteiger import nothing, structure
from .test_findings_r03 import agrees, copied

QUANTITIES = {
    "fractions": "l_quantity + l_extendedprice % 1 * 1.000123457",
    "tiny": "l_quantity * 1e-9",
    "huge": "l_quantity * 1e19",
    "nulls": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END",
    "nan": "CASE WHEN l_partkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END",
    "zero": "l_quantity - 1",
    "negative": "-l_quantity",
}


@pytest.mark.parametrize("kind", QUANTITIES)
def test_f3_quantities_of_any_kind(spark, tmp_path, kind):
    """The SQL rounds four columns of seven, divides to infinity at every first residue and leaves a NaN out of least()."""
    folder = copied(tmp_path, {"lineitem": f"SELECT * REPLACE ({QUANTITIES[kind]} AS l_quantity) FROM t"})
    agrees(spark, "expr_math", folder)


def test_null_by_zero_is_null(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 0.0D AS y").select(js.div(F.col("x"), F.col("y"))).first()
    assert row[0] is None


def shuffled(spark) -> int:
    """Bytes that the session's stages have written for shuffles."""
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_f2_atoms_move_a_few_times(spark):
    """Each atom of 60,000 and its bonds took 1,000 bytes of shuffles."""
    before = shuffled(spark)
    out = QUERIES["gasteiger_charges"](spark, "/root/testdata/sf0.01")
    assert out.count() == 60_000
    assert 0 < shuffled(spark) - before < 500 * 60_000


@pytest.mark.parametrize("scattered", [False, True])
def test_f2_components_by_ranges(spark, scattered):
    """Ids of a component may be neighbours or not; lots of a few links settle what they can."""
    rng = random.Random(4)
    nodes = list(range(-300, 900))
    if scattered:
        rng.shuffle(nodes)
    at = [(nodes[i], nodes[i + rng.randint(1, 3)]) for i in range(len(nodes) - 3) if rng.random() < 0.8] + [(5, 5), (899, 898)]
    edges = spark.createDataFrame(at, "a long, b long")
    rows = lambda df: sorted(map(tuple, df.select("node", "component").collect()))
    assert rows(graph.components_by_ranges(edges, 16)) == rows(graph.components_by_ranges(edges)) == rows(graph.components(edges))


def test_f2_conformers_at_once_and_by_steps(spark, monkeypatch):
    """The same charges and refusals whichever way components go, conformers and refused ones among them."""
    bonds = [(0, 1, 1, 0), (1, 2, 1, 0), (1, 3, 1, 0)]
    two = {"a": ([6, 6, 8, 8], bonds), "b": ([6, 6, 8, 26], bonds), "c": ([6, 8], [(0, 1, 3, 0)]), "d": ([6, 8], [(0, 1, 0, 0)]), "e": ([6, 7, 6], [(0, 1, 2, 0), (1, 2, 1, 0)])}
    s = structure(spark, two, altlocs={k: ["", "", "A", "B"] for k in "ab"})
    got = []
    for most in (1_000, 0):
        monkeypatch.setattr(gasteiger, "MOLECULE", most)
        out = gasteiger.gasteiger_charges(s, nothing(spark))
        got.append(({r["atom"]: r["charge"] for r in out.charges.collect()}, sorted(map(tuple, out.refused.collect()))))
    assert got[0][1] == got[1][1] and len(got[0][1]) == 3
    assert set(got[0][0]) == {0, 1, 2, 3, 12, 13, 14} and got[0][0] == pytest.approx(got[1][0], abs=1e-12)


def test_f1_windows_of_like_texts_share_a_rare_shingle():
    """Whatever the order of shingles: frequent ones, repeats, and places anywhere."""
    rng = np.random.default_rng(3)
    met = 0
    for turn in range(300):
        a = rng.integers(0, [60, 200, 1 << 39][turn % 3], 120).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 1 << 39, turn % 7).astype(np.uint64), a])
        b[rng.integers(0, len(b), turn % 12)] += np.uint64(1)
        known = np.unique(rng.choice(a, 30))
        frequent = known, rng.integers(1, 9, len(known))
        at, to = rng.integers(0, 120, 1), rng.integers(0, len(b), 1)
        like = any(
            cw.similar(a[i : i + 46], b[j : j + 46]) >= 0.8
            for i in range(max(0, at[0] - 45), min(at[0], 74) + 1) for j in range(max(0, to[0] - 45), min(to[0], len(b) - 46) + 1)
        )
        if like:
            met += 1
            assert len(np.intersect1d(cw.rarest(a, at, frequent, 0.8), cw.rarest(b, to, frequent, 0.8)))
    assert met > 30
    assert not len(cw.rarest(a[:45], np.array([3]), frequent, 0.8)) and not len(cw.rarest(a, np.zeros(0, np.int64), frequent, 0.8))


def test_f1_a_frequent_phrase_makes_no_pairs(spark, monkeypatch):
    """60 texts with 35 words in common met in all pairs."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]
    phrase, pairs, plain = words(35), [], cw.compared
    texts = [" ".join(words(60) + phrase + words(60)) for _ in range(60)]
    monkeypatch.setattr(cw, "compared", lambda t, p, *rest: pairs.append(p.count()) or plain(t, p, *rest))
    rows = cw.op8(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert pairs == [0] and all(r["class_id"] == r["doc_id"] and not r["n_links"] for r in rows)


def test_f1_links_of_a_group_are_counted(spark):
    """Twenty texts share 80 words: leaders were linked with all others, the others not with each other."""
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]
    shared = words(80)
    texts = [" ".join(words(20) + shared + words(20)) for _ in range(20)]
    rows = cw.op8(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in rows} == {(0, 19)}
