"""The Merkle manifest against a plain tree, at sizes around a run's, a block's and a tier's."""

import zlib

import pytest
from pyspark.sql import functions as F

from spindle.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], merkle.digest("".join(map(encoded, r))), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (doc_id, leaf, r) in enumerate(by[s]):
            path = []
            for levels, at in ((trees[s], i), (top, j)):
                for level in levels[:-1]:
                    first = at // 16 * 16
                    path.append((at - first, level[first : first + 16]))
                    at //= 16
            fold = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                fold = merkle.digest("".join(map(encoded, (*r[:4], r[4] and r[4].translate(LOW)))))
            for k, run in path:
                fold = merkle.digest("".join([*run[:k], fold, *run[k + 1 :]]))
            others = "".join(x for k, run in path for q, x in enumerate(run) if q != k)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], merkle.digest(others), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_traversal_gives_every_path(n):
    leaves = [merkle.digest(str(i)) for i in range(n)]
    levels = tree(leaves)
    h = merkle.height(n)
    assert h == len(levels) - 1
    for i, runs in enumerate(merkle.traverse(leaves, h)):
        assert runs == [levels[k][i // 16 ** (k + 1) * 16 :][:16] for k in range(h)]
        assert merkle.folded(leaves[i], i, runs) == levels[-1][0]
    if n:
        assert merkle.root_of(leaves, h) == levels[-1][0]


def test_traversal_holds_few_nodes():
    leaves = [merkle.digest(str(i)) for i in range(4096)]
    stack = merkle.Treehash(3)
    for leaf in leaves:
        stack.push(leaf)
        assert sum(map(len, stack.open)) <= 3 * 16


def test_odd_rows(spark):
    texts = ["Abc É", None, "", "x" * 300_000, "same", "same"]
    rows = [(i, [None, "a", "", "Ä", "b"][i % 5] if i < 40 else "hot", "en" if i % 3 else None, len(texts[i % 6] or ""), texts[i % 6]) for i in range(330)]
    rows += [(7, "a", "en", 1, "again"), (7, "a", "en", 1, "again"), (7, "a", "en", 1, "other"), (None, "a", None, None, None)]
    got = sorted((tuple(r) for r in merkle.op12(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    clash = frame(spark, rows).withColumns({c: F.lit(1) for c in ("g", "id", "rank", "n", "digest", "other", "leaf")})
    assert sorted((tuple(r) for r in merkle.op12(clash).collect()), key=str) == got


def test_many_tiers(spark):
    """Small blocks, so that blocks of blocks and several tiers of sources appear."""
    rows = [(i, f"s{i:03}" if i % 2 else "hot", "en", i, f"Text {i}") for i in range(620)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(frame(spark, rows), tampered=tampered, levels=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert merkle.op12(frame(spark, [])).count() == 0
