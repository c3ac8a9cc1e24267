"""The prefix trie against a trie built by hand; ranks and running sums against pandas."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spindle.llm import prefix_trie
from spindle.llm.common import stored
from spindle.llm.running import ranked

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, tie), role, text))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = (len(p) and (len(members[p]) - 1) * len(p[-1][1])) + sum(saved[k] for k in kids.get(p, ()))
    out = []
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def got(spark, rows, extra=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return sorted((tuple(r) for r in prefix_trie.op13(df.withColumns(extra or {})).select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 230), 1000, 1001, 1099, -5, -250, -200, 77_777]:
        for t in range(rng.choice([1, 1, 2, 4, 7, 9])):
            rows.append((c, rng.choice([t, t, None, 2]), rng.choice(["user", "assistant", None, ""]), rng.choice(["Hi", "é日", None, "", "why", f"own {c}"])))
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (5, 0, "system", "y" * 200_000)]
    want = brute(rows)
    assert got(spark, rows) == want
    clash = {c: F.lit(7) for c in ("conv", "d", "k1", "rank", "content", "chars", "at", "path")}
    assert got(spark, rows, clash) == want


def test_copies_and_a_long_conversation(spark):
    """Many equal conversations, one common first turn, one very long conversation and a copy of it."""
    rows = [(c, t, "user", f"m{t}") for c in range(1, 700) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in (100_000, 200_000) for t in range(900)]
    rows += [(300_000 + k, t, "user", f"turn {t}" if t < 20 * k else f"left at {k}") for k in range(30) for t in range(20 * k + 2)]
    assert got(spark, rows) == brute(rows)


def test_a_turnless_conversation_and_an_empty_table(spark):
    c = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone with the head")]
    assert got(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert got(spark, []) == []


@pytest.mark.parametrize("groups", [1, 3, 400])
def test_ranks_and_running_sums(spark, groups):
    rng = random.Random(groups)
    rows = [(rng.randrange(groups) if groups > 1 else 0, rng.randrange(50), rng.randrange(-9, 10), i) for i in range(2_000)]
    df = stored(spark.createDataFrame(rows, "g long, o long, v long, i long"))
    key = [F.col("o").desc(), F.col("i")]
    out = ranked(df, ["g"], key, ["v"]).toPandas().sort_values("i", ignore_index=True)
    want = df.toPandas().sort_values(["g", "o", "i"], ascending=[True, False, True])
    want["v"], want["rank"] = want.groupby("g")["v"].cumsum(), want.groupby("g").cumcount()
    want = want.sort_values("i", ignore_index=True)
    assert (out[["g", "o", "i", "v", "rank"]] == want[["g", "o", "i", "v", "rank"]]).all().all()


def test_equal_rows_are_ranked_apart(spark):
    df = stored(spark.createDataFrame([(1, 1)] * 3_000, "g long, v long"))
    out = ranked(df, ["g"], [F.col("g")], ["v"])
    assert sorted((r["rank"], r["v"]) for r in out.collect()) == [(i, i + 1) for i in range(3_000)]
