"""Prefix trie of conversations as an interval-encoded table of its nodes.

A node is a distinct sequence of first turns; its key is the sum of 128-bit hashes of (place,
role, text) over them, so the keys of a conversation's prefixes are running sums of its rows and no task
holds a conversation.  Nodes are put in preorder: those below a branching node begin
segments, a segment is named by the keys of the segments that lead to it, and segments in the
lexicographic order of these names, each from its top down, are the trie in preorder.  A node
stores where its subtree ends; how many leaves a subtree has and what it saves are differences of
running sums over the preorder at its two ends.

A conversation has as many segment names as branching nodes on its path, at most the square root of
twice the table's rows (each such node needs another conversation of that length).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, shuffle_width, stored
from .running import ranked

MASK = (1 << 32) - 1
LANES = ["l0", "l1", "l2", "l3"]
#: Ids that one row of ``ends_digests`` carries.
CHUNK = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, rank, content, chars), stored: the turns of every conversation, numbered from 0.

    Null turns come first; equal turns are in the order of the MD5 of role and text.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    content = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    narrow = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), content.alias("content"), F.length(t).cast("long").alias("chars"))
    narrow = stored(narrow)
    out = ranked(narrow, ["conv"], [F.col("turn").asc_nulls_first(), F.col("content")])
    discard(narrow)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, rows), stored, of numbered turns: each conversation with the head of another in place of its own.

    plan: (conv, h, shared, length); rows: (conv, d, content, chars), d from 1.  Conversation c begins
    with up to h = crc32(c) % 6 turns of conversation c - c % 100 (the remainder has c's sign).
    """
    counts = stored(turns.groupBy("conv").agg(F.count("*").alias("n")))
    of = F.col("conv") - F.col("conv") % 100
    plan = counts.withColumns({"base": of, "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % 6)})
    bases = counts.filter("conv % 100 = 0").select(F.col("conv").alias("b"), F.col("n").alias("nb"))
    plan = plan.join(bases, F.col("base") == F.col("b"), "left").withColumn("shared", F.least("h", F.coalesce("nb", F.lit(0))))
    plan = stored(plan.select("conv", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.filter("conv % 100 = 0 AND rank < 5").select(F.col("conv").alias("base"), "rank", "content", "chars")
    borrowed = plan.join(heads, "base").filter("rank < h").select("conv", (F.col("rank") + 1).alias("d"), "content", "chars")
    own = turns.join(plan, "conv").filter("rank >= h").select("conv", (F.col("shared") + F.col("rank") - F.col("h") + 1).alias("d"), "content", "chars")
    rows = stored(borrowed.union(own))
    discard(counts)
    return plan, rows


def lanes() -> list[Column]:
    """Four 32-bit parts of a turn's hash at its place."""
    one, other = F.xxhash64("d", "content"), F.xxhash64("content", "d", F.lit(1))
    return [part for h in (one, other) for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(MASK)))]


def key_of(parts: list[Column]) -> list[Column]:
    low = [p.bitwiseAND(F.lit(MASK)) for p in parts]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def prefixes(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, d, k1, k2, p1, p2, chars, last), stored: every prefix of every conversation, its key and its parent's."""
    laned = stored(rows.select("conv", "d", "content", "chars", *(x.alias(c) for c, x in zip(LANES, lanes()))))
    sums = ranked(laned, ["conv"], [F.col("d")], LANES)
    total = [F.col(c) for c in LANES]
    k1, k2 = key_of(total)
    p1, p2 = key_of([t - x for t, x in zip(total, lanes())])
    keyed = sums.select("conv", "d", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "chars")
    keyed = keyed.join(plan.select("conv", "length"), "conv")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = plan.select("conv", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"), "length")
    out = stored(keyed.union(root).withColumn("last", F.col("d") == F.col("length")).drop("length"))
    discard(laned, sums)
    return out


def distinct_nodes(paths: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv, n_convs, chars, n_children), stored: every node once; conv: its least member."""
    nodes = paths.groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("d").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")
    )
    nodes = stored(nodes)
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    out = stored(nodes.join(kids, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    discard(nodes)
    return out


def segment_ranks(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, starts), stored: of each conversation the (d, rank) at which the segments on its path begin.

    Ranks are those of the segments' names, in lexicographic order: a name comes before what it begins.
    """
    forks = nodes.filter("n_children > 1").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    tops = stored(nodes.join(forks, ["p1", "p2"], "left_semi").union(nodes.filter("depth = 0").select("p1", "p2", *(c for c in nodes.columns if c not in ("p1", "p2")))).select("k1", "k2", "depth", "conv"))
    held = stored(paths.join(tops.select("k1", "k2"), ["k1", "k2"]).select("conv", "d", "k1", "k2"))
    names = held.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("d", "k1", "k2"))).alias("path"))
    part = lambda x: F.concat(*(F.lpad(F.hex(x[c]), 16, "0") for c in ("k1", "k2")))
    on_path = F.transform(F.filter("path", lambda x: x["d"] <= F.col("depth")), part)
    named = stored(tops.join(names, "conv").select("k1", "k2", F.array_join(on_path, "").alias("name")))
    order = ranked(named, [], [F.col("name")])
    out = stored(held.join(order.select("k1", "k2", "rank"), ["k1", "k2"]).groupBy("conv").agg(F.collect_list(F.struct("d", "rank")).alias("starts")))
    discard(tops, held, named, order)
    return out


def preorder(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with rank (the place in preorder), running sums ``leaves`` and ``saved``, and own_leaf, own_saved; stored."""
    starts = segment_ranks(paths, nodes)
    own_leaf = (F.col("n_children") == 0).cast("long")
    own_saved = (F.col("n_convs") - 1) * F.col("chars")
    segment = F.array_max(F.filter("starts", lambda x: x["d"] <= F.col("depth")))["rank"]
    placed = nodes.join(starts, "conv").select("k1", "k2", "p1", "p2", "depth", "conv", "n_convs", "n_children", segment.alias("segment"), own_leaf.alias("own_leaf"), own_saved.alias("own_saved"))
    placed = stored(placed.withColumns({"leaves": F.col("own_leaf"), "saved": F.col("own_saved")}))
    out = ranked(placed, [], [F.col("segment"), F.col("depth")], ["leaves", "saved"])
    discard(starts, placed)
    return out


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256), stored: of the ids (conv) of every key in ascending order, joined by commas.

    Ids are sorted by ranges and packed into rows of CHUNK; a key's rows are then hashed as they
    stream by, so a key with very many ids costs one task some bytes an id and no memory.
    """
    by = ["k1", "k2", "conv"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, conv = (batch.column(c).to_numpy() for c in range(3))
            n = len(conv)
            new = np.ones(n, bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            first = np.flatnonzero(new)
            cuts = [c for f, t in zip(first, [*first[1:], n]) for c in range(f, t, CHUNK)]
            ids = conv.tolist()
            text = [",".join(map(str, ids[f:t])) for f, t in zip(cuts, [*cuts[1:], n])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(conv[cuts]), pa.array(text, pa.string())], ["k1", "k2", "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row(keys: list, digests: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(digests, pa.string())], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            keys, digests = [], []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (k1, k2) != key:
                    if key is not None:
                        keys.append(key), digests.append(state.hexdigest())
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield row(keys, digests)
        if key is not None:
            yield row([key], [state.hexdigest()])

    width = shuffle_width(ends.sparkSession)
    packed = ends.select(*by).repartitionByRange(width, *by).sortWithinPartitions(*by).mapInArrow(pack, "k1 long, k2 long, conv long, ids string")
    return stored(packed.repartition(width, "k1", "k2").sortWithinPartitions(*by).mapInArrow(digest, "k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Conversations are rebuilt first (see ``rebuilt``).  Rows with a null conversation take no part; null
    roles and texts count as empty, null turns come first, equal turns are in the order of the MD5
    of role and text, and repeated rows are turns of their own.  An empty table has no nodes, not
    even the root.  Other columns play no part.
    """
    spark = turns.sparkSession
    numbered = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    plan, rows = rebuilt(numbered)
    paths = prefixes(plan, rows)
    discard(numbered, plan, rows)
    release(spark)
    nodes = distinct_nodes(paths)
    order = preorder(paths, nodes)
    discard(nodes)
    release(spark)
    # A conversation's last node ends the subtree of each node on its path, unless another member's comes later.
    last = stored(paths.filter("last").select("conv", "k1", "k2"))
    at = order.select("k1", "k2", F.struct("rank", "leaves", "saved").alias("at"))
    at = last.join(at, ["k1", "k2"]).select("conv", "at")
    ends = stored(paths.select("conv", "k1", "k2").join(at, "conv").groupBy("k1", "k2").agg(F.max("at").alias("end")))
    digests = ends_digests(last)
    parents = order.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    out = order.join(ends, ["k1", "k2"]).join(digests, ["k1", "k2"], "left")
    out = stored(out.select(
        "p1", "p2", F.col("conv").alias("conv_id"), "depth", "n_convs", "n_children",
        (F.col("end.leaves") - F.col("leaves") + F.col("own_leaf")).alias("n_leaves"), (F.col("end.saved") - F.col("saved") + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    ))
    result = out.join(parents, ["p1", "p2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    result = stored(result)
    discard(paths, last, ends, digests, out, order)
    return result


def op13(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations."""
    return prefix_trie(turns)


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    -- CRC-32 of the id's digits, bit by bit
    (4294967295 - list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.rank, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rank < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.rank, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(p.path, []) AS path
  FROM convs c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, rank) AS path FROM rebuilt GROUP BY conv_id) p USING (conv_id)
), members AS (
  SELECT conv_id, d AS depth, path[:d] AS node, len(path) = d AS ends FROM paths, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.node[:n.depth] = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]
)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, v.ends_sha256,
  count(*) FILTER (s.n_children = 0) AS n_leaves,
  sum(CASE WHEN s.depth = 0 THEN 0 ELSE (s.n_convs - 1) * length(s.node[s.depth].text) END)::BIGINT AS saved_tokens
FROM linked v JOIN linked s ON s.depth >= v.depth AND s.node[:v.depth] = v.node
GROUP BY v.node, v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, v.ends_sha256
"""
