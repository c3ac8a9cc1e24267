"""Merkle manifest of a data set: per source a tree of 16 children a node, over the sources another.

Leaves are numbered within their source by a distributed rank and cut into aligned blocks of
16^3.  A block is one task's group of bounded size.  In it the authentication paths
are made by Merkle traversal: for every level one treehash stack builds, a leaf at a step, the
siblings that the path will need in the next run of that level, so a block's state is some
hashes a level and never a tree.  The blocks' roots are the leaves of the next tier, cut
into blocks again, until one is left; what a block's own root has as its path there is shared by all its
leaves and appended.  The sources' roots are one more such tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, free_name, release, stored
from .running import ranked

ARITY = 16
#: Levels of a block.
LEVELS = 3
#: Own place in the run and the run's other digests, joined, of every level from the leaf up.
PATH = "array<struct<pos:int,others:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n consecutive nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """A stack that takes nodes one by one and gives, of every completed run of a level, its nodes.

    It holds at most ``ARITY`` nodes a level.
    """

    def __init__(self, levels: int):
        self.open: list[list[str]] = [[] for _ in range(levels)]
        self.done: list[list[str] | None] = [None] * levels

    def push(self, node: str, level: int = 0) -> None:
        if level == len(self.open):
            return
        run = self.open[level]
        run.append(node)
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.done[level] = run
        self.push(digest("".join(run)), level + 1)

    def flush(self) -> None:
        """No more leaves: what is open becomes the last, shorter runs."""
        for level in range(len(self.open)):
            if self.open[level]:
                self._close(level)


def root_of(leaves: list[str], levels: int) -> str:
    stack = Treehash(levels)
    for leaf in leaves:
        stack.push(leaf)
    stack.flush()
    return digest("".join(stack.done[-1])) if levels else leaves[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[list[str]]]:
    """For every leaf in turn the runs that its path passes through, from the lowest level up.

    Level h's run changes every 16^(h+1) leaves.  While one is in use, the level's own stack takes one leaf at
    each step from the stretch that follows, so the next run is complete when it is
    needed; the first runs come from one pass of a stack over the first stretch of every level.
    """
    stacks = [Treehash(h + 1) for h in range(levels)]
    ahead = [0] * levels
    runs: list[list[str]] = []
    for h, stack in enumerate(stacks):
        ahead[h] = _advance(stack, h, leaves, 0, ARITY ** (h + 1))
        runs.append(stack.done[h])
    for i in range(len(leaves)):
        for h in range(levels):
            if i and i % ARITY ** (h + 1) == 0:
                runs[h] = stacks[h].done[h]
        yield runs
        for h, stack in enumerate(stacks):
            ahead[h] = _advance(stack, h, leaves, ahead[h], 1)


def _advance(stack: Treehash, h: int, leaves: list[str], at: int, steps: int) -> int:
    """Push ``steps`` leaves from ``at``; where they end, the run of level h is closed as it is."""
    end = min(at + steps, len(leaves))
    for leaf in leaves[at:end]:
        stack.push(leaf)
    if at < end == len(leaves):
        stack.flush()
    return end


def folded(leaf: str, i: int, runs: list[list[str]]) -> str:
    """The root that ``leaf`` at place i leads to with the other nodes of its runs."""
    for h, run in enumerate(runs):
        k = i // ARITY**h % ARITY
        leaf = digest("".join([*run[:k], leaf, *run[k + 1 :]]))
    return leaf


def block_levels(n: int, levels: int) -> int:
    """Levels within a block of a group of n nodes."""
    return min(height(n), levels)


def block_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, rank, n, digest), stored: the root of every block of ``nodes`` (g, rank, n, digest) as the next tier's nodes."""
    size = ARITY**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        root = root_of(table.column("digest").to_pylist(), block_levels(n, levels))
        return pa.table({"g": table.column("g")[:1], "rank": pa.array([table.column("rank")[0].as_py() // size]), "n": pa.array([-(-n // size)]), "digest": [root]})

    narrow = nodes.select("g", "rank", "n", "digest", F.floor(F.col("rank") / size).alias("block"))
    return stored(narrow.groupBy("g", "block").applyInArrow(run, "g string, rank long, n long, digest string"))


def with_paths(nodes: DataFrame, roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, rank, top, path), stored: each node's path to its group's root and that root.

    ``roots``: what block_roots made of the nodes.  One tier calls the next, of 1/4096 of its nodes.
    """
    size = ARITY**levels
    if roots.filter("n > 1").isEmpty():
        upper = roots.select("g", "rank", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    else:
        next_roots = block_roots(roots, levels)
        upper = with_paths(roots, next_roots, levels)
        discard(next_roots)

    def run(own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by("rank")
        ranks, shared = own.column("rank").to_pylist(), above.column("path")[0].as_py()
        paths = []
        for i, runs in enumerate(traverse(own.column("digest").to_pylist(), block_levels(own.column("n")[0].as_py(), levels))):
            at = [i // ARITY**h % ARITY for h in range(len(runs))]
            paths.append([{"pos": k, "others": "".join(r[:k] + r[k + 1 :])} for k, r in zip(at, runs)] + shared)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("others", pa.string())]))
        return pa.table({"g": own.column("g"), "rank": pa.array(ranks), "top": pa.array(above.column("top").to_pylist() * len(ranks), pa.string()), "path": pa.array(paths, kind)})

    narrow = nodes.select("g", F.floor(F.col("rank") / size).alias("block"), "rank", "n", "digest")
    above = upper.select(F.col("g").alias("ug"), F.col("rank").alias("ublock"), "top", "path")
    out = narrow.groupBy("g", "block").cogroup(above.groupBy("ug", "ublock")).applyInArrow(run, f"g string, rank long, top string, path {PATH}")
    return stored(out)


def fold_path(leaf: str, path: list[dict]) -> str:
    for step in path:
        k = 64 * step["pos"]
        leaf = digest(step["others"][:k] + leaf + step["others"][k:])
    return leaf


def encoded(value: Column) -> Column:
    """``-`` for a null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    """The text with A to Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``columns`` go into the leaf, in that order; others may be there and play no part.  ``tampered`` marks
    the rows whose text is lower-cased before the proof is checked; none by default.

    Within a source, rows are in order of id (null ids first), those with equal ids in order of their leaves.  Rows that
    are equal in all ``columns`` have equal leaves; each has a place of its own.  A null source comes
    before all others.  Null and empty values differ.  An empty table has no rows.
    """
    size = ARITY**levels
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    as_read = [F.col(c) for c in columns]
    as_changed = [tampered_text(F.col(c)) if c == text_col else F.col(c) for c in columns]
    key = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    own = leaf_digest(*as_read)
    leaves = docs.select(key.alias("g"), F.col(id_col).alias("id"), own.alias("digest"), F.when(changed, leaf_digest(*as_changed)).alias("other"))
    leaves = stored(leaves)
    order = [F.col("id").asc_nulls_first(), F.col("digest")]
    placed = ranked(leaves, ["g"], order)
    sizes = cut(placed.groupBy("g").agg(F.count("*").alias("n")))
    nodes = stored(placed.join(sizes, "g"))
    discard(leaves, placed)
    roots = block_roots(nodes, levels)
    subroots, tiers = roots, [roots]
    while not subroots.filter("n > 1").isEmpty():
        subroots = block_roots(subroots, levels)
        tiers.append(subroots)
    # The sources' roots, in the order of the sources, are the leaves of the last tree.
    tops = stored(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"))
    ordered = ranked(tops, ["g"], [F.col("of")])
    top_nodes = stored(ordered.withColumn("n", F.lit(ordered.count()).cast("long")))
    top_roots = block_roots(top_nodes, levels)
    top_paths = with_paths(top_nodes, top_roots, levels)
    above = top_nodes.select("of", "digest", "rank").join(top_paths.select("rank", "top", "path"), "rank")
    above = stored(above.select(F.col("of").alias("ug"), F.col("digest").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("source_path")))
    # Every block's path within its source, then the source's own.
    if len(tiers) == 1:
        upper = roots.select("g", F.col("rank").alias("ublock"), F.array().cast(PATH).alias("block_path"))
    else:
        upper = with_paths(roots, tiers[1], levels).select("g", F.col("rank").alias("ublock"), F.col("path").alias("block_path"))
    upper = stored(upper.join(above, F.col("g") == F.col("ug")).select("ug", "ublock", "subroot", "root", F.concat("block_path", "source_path").alias("path")))
    release(docs.sparkSession)

    def run(own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by("rank")
        up = above.to_pylist()[0]
        shared = "".join(s["others"] for s in up["path"])
        leaves_, others = own.column("digest").to_pylist(), own.column("other").to_pylist()
        proofs, folds = [], []
        for i, (leaf, other, runs) in enumerate(zip(leaves_, others, traverse(leaves_, block_levels(own.column("n")[0].as_py(), levels)))):
            proof = hashlib.sha256()
            for h, r in enumerate(runs):
                k = i // ARITY**h % ARITY
                proof.update("".join(r[:k] + r[k + 1 :]).encode())
            proof.update(shared.encode())
            proofs.append(proof.hexdigest())
            folds.append(fold_path(folded(leaf if other is None else other, i, runs), up["path"]))
        n, text = len(leaves_), pa.string()
        return pa.table(
            {
                "id": own.column("id"), "leaf": pa.array(leaves_, text), "subroot": pa.array([up["subroot"]] * n, text), "root": pa.array([up["root"]] * n, text),
                "proof_sha256": pa.array(proofs, text), "folded_root": pa.array(folds, text), "verified": pa.array([f == up["root"] for f in folds], pa.bool_()),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = nodes.select("g", F.floor(F.col("rank") / size).alias("block"), "rank", "n", "digest", "other", "id")
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = narrow.groupBy("g", "block").cogroup(upper.groupBy("ug", "ublock")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", free_name(schema_names(schema), id_col) if id_col in schema_names(schema)[1:] else id_col)


def schema_names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all documents.

    Rows whose id's crc32 is divisible by 5 are tampered with; a null id's row never is.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, tampered=tampered)


ORACLE = """
WITH RECURSIVE encoded AS (
  SELECT doc_id, source, lang, n_chars, text,
    -- CRC-32 of the id's digits, bit by bit
    4294967295 - list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
    sha256(head || body(text)) AS leaf,
    sha256(head || body(CASE WHEN crc % 5 = 0 THEN low ELSE text END)) AS checked
  FROM (SELECT *, body(doc_id) || body(source) || body(lang) || body(n_chars) AS head,
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM encoded)
), tree AS (
  SELECT 0 AS level, source, idx, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM tree) WHERE n > 1 GROUP BY level, source, idx // 16
), subroots AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM (SELECT *, max(level) OVER (PARTITION BY source) AS height FROM tree) WHERE level = height
), top AS (
  SELECT 0 AS level, place AS idx, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, idx // 16
), top_height AS (SELECT max(level) AS h FROM top),
runs AS (
  SELECT level, source, idx // 16 AS run, list(digest ORDER BY idx) AS nodes FROM tree GROUP BY ALL
), top_runs AS (
  SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS nodes FROM top GROUP BY ALL
), steps AS (
  SELECT l.doc_id, l.source, l.idx, r.level AS step, r.nodes, (l.idx // (16 ** r.level)::BIGINT) % 16 AS k
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN runs r ON r.source IS NOT DISTINCT FROM l.source AND r.level < s.height AND r.run = l.idx // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, l.source, l.idx, s.height + r.level, r.nodes, (s.place // (16 ** r.level)::BIGINT) % 16
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN top_runs r ON r.level < (SELECT h FROM top_height) AND r.run = s.place // (16 ** (r.level + 1))::BIGINT
), proofs AS (
  SELECT doc_id, source, idx, string_agg(array_to_string(nodes[:k] || nodes[k + 2:], ''), '' ORDER BY step) AS others FROM steps GROUP BY ALL
), folds AS (
  SELECT doc_id, source, idx, 0 AS step, checked AS digest FROM leaves
  UNION ALL
  SELECT f.doc_id, f.source, f.idx, f.step + 1, sha256(array_to_string(s.nodes[:s.k] || [f.digest] || s.nodes[s.k + 2:], ''))
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.source IS NOT DISTINCT FROM f.source AND s.idx = f.idx AND s.step = f.step
), ends AS (SELECT doc_id, source, idx, max_by(digest, step) AS folded_root FROM folds GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(coalesce(p.others, '')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
CROSS JOIN (SELECT digest FROM top WHERE level = (SELECT h FROM top_height)) t
LEFT JOIN proofs p ON p.doc_id = l.doc_id AND p.source IS NOT DISTINCT FROM l.source AND p.idx = l.idx
JOIN ends e ON e.doc_id = l.doc_id AND e.source IS NOT DISTINCT FROM l.source AND e.idx = l.idx
"""
for _c in ("doc_id", "source", "lang", "n_chars", "text"):
    _v = f"{_c}::VARCHAR"
    ORACLE = ORACLE.replace(f"body({_c})", f"coalesce(octet_length(encode({_v})) || ':' || {_v}, '-')")
_v = "(CASE WHEN crc % 5 = 0 THEN low ELSE text END)"
ORACLE = ORACLE.replace("body(CASE WHEN crc % 5 = 0 THEN low ELSE text END)", f"coalesce(octet_length(encode({_v})) || ':' || {_v}, '-')")
