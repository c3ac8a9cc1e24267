"""Approximate nearest neighbours by inner product: NN-descent, then greedy search of its graph.

Equal vectors are one node.  The graph begins with what random-projection trees put into one
leaf: the trees' splits come from a bounded sample, every node falls through all of them, and
cells are cut into leaves of at most ``leaf`` nodes by rank, so no leaf is larger.  Then it descends:
nodes are dealt into blocks, each block gets the vectors of its nodes' neighbours (a list's own and
a sample of those that list the node), every two neighbours of a node meet, and what is nearer than the
last of a list moves to that list's node.  Lists hold ``degree`` nodes.

A query starts at its own node's list, or where no node has its vector at some nodes of the cells it falls
into, and greedily expands the nearest nodes that it has not expanded, ``reach`` of them at
least, until none of them is nearer.  Then the best are scored exactly.

In transit a component is a half float times the vector's largest; only the last scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, release, small, stored
from .running import ranked

#: Rows from which the trees' splits are taken, and the bytes of splits at most.
SAMPLE = 16_384
MODEL_BYTES = 1 << 24
#: Nodes of largest norm that every node meets at the start: where norms differ much, they are most nodes' nearest.
LARGEST = 32
#: Bytes of the vectors that one block of nodes may meet, and of queries' candidates.
BLOCK_BYTES = 1 << 26
SALT_BLOCKS = 64
F16, F32, I64 = np.float16, np.float32, np.int64
LISTS = "node long, ids binary, scores binary"


def packed(column: pa.Array, scale: pa.Array, dim: int) -> np.ndarray:
    """Vectors from half floats and their scales."""
    rows = np.frombuffer(b"".join(column.to_pylist()), F16).reshape(-1, dim).astype(F32)
    return rows * scale.to_numpy(zero_copy_only=False).astype(F32)[:, None]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, d1, d2), stored: rows that take part, one for each id, and 128 bits that stand for the vector.

    Of an id's vectors the one of least hash counts; of different lengths the most frequent.
    """
    x = F.col("vec")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & x.isNotNull()).filter(good)
    hashed = named.select("id", F.struct(F.xxhash64("vec").alias("d1"), F.xxhash64(F.lit(1), "vec").alias("d2"), "vec").alias("v"))
    one = stored(hashed.groupBy("id").agg(F.min_by("v", F.struct("v.d1", "v.d2")).alias("v")).select("id", "v.vec", "v.d1", "v.d2"))
    sizes = one.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    out = one.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0))
    out._stored_in, out._dim = one._stored_in, sizes[0]["n"] if sizes else 0
    return out


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(node, ids, vec, d1, d2, h, s), stored: the distinct vectors of ``usable`` rows, h and s as in transit.

    node: the least id; ids: the ``keep`` least ids, more of which no result can hold.
    """
    by = Window.partitionBy("d1", "d2").orderBy("id")
    few = rows.select("id", "d1", "d2").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= keep)
    ids = few.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    named = ids.select("ids", F.element_at("ids", 1).alias("id"))
    held = rows.join(named, "id").select(F.col("id").alias("node"), "ids", "vec", "d1", "d2")
    dim = rows._dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            s = np.abs(x).max(1)
            h = (x / s[:, None]).astype(F16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in h], pa.binary()), pa.array(s.astype(F32))], [*batch.schema.names, "h", "s"])

    kind = rows.schema["vec"].dataType.simpleString()
    return stored(held.mapInArrow(run, f"node long, ids array<long>, vec {kind}, d1 long, d2 long, h binary, s float"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]


class Forest:
    """Random-projection trees over a sample; all nodes fall through the same number of splits."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        sample = unit(sample)
        self.depth, dim = depth, sample.shape[1]
        self.normals = np.zeros((trees, (1 << depth) - 1, dim), F32)
        self.middles = np.zeros((trees, (1 << depth) - 1), F32)
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for cell in range(1 << level):
                    held = np.flatnonzero(at == cell)
                    k = (1 << level) - 1 + cell
                    a, b = rng.choice(held if len(held) > 1 else len(sample), 2, replace=len(sample) < 2)
                    self.normals[t, k] = sample[a] - sample[b]
                    self.middles[t, k] = np.median(sample[held] @ self.normals[t, k]) if len(held) else 0
                k = (1 << level) - 1 + at
                at = 2 * at + (np.einsum("ij,ij->i", sample, self.normals[t, k]) > self.middles[t, k])
        self.order = rng.normal(size=(trees, dim)).astype(F32)

    def cells(self, x: np.ndarray, tree: int) -> np.ndarray:
        x, at = unit(x), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            k = (1 << level) - 1 + at
            at = 2 * at + (np.einsum("ij,ij->i", x, self.normals[tree, k]) > self.middles[tree, k])
        return at


def cells_of(nodes: DataFrame, forest: Broadcast, trees: int, dim: int, by: str = "node") -> DataFrame:
    """(by, tree, cell, o) of every row in every tree; o: its place along a direction of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            x, n = packed(batch.column(1), batch.column(2), dim), batch.num_rows
            for t in range(trees):
                cell, o = f.cells(x, t), (unit(x) @ f.order[t]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, t, np.int32)), pa.array(cell), pa.array(o)], [by, "tree", "cell", "o"])

    return nodes.select(by, "h", "s").mapInArrow(run, f"{by} long, tree int, cell long, o double")


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best distinct ids of each owner, in order of owner and from the best down; ties to smaller ids."""
    order = np.lexsort((-scores, ids, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    owner, ids, scores = owner[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    at = np.searchsorted(owner, owner)
    take = np.arange(len(owner)) - at < keep
    return owner[take], ids[take], scores[take]


def list_rows(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, names: tuple[str, ...] = ("node", "ids", "scores")) -> pa.RecordBatch:
    """One row for each owner (sorted) with its ids and scores packed."""
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, I64)
    ends = [*start[1:], len(owner)]
    ids, scores = ids.astype(I64), scores.astype(F32)
    cut_ = lambda x: pa.array([x[f:t].tobytes() for f, t in zip(start, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(owner[start].astype(I64)), cut_(ids), cut_(scores)], list(names))


def unlisted(batch: pa.RecordBatch, ids: int = 1, scores: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, ids, scores), flat, of packed lists."""
    held = batch.column(ids).to_pylist()
    owner = np.repeat(batch.column(0).to_numpy(), [len(b) // 8 for b in held])
    return owner, np.frombuffer(b"".join(held), I64), np.frombuffer(b"".join(batch.column(scores).to_pylist()), F32)


def merged(lists: DataFrame, keep: int) -> DataFrame:
    """(node, ids, scores): the best of all the lists that a node has, merged as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, I64), np.zeros(0, I64), np.zeros(0, F32))
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, ids, scores = best(*(np.concatenate(p) for p in zip(rest, unlisted(batch))), keep)
            over = owner == batch.column(0)[-1].as_py()  # its lists may go on in the next batch
            rest = (owner[over], ids[over], scores[over])
            yield list_rows(owner[~over], ids[~over], scores[~over])
        if len(rest[0]):
            yield list_rows(*rest)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, LISTS)


def nearest_within(keys: np.ndarray, x: np.ndarray, keep: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, id, score): every vector's ``keep`` nearest others, above its limit where there is one."""
    keep = min(keep, len(keys) - 1)
    if keep < 1:
        return np.zeros(0, I64), np.zeros(0, I64), np.zeros(0, F32)
    g = x @ x.T
    np.fill_diagonal(g, -np.inf)
    p = np.argpartition(-g, keep - 1, axis=1)[:, :keep]
    v = np.take_along_axis(g, p, 1)
    i, j = np.nonzero(v > limit[:, None]) if limit is not None else np.nonzero(v > -np.inf)
    return keys[i], keys[p[i, j]], v[i, j].astype(F32)


def first_lists(nodes: DataFrame, cells: DataFrame, dim: int, leaf: int, degree: int, per_leaf: int) -> DataFrame:
    """The lists that the trees' leaves, and the nodes of largest norm, give."""
    dealt = cells.select("node", "tree", "cell", F.floor(F.col("rank") / leaf).alias("part"))
    vectors = nodes.select("node", "h", "s")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = packed(table.column("h"), table.column("s"), dim)
        found = best(*nearest_within(table.column("node").to_numpy(), x, per_leaf), per_leaf)
        return pa.Table.from_batches([list_rows(*found)])

    lists = dealt.join(vectors, "node").groupBy("tree", "cell", "part").applyInArrow(run, LISTS)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    top = nodes.select("node", "h", "s", norm.alias("n")).orderBy(F.desc("n"), "node").limit(LARGEST).collect()
    keys = np.array([r["node"] for r in top], I64)
    large = np.stack([np.frombuffer(r["h"], F16).astype(F32) * F32(r["s"]) for r in top]) if top else None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            g = packed(batch.column(1), batch.column(2), dim) @ large.T
            i, j = np.nonzero(own[:, None] != keys)
            yield list_rows(*best(own[i], keys[j], g[i, j].astype(F32), LARGEST))

    return merged(lists.union(vectors.mapInArrow(meet, LISTS)) if top else lists, degree)


def reversed_lists(graph: DataFrame, keep: int, turn: int) -> DataFrame:
    """(node, back): up to ``keep`` nodes that list the node, a new random choice each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ids, _ = unlisted(batch)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(owner)], ["node", "by"])

    flat = graph.select("node", "ids", "scores").mapInArrow(run, "node long, by long")
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "by", F.lit(turn)))
    few = flat.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep)
    return few.groupBy("node").agg(F.collect_list("by").alias("back"))


def descend(graph: DataFrame, nodes: DataFrame, blocks: DataFrame, n_blocks: int, dim: int, degree: int, back: int, move: int, turn: int) -> DataFrame:
    """One turn: the lists after every two neighbours of each node have met; stored."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, ids, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows.append(np.unique(np.concatenate([[node], np.frombuffer(ids, I64), np.array(more or [], I64)])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["block", "met"])

    around = blocks.join(graph, "node").join(reversed_lists(graph, back, turn), "node", "left")
    around = stored(around.select("block", "node", "ids", "back").mapInArrow(gather, "block long, met binary"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column(1).to_pylist()
            pairs = np.stack([np.repeat(batch.column(0).to_numpy(), [len(m) // 8 for m in met]), np.frombuffer(b"".join(met), I64)])
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["lot", "node"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.frombuffer(s, F32)[-1] if len(s) == 4 * degree else F32(-np.inf) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.float32())], ["node", "least"])

    limits = nodes.select("node", "h", "s").join(graph.select("node", "scores").mapInArrow(last, "node long, least float"), "node", "left")
    vectors = around.mapInArrow(wanted, "lot long, node long").distinct().join(limits, "node").select("lot", "node", "h", "s", "least")

    def meet(own: pa.Table, held: pa.Table) -> pa.Table:
        held = held.combine_chunks().sort_by("node")
        keys, x = held.column("node").to_numpy(), packed(held.column("h"), held.column("s"), dim)
        least = np.nan_to_num(held.column("least").to_numpy(), nan=-np.inf, neginf=-np.inf)
        parts, size, out = [], 0, []
        for met in own.column("met").to_pylist():
            at = np.searchsorted(keys, np.frombuffer(met, I64))
            parts.append(nearest_within(keys[at], x[at], move, least[at]))
            size += len(parts[-1][0])
            if size > 1 << 20:
                out, parts, size = [best(*(np.concatenate(p) for p in zip(*out, *parts)), degree)], [], 0
        if out or parts:
            out = [best(*(np.concatenate(p) for p in zip(*out, *parts)), degree)]
            return pa.Table.from_batches([list_rows(*out[0])])
        return pa.Table.from_batches([list_rows(np.zeros(0, I64), np.zeros(0, I64), np.zeros(0, F32))])

    found = around.groupBy("block").cogroup(vectors.groupBy("lot")).applyInArrow(meet, LISTS)
    if n_blocks > SALT_BLOCKS:  # a node that very many list gets its candidates merged in two steps
        salted = found.withColumn("salt", F.spark_partition_id())
        found = premerged(salted, degree)
    out = stored(merged(graph.select("node", "ids", "scores").union(found), degree))
    discard(around)
    return out


def premerged(lists: DataFrame, keep: int) -> DataFrame:
    """Lists of the same node in one partition made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield list_rows(*best(*unlisted(batch), keep))

    return lists.sortWithinPartitions("node").select("node", "ids", "scores").mapInArrow(run, LISTS)


class Index:
    """Nodes and their graph; ``close`` deletes its tables."""

    def __init__(self, rows: DataFrame, id_col: str, vec_col: str, k: int = 20, degree: int = 64, trees: int = 12, leaf: int = 1024, turns: int = 3, back: int = 48, move: int = 6, seed: int = 5):
        spark = rows.sparkSession
        self.rows = usable(rows, id_col, vec_col)
        self.dim, self.k, self.degree, self.trees = self.rows._dim, k, degree, trees
        self.nodes = nodes_of(self.rows, k + 1)
        n = self.nodes.count()
        depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        widest = MODEL_BYTES // (4 * (trees + 1) * max(1, self.dim))
        depth = min(depth, max(0, widest.bit_length() - 1), max(0, (SAMPLE // 16).bit_length() - 1))
        picks = self.nodes.select("h", "s").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
        sample = np.stack([np.frombuffer(r["h"], F16).astype(F32) for r in picks]) if picks else np.zeros((0, max(1, self.dim)), F32)
        self.forest = spark.sparkContext.broadcast(Forest(sample, trees + 1, depth if len(picks) > 1 else 0, seed))
        cells = stored(cells_of(self.nodes, self.forest, trees + 1, self.dim))
        self.cells = ranked(cells, ["tree", "cell"], [F.col("o"), F.col("node")])
        discard(cells)
        self.graph = stored(first_lists(self.nodes, self.cells.filter(F.col("tree") < trees), self.dim, leaf, degree, min(degree, 24)))
        # A block's nodes meet at most so many vectors each.
        of = max(64, min(2 * leaf, BLOCK_BYTES // (4 * max(1, self.dim) * (degree + back + 1))))
        block = F.xxhash64("cell", F.floor(F.col("rank") / of))
        blocks = self.cells.filter(F.col("tree") == trees).select("node", block.alias("block"))
        for turn in range(turns):
            before = self.graph
            self.graph = descend(before, self.nodes, blocks, -(-n // of), self.dim, degree, back, move, turn)
            discard(before)
            release(spark)

    def close(self) -> None:
        discard(self.rows, self.nodes, self.cells, self.graph)


def entries(index: Index, queries: DataFrame) -> DataFrame:
    """(q, h, s, ids, scores), stored: each query and the list it starts from.

    ``queries``: (q, vec, d1, d2, h, s).
    """
    dim = index.dim
    known = index.nodes.select("node", "d1", "d2")
    matched = stored(queries.select("q", "d1", "d2", "h", "s").join(known, ["d1", "d2"], "left").select("q", "h", "s", "node"))
    own = matched.filter(F.col("node").isNotNull()).join(index.graph, "node", "left").select("q", "h", "s", "node", "ids", "scores")
    new = matched.filter(F.col("node").isNull())

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = packed(batch.column(1), batch.column(2), dim)
            ids, scores = [], []
            for v, node, i, s in zip(x, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                ids.append(np.array([node], I64).tobytes() + (i or b"")), scores.append(np.array([v @ v], F32).tobytes() + (s or b""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(scores, pa.binary())], ["q", "h", "s", "ids", "scores"])

    kind = "q long, h binary, s float, ids binary, scores binary"
    out = own.mapInArrow(start, kind)
    if not new.isEmpty():
        doors = stored(index.cells.filter(F.col("rank") < 8).select("tree", "cell", "node"))
        seeds = cells_of(new, index.forest, index.trees, dim, "q").join(doors, ["tree", "cell"]).select("q", "node").distinct()
        empty = new.select("q", "h", "s", F.lit(b"").alias("ids"), F.lit(b"").alias("scores"))
        out = out.union(met_by(index, empty.withColumn("done", F.lit(b"")), seeds).select("q", "h", "s", "ids", "scores"))
    out = stored(out)
    discard(matched)
    return out


STATE = "q long, h binary, s float, ids binary, scores binary, done binary"


def met_by(index: Index, state: DataFrame, seeds: DataFrame, pool: int = 256) -> DataFrame:
    """``state`` with the nodes of ``seeds`` (q, node) scored and put into its lists."""
    dim = index.dim
    size = max(16, BLOCK_BYTES // (4 * max(1, dim) * 8 * index.degree))
    lots = F.lit(max(1, -(-state.count() // size)))
    vectors = seeds.join(index.nodes.select("node", "h", "s"), "node").select(F.pmod(F.xxhash64("q"), lots).alias("lot"), "q", "node", "h", "s")
    dealt = state.withColumn("lot", F.pmod(F.xxhash64("q"), lots))

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        own, held = own.combine_chunks(), held.combine_chunks().sort_by("q")
        q = held.column("q").to_numpy()
        keys, x = held.column("node").to_numpy(), packed(held.column("h"), held.column("s"), dim)
        mine = packed(own.column("h"), own.column("s"), dim)
        ids, scores, done = [], [], []
        for v, one, i, s, d in zip(mine, *(own.column(c).to_pylist() for c in ("q", "ids", "scores", "done"))):
            f, t = np.searchsorted(q, one), np.searchsorted(q, one, "right")
            i, s, d = np.frombuffer(i, I64), np.frombuffer(s, F32), np.frombuffer(d, I64)
            every = np.concatenate([i, keys[f:t]])
            _, found, value = best(np.zeros(len(every), I64), every, np.concatenate([s, (x[f:t] @ v).astype(F32)]), pool)
            ids.append(found.tobytes()), scores.append(value.tobytes()), done.append(np.intersect1d(d, found).tobytes())
        return pa.table({"q": own.column("q"), "h": own.column("h"), "s": own.column("s"), **{n: pa.array(c, pa.binary()) for n, c in (("ids", ids), ("scores", scores), ("done", done))}})

    return dealt.groupBy("lot").cogroup(vectors.groupBy("lot")).applyInArrow(run, STATE)


def search(index: Index, queries: DataFrame, reach: int = 40, step: int = 20) -> DataFrame:
    """(q, ids, scores): the best nodes that a greedy search of the graph finds for each query.

    Each turn expands the ``step`` nearest nodes among a query's ``reach`` nearest that it has not expanded; it ends when
    these are all expanded.  Each expanded node comes from a finite set once, so it ends.
    """
    state = entries(index, queries).withColumn("done", F.lit(b""))
    state._stored_in = None
    while True:

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                now, done = [], []
                for i, d in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                    d = np.frombuffer(d, I64)
                    near = np.frombuffer(i, I64)[:reach]
                    new = near[~np.isin(near, d)][:step]
                    now.append(new.tobytes()), done.append(np.concatenate([d, new]).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(done, pa.binary()), pa.array(now, pa.binary())], [*batch.schema.names[:5], "done", "now"])

        def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                now = batch.column(1).to_pylist()
                q = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in now])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.frombuffer(b"".join(now), I64))], ["q", "node"])

        marked = stored(state.mapInArrow(mark, f"{STATE}, now binary"))
        if state._stored_in:
            discard(state)
        todo = marked.filter(F.octet_length("now") > 0)
        if todo.isEmpty():
            return marked.select("q", "ids", "scores")
        edges = todo.select("q", "now").mapInArrow(open_, "q long, node long").join(index.graph.select("node", "ids"), "node").select("q", "ids")
        known = todo.select("q", F.col("ids").alias("now")).mapInArrow(open_, "q long, node long")
        # Nodes that a query has met already don't move again.
        fresh = edges.select("q", F.col("ids").alias("now")).mapInArrow(open_, "q long, node long").distinct().join(known, ["q", "node"], "left_anti")
        moved = met_by(index, todo.drop("now"), fresh)
        state = stored(marked.filter(F.octet_length("now") == 0).drop("now").union(moved))
        discard(marked)
        release(index.nodes.sparkSession)


def neighbours(index: Index, queries: DataFrame, exclude_own: bool = True, extra: int = 12) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the search finds, scored exactly; ties to smaller ids.

    ``queries``: (q, vec, d1, d2, h, s) as ``query_rows`` makes them.
    """
    k = index.k
    found = search(index, queries)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x[: 8 * (k + 1 + extra)] for x in batch.column(1).to_pylist()]
            q = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.frombuffer(b"".join(held), I64))], ["q", "node"])

    pairs = found.select("q", "ids").mapInArrow(open_, "q long, node long")
    scored = pairs.join(index.nodes.select("node", "ids", F.col("vec").alias("x")), "node").join(queries.select("q", "vec"), "q")
    product = F.aggregate(F.zip_with("x", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    every = scored.select("q", F.explode("ids").alias("vec_id"), product.alias("score"))
    if exclude_own:
        every = every.filter("vec_id <> q")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows whose id ``every`` divides, the k nearest others found; stored.

    Nearness is the inner product, in double precision.  Null ids and vectors that are null, zero or hold null or non-finite
    components take no part.  Of several vectors of one id, the one of least hash counts; vectors of
    another length than most take no part.  Equal vectors tie and come by id.  Fewer candidates than k
    are all returned.  Tables without usable rows give none.
    """
    index = Index(rows, id_col, vec_col, k, **options)
    schema = "query_id long, rank int, vec_id long, score double"
    if not index.dim:
        index.close()
        return rows.sparkSession.createDataFrame([], schema)
    own = index.rows.filter(F.col("id") % every == 0).select(F.col("id").alias("q"), "d1", "d2", "vec")
    queries = stored(own.join(index.nodes.select("d1", "d2", "h", "s"), ["d1", "d2"]))
    out = stored(neighbours(index, queries))
    discard(queries)
    index.close()
    return out


def op11(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(embeddings)
