"""Bond graphs: merged edges, expansion, components, distance-based bonds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..structure import Structure
from . import spatial


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: smaller than a checkpoint, and read by columns."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def merged_edges(edges: DataFrame) -> DataFrame:
    """(a < b, flags, order): repeated edges merged, flags united, the highest order kept."""
    rows = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce(F.col("flags").cast("int"), F.lit(1)).alias("flags"), F.col("order").cast("int").alias("order"))
    return rows.groupBy("a", "b").agg(F.bit_or("flags").alias("flags"), F.max("order").alias("order"))


def bond_graph(s: Structure) -> DataFrame:
    """The pinned graph, or the explicit bonds and links of a structure, or bonds by rules if it has none."""
    cols = ["a", "b", "flags", "order"]
    if s.edges is not None:
        return s.edges
    if s.bonds is None:
        from .bonding import computed_bonds

        return computed_bonds(s)
    parts = [t.select(*cols) for t in (s.bonds, s.links) if t is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merged_edges(out)


def distance_bonds(s: Structure, padding: float = 0.45, inter_chain: bool = True) -> DataFrame:
    """Atoms nearer than the sum of their covalent radii plus ``padding``, model by model."""
    at = s.wide().select("atom", "x", "y", "z", "element", "altloc", "residue", "chain", "model")
    at = at.withColumn("cov", S.lookup(F.col("element").cast("int"), S.COVALENT_RADII)).filter("cov is not null")
    reach = 2 * max(S.COVALENT_RADII.values()) + padding
    apart = (F.col("l.residue") == F.col("r.residue")) & (F.col("l.altloc") != "") & (F.col("r.altloc") != "") & (F.col("l.altloc") != F.col("r.altloc"))
    on = (F.col("l.atom") < F.col("r.atom")) & ~apart
    on = on & (F.sqrt(spatial.squared_distance("l", "r")) <= F.col("l.cov") + F.col("r.cov") + F.lit(padding))
    if not inter_chain:
        on = on & (F.col("l.chain") == F.col("r.chain"))
    pairs = spatial.near_pairs(at, at, reach, on, ("model",))
    return pairs.select(F.col("l_atom").alias("a"), F.col("r_atom").alias("b"), F.lit(33).alias("flags"), F.lit(1).alias("order"))


def with_lengths(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    at = atoms.select("atom", *(F.col(c).cast("double") for c in "xyz"))
    out = edges
    for end in "ab":
        out = out.join(at.select(F.col("atom").alias(end), *(F.col(c).alias(f"{end}{c}") for c in "xyz")), end)
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    return out.withColumn("length", F.sqrt(d2)).drop(*(f"{e}{c}" for e in "ab" for c in "xyz"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected edge list."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def expand(nodes: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """Nodes within ``layers`` steps."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(layers):
        nodes = nodes.union(nodes.join(both.withColumnRenamed("a", "node"), "node").select(F.col("b").alias("node"))).distinct()
    return nodes


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node that the given ones are connected to, themselves included."""
    parts = components(edges, nodes)
    have = parts.join(nodes.distinct(), "node", "left_semi").select("component").distinct()
    return parts.join(have, "component", "left_semi").select("node")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node of each component; alternating star contraction."""
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark["n"], mark["x"]) == seen or not mark["n"]:
            break
        seen = (mark["n"], mark["x"])
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(down.union(root.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    found = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    found = found.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return found
    alone = nodes.select("node").distinct().join(found, "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))


#: Links that a task settles by itself, a few megabytes.
LOT = 1 << 18


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        still = low < high
        if not still.any():
            return nodes, nodes[root]
        a, b = a[still], b[still]
        np.minimum.at(root, high[still], low[still])
        while (root[root] != root).any():
            root = root[root]


def forests(links: DataFrame, lot: int) -> DataFrame:
    """(u, v): each task's links, ``lot`` at a time, with every node linked to the least one it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= lot:
                u, v = least_of(*map(np.concatenate, zip(*held)))
                held, size = [(u[u > v], v[u > v])], int((u > v).sum())
                if size >= lot // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["u", "v"])
                    held, size = [], 0
        if size:
            u, v = least_of(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u[u > v]), pa.array(v[u > v])], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components_by_ranges(edges: DataFrame, lot: int = LOT) -> DataFrame:
    """``components`` of links (a, b), which are longs, where most join nodes of neighbouring ids; any others give the same result.

    Links go by ranges of a into tasks, which settle them ``lot`` at a time; joins are for those roots only that meet in a node.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    stars = stored(forests(links.repartitionByRange("v").sortWithinPartitions("v"), lot))
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")))
    held = stored(roots.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    torn = held.filter("least <> most").select("node", "least")
    if torn.isEmpty():
        return held.select("node", F.col("least").alias("component"))
    joined = roots.join(torn, "node").filter("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
    whole = cut(components(joined).withColumnRenamed("node", "least"))
    return held.join(whole, "least", "left").select("node", F.coalesce("component", "least").alias("component"))
