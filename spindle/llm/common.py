"""Shared helpers of the text operators: lineage cuts, components, word tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import LOT, forests, least_of  # noqa: F401

U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = read_table(spark, sf_dir, "documents")
    return df.select(*cols) if cols else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where the setting is absent (local tests only) a temporary folder takes its place; on a
    cluster a machine-local folder would not be shared, so that is an error.
    """
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
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of at most a few dozen bytes that may be sent to every task.
MAX_BROADCAST_ROWS = 500_000


def is_small(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """``df`` (materialised, narrow rows) marked for broadcast if it is counted to be small.

    A larger one is joined by shuffle; the result is the same.
    """
    return F.broadcast(df) if is_small(df) else df


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of frames that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: smaller than a checkpoint."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t._stored_in)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or the first variant of it that clashes with no column of the caller's."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def text_key(rows: DataFrame, *cols: str) -> Column:
    """A 64-bit key of the columns that no two different values share.

    XXH64, but for keys that a count by 128-bit digests finds under several values: those are
    hashed again with a salt.  At 10^10 values about three are expected, so few reach the driver.
    """
    salts: list[list[int]] = []
    whole = F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols)))

    def key() -> Column:
        out = F.xxhash64(*cols)
        for salt, shared in enumerate(salts, 1):
            out = F.when(out.isin(shared), F.xxhash64(*cols, F.lit(salt))).otherwise(out)
        return out

    while True:
        prints = rows.select(key().alias("k"), whole.alias("p")).groupBy("k").agg(F.min("p").alias("x"), F.max("p").alias("y"))
        shared = [r["k"] for r in prints.filter("x <> y").select("k").collect()]
        if not shared:
            return key()
        salts.append(shared)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def xor_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise over uint64."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class WordTable(dict):
    """Word -> XXH64, computed once per word and worker; emptied when it grows too large."""

    limit = 500_000

    def __missing__(self, word):
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def word_hashes(table: WordTable, words: list) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), U64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of every run of n words (one of the whole if shorter)."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, U64)
    for i in range(n):
        out = out * U64(GOLDEN) + words[i : i + len(out)]
    return mix64(out)


def distinct_sorted(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


#: Rows that Spark packs into one Arrow batch at most: some megabytes of texts, where its default would take ten times that.
BATCH_ROWS = 1_024


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches made small enough for whole texts (a larger setting is lowered)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices small enough that whole texts stay within a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = 512) -> DataFrame:
    """``df`` with ``fn`` applied to small record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, size):
            yield fn(batch)

    return modest_batches(df).mapInArrow(run, schema)


def binary_texts(column: pa.Array) -> list:
    """Texts as UTF-8 bytes; a null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list:
    return [t or "" for t in column.to_pylist()]


def components(edges: DataFrame, lot: int = LOT) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b), which are longs; component: least node.

    Each task first settles the links it has, ``lot`` at a time, and so do fewer tasks for what they leave, as long as
    that makes them less: a small graph takes no shuffle.  Where more than a lot is left,
    alternating large-star and small-star contraction goes on: each round is two aggregations by key
    with partial combining, and the number of rounds grows with the logarithm of the size.
    Only a count and a checksum reach the driver.
    """
    links, before = cut(forests(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), lot)), None
    while (n := links.count()) > lot and (before is None or n <= 0.7 * before):
        links, before = cut(forests(links.coalesce(-(-n // lot)), lot)), n
    if n <= lot:
        links = cut(forests(links.coalesce(1), lot + 1))
    seen = None
    while n > lot:
        mark = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark["n"], mark["x"]) == seen:
            break
        seen = (mark["n"], mark["x"])
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(down.union(root.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
