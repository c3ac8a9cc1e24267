"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's words form lines of equal blocks (``block`` words).  The mix has as many blocks
as the corpus holds; they go to the sources by the highest quotients target / (2 seats + 1),
then within each source to its shards by the highest quotients of their sizes, so that every
shard has an integer quota.  A shard takes whole passes over its line as long as its quota
lasts, and the rest of the quota as blocks in a seeded order.  Shards hold about
``shard_words`` words whatever the corpus holds, so a hot source only has more of them.

Only one row per source reaches the driver.  Null and empty texts have size 0 and take 0;
a null source is a source of its own; repeated rows are counted and taken one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, cut, mix64

WORD = r"[^\x20\x09-\x0D]+"
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sainte_lague(sizes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients size / (2 seats + 1), at most ``most`` each; ties: first."""
    sizes, most = np.asarray(sizes, float), np.asarray(most, np.int64)
    most = np.where(sizes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(sizes), np.int64)
    have = np.minimum(np.floor(sizes * (seats / sizes.sum()) + 0.5).astype(np.int64), most)
    short = seats - int(have.sum())
    if short > 0:
        heap = [(-sizes[i] / (2 * have[i] + 1), i) for i in range(len(sizes)) if have[i] < most[i]]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heapq.heappop(heap)
            have[i] += 1
            if have[i] < most[i]:
                heapq.heappush(heap, (-sizes[i] / (2 * have[i] + 1), i))
    elif short < 0:
        heap = [(sizes[i] / (2 * have[i] - 1), -i) for i in range(len(sizes)) if have[i] > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            have[-i] -= 1
            if have[-i] > 0:
                heapq.heappush(heap, (sizes[-i] / (2 * have[-i] - 1), i))
    return have


def targets_of(sizes: list[int], weights: tuple[float, ...], cap: float) -> list[float]:
    """Shares of the whole by repeating weights; what exceeds the cap is shared again."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if unit * weights[i % len(weights)] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def take_blocks(sizes: np.ndarray, seats: int, block: int, seed: int) -> np.ndarray:
    """Words taken of each document of a shard, laid end to end, for a quota of blocks."""
    ends = np.cumsum(sizes)
    words = int(ends[-1]) if len(ends) else 0
    blocks = -(-words // block)
    if not blocks:
        return np.zeros(len(sizes), np.int64)
    passes, rest = divmod(int(seats), blocks)
    order = np.argsort(mix64(np.arange(blocks, dtype=U64) * U64(GOLDEN) + U64(seed & 0xFFFFFFFFFFFFFFFF)), kind="stable")
    lengths = np.zeros(blocks, np.int64)
    lengths[order[:rest]] = block
    starts = np.concatenate([[0], np.cumsum(lengths)])

    def before(at: np.ndarray) -> np.ndarray:
        full = at // block
        inside = np.where(full < blocks, lengths[np.minimum(full, blocks - 1)] > 0, False)
        return starts[np.minimum(full, blocks)] + np.where(inside, at - full * block, 0)

    return passes * sizes + before(ends) - before(ends - sizes)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    block: int = 16,
    shard_words: int = 1 << 21,
    seed: int = 7,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row."""
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    found = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [n for _, n in found]
    goals = targets_of(sizes, weights, cap)
    blocks = [cap * -(-n // block) for n in sizes]
    seats = sainte_lague(np.array(goals), round(sum(sizes) / block), np.array(blocks))
    rows = [
        (s, k, n, g, int(q), max(1, -(-n // shard_words)))
        for k, ((s, n), g, q) in enumerate(zip(found, goals, seats))
    ]
    kind = docs.schema[source_col].dataType.simpleString()
    plan = spark.createDataFrame(rows, f"source {kind}, k int, source_size long, target double, seats long, shards long")
    plan = F.broadcast(plan) if len(rows) <= MAX_BROADCAST_SOURCES else plan
    dealt = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    dealt = dealt.select("id", "d.source", "size", "k", "source_size", "target", "seats", "shards")
    dealt = dealt.withColumn("o", F.xxhash64("id", F.lit(seed)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("o"), F.col("shards")))
    none = dealt.filter("size = 0").select("id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))

    def quotas(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("shard", ignore_index=True)
        size = table["words"].to_numpy(np.int64)
        most = cap * -(-size // block)
        return pd.DataFrame({"k": table["k"], "shard": table["shard"], "quota": sainte_lague(size, table["seats"].iat[0], most)})

    full = dealt.filter("size > 0")
    shards = full.groupBy("k", "shard", "seats").agg(F.sum("size").alias("words"))
    quota = shards.groupBy("k").applyInPandas(quotas, "k int, shard long, quota long")

    id_kind = docs.schema[id_col].dataType.simpleString()

    def take(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["o", "id", "size"], ignore_index=True)
        seed_here = (seed << 48) ^ (int(key[0]) << 32) ^ int(key[1])
        taken = take_blocks(table["size"].to_numpy(np.int64), int(table["quota"].iat[0]), block, seed_here)
        return table[["id", "source", "size", "source_size", "target"]].assign(taken=taken)

    some = (
        full.join(quota, ["k", "shard"])
        .select("k", "shard", "id", "source", "size", "source_size", "target", "o", "quota")
        .groupBy("k", "shard")
        .applyInPandas(take, f"id {id_kind}, source {kind}, size long, source_size long, target double, taken long")
    )
    return some.union(none).withColumnsRenamed({"id": id_col, "source": source_col})


def op7(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
