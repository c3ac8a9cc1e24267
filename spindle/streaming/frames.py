"""Streams of frames: metrics per frame and the latest snapshot per owner, within a batch or across all.

The frame's time is the event time; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors as V


def frame_metrics(stream: DataFrame, reference: DataFrame, late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """(window, frame, n, rmsd) of a stream with columns ts, frame, atom, x, y, z."""
    ref = F.broadcast(reference.select("atom", *(F.col(c).cast("double").alias(f"r{c}") for c in "xyz")))
    d = V.sub(V.vec(), V.vec("r"))
    rows = stream.withWatermark("ts", late).join(ref, "atom")
    return rows.groupBy(F.window("ts", window), "frame").agg(F.count("*").alias("n"), F.sqrt(F.avg(V.dot(d, d))).alias("rmsd"))


def latest_snapshots(batch: DataFrame) -> DataFrame:
    """The newest generation of each owner in a batch (owner, generation, ...)."""
    top = batch.groupBy("owner").agg(F.max("generation").alias("generation"))
    return batch.join(top, ["owner", "generation"])


def publish_latest(stream: DataFrame, sink, every: str = "250 milliseconds"):
    """Start a query that hands each micro-batch's newest snapshots to ``sink(df, batch_id)``."""
    return stream.writeStream.trigger(processingTime=every).foreachBatch(lambda df, n: sink(latest_snapshots(df), n))


def resolved_snapshots(stream: DataFrame, roots: DataFrame) -> DataFrame:
    """Snapshots (owner, dataset, topology, generation, ...) with ``status``.

    roots: (owner, dataset, topology) as they are now.  ``foreign``: of another data set or of an owner without a root; ``stale``: of another
    topology; else ``ready``.
    """
    now = roots.select("owner", F.col("dataset").alias("__dataset"), F.col("topology").alias("__topology"))
    foreign = F.col("__dataset").isNull() | ~F.col("dataset").eqNullSafe(F.col("__dataset"))
    status = F.when(foreign, "foreign").when(~F.col("topology").eqNullSafe(F.col("__topology")), "stale").otherwise("ready")
    return stream.join(now, "owner", "left").withColumn("status", status).drop("__dataset", "__topology")


def newest_snapshots(stream: DataFrame) -> DataFrame:
    """The rows (owner, generation, ...) of a stream that are newer than all that came before of their owner.

    The newest generation of each owner is state, so what an earlier batch has outrun stays out in later ones, after a
    restart from the checkpoint too.  Of a batch only an owner's newest generation comes out.  Null owners and
    generations take no part.
    """
    names = stream.columns

    def keep(key: tuple, tables: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        held, found = [], last
        for table in tables:
            newest = int(table["generation"].max())
            if found is None or newest > found:
                held, found = [], newest
            if last is None or found > last:
                held.append(table[table["generation"] == found])
        if found != last:
            state.update((found,))
        yield pd.concat(held)[names] if held else pd.DataFrame({n: [] for n in names})

    rows = stream.filter(F.col("owner").isNotNull() & F.col("generation").isNotNull())
    return rows.groupBy("owner").applyInPandasWithState(keep, stream.schema, "generation long", "append", "NoTimeout")
