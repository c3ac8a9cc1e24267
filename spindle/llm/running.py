"""Ranks and prefix sums within groups, without a task that holds a whole group.

Rows are range-partitioned by (group, order) and sorted within partitions; each task numbers its
rows and adds up its sums as they stream by.  A group that spans partitions gets its offsets
from a table with one row a partition, the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import shuffle_width, stored


def _within(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums of ``values`` that start anew where ``starts`` is true (or at the first row)."""
    total = np.cumsum(values)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(values)), 0))
    return total - np.where(first > 0, total[np.maximum(first - 1, 0)], 0)


def ranked(df: DataFrame, group: list[str], order: list[Column], sums: list[str] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 0, within its group by ``order``) and its ``sums`` columns made running.

    The sums (longs, no nulls) include the row itself.  ``df`` should be a written table: it is read twice, for
    the ranges and for the rows.  Rows equal in group and order are dealt by a fixed random
    number, so that many of them don't meet in one partition; which of them comes first is
    left open.  ``df`` has no columns rank, __g, __part, __seq and __tie.  The result is stored.
    """
    keyed = df.withColumns({"__g": F.xxhash64(*group) if group else F.lit(0).cast("long"), "__tie": F.rand(11)})
    by = [*map(F.col, group), *order, F.col("__tie")]
    dealt = keyed.repartitionByRange(shuffle_width(df.sparkSession), *by).sortWithinPartitions(*by).drop("__tie")
    names = [*df.columns, "__g", "rank", "__part", "__seq"]
    g_at, sum_at = len(df.columns), [df.columns.index(c) for c in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last = TaskContext.get().partitionId(), 0, None
        carry = [0] * (1 + len(sum_at))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(g_at).to_numpy()
            starts = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            open_ = ~np.logical_or.accumulate(starts)  # rows that go on with the last batch's group
            columns, ran = list(batch.columns), []
            for k, values in enumerate([np.ones(n, np.int64), *(batch.column(c).to_numpy() for c in sum_at)]):
                ran.append(_within(starts, values) + np.where(open_, carry[k], 0))
            carry = [int(r[-1]) for r in ran]
            for c, values in zip(sum_at, ran[1:]):
                columns[c] = pa.array(values)
            columns += [pa.array(ran[0] - 1), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n))]
            seq, last = seq + n, g[-1]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([*dealt.schema.fields, *(StructField(c, t) for c, t in (("rank", LongType()), ("__part", IntegerType()), ("__seq", LongType())))])
    local = stored(dealt.mapInArrow(run, schema))
    ends = F.struct("__g", "rank", *sums)
    edges = local.groupBy("__part").agg(F.min_by("__g", "__seq").alias("head"), F.max_by(ends, "__seq").alias("tail")).collect()
    offsets, carry, last = [], [0] * (1 + len(sums)), None
    for e in sorted(edges, key=lambda e: e["__part"]):
        here = [e["tail"]["rank"] + 1, *(e["tail"][c] for c in sums)]
        if e["head"] == last:
            offsets.append((e["__part"], last, *carry))
        alone = e["head"] == e["tail"]["__g"]
        carry = [x + y for x, y in zip(carry, here)] if alone and e["head"] == last else here
        last = e["tail"]["__g"]
    # One row a partition at most, and one that matches nothing.
    before = df.sparkSession.createDataFrame(offsets or [(-1, 0, *carry)], ", ".join(["__part int", "__g long", *(f"__o{k} long" for k in range(1 + len(sums)))]))
    out = local.join(F.broadcast(before), ["__part", "__g"], "left")
    moved = {c: F.col(c) + F.coalesce(F.col(f"__o{k}"), F.lit(0)) for k, c in enumerate(["rank", *sums])}
    out = out.withColumns(moved).select(*df.columns, "rank")
    out._stored_in = local._stored_in
    return out
