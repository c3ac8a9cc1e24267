"""Exact document fingerprints over canonical text.

Canonical text is NFKC-normalised, case-folded and has every run of white space folded into
one blank, none at the ends.  The fingerprint is the 128-bit XXH3 of its UTF-8 form as 32
hex digits.  ``exact_groups`` groups by fingerprint and then compares the canonical bytes
inside each bucket, so that a collision of digests never joins two different texts.

Null texts count as empty; all empty or blank texts are equal.  Repeated rows are members of
the same group.  Very long texts are hashed whole, row by row.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, is_small, map_arrow, modest_batches, release, rows_of, shuffle_width, small, texts

SPACE = re.compile(r"\s+")


def canonical(text: str) -> str:
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    text = SPACE.sub(" ", text.casefold()).strip()
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def fingerprint_of(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def fingerprint(text: str) -> str:
    return fingerprint_of(canonical(text).encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """An exact digest is all or nothing."""
    return 1.0 if a == b else 0.0


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fingerprint string")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id, n_copies): group_id is the least id with equal canonical bytes.

    Only texts in buckets of two or more are compared.  Copies merge before anything is
    shuffled, as the canonical bytes are a grouping key: a bucket costs its different texts once
    for every task that holds one, however many copies there are.  A bucket of several texts,
    which only a collision of 128-bit digests can make, is told apart by the bytes.
    """
    prints = cut(with_fingerprint(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    several = prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    several = cut(several)
    members = docs.select(id_col, text_col)
    shared = cut(prints.join(several, "fingerprint", "left_semi").select(F.col("id").alias("of")).distinct())
    if is_small(shared):  # the other rows' bytes need not be made
        members = members.join(F.broadcast(shared), F.col(id_col).eqNullSafe(F.col("of")), "left_semi")
    held = _canonical_bytes(members, id_col, text_col).join(small(several.select("fingerprint")), "fingerprint", "left_semi")
    alike = held.groupBy("fingerprint", "bytes").agg(F.count("*").alias("m"))
    torn = cut(alike.groupBy("fingerprint").agg(F.count("*").alias("texts")).filter("texts > 1").select("fingerprint"))
    parted = prints.join(several, "fingerprint", "left").select("id", "fingerprint", F.coalesce("least", "id").alias("group_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n_copies"))
    if not torn.isEmpty():
        inner = _canonical_bytes(docs, id_col, text_col).join(torn, "fingerprint", "left_semi")
        groups = inner.groupBy("fingerprint", "bytes").agg(F.min("id").alias("group_id"), F.count("*").alias("n_copies"))
        apart = inner.join(groups, ["fingerprint", "bytes"]).select("id", "fingerprint", "group_id", "n_copies")
        parted = parted.join(torn, "fingerprint", "left_anti").union(apart)
    return parted.withColumnRenamed("id", id_col)


def _canonical_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint, bytes): the canonical bytes of every row, compressed (equal if and only if they are)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3)
        words = [canonical(t).encode("utf-8", "surrogatepass") for t in texts(batch.column(1))]
        cols = [batch.column(0), pa.array([fingerprint_of(w) for w in words], pa.string()), pa.array([pack.compress(w) for w in words], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["id", "fingerprint", "bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, fingerprint string, bytes binary")


def edited(text: str, other: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


#: Sampled ids per range that the driver sees, to cut the table into ranges.
PER_RANGE = 100


def bounds_of(docs: DataFrame, id_col: str, parts: int) -> list:
    """Ids that cut the table into about ``parts`` ranges of equally many rows; at most parts - 1.

    They come from about PER_RANGE ids per range; ids of any ordered type will do.
    """
    if parts < 2:
        return []
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull())
    share = min(1.0, PER_RANGE * parts / max(1, ids.count()))
    got = sorted(r[0] for r in ids.sample(share, seed=7).collect())
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next) where next is the text of the row that follows by id; the last: the first.

    Rows are ordered by id, then text.  The table is cut into ranges of ids; the first row of
    every range also goes to the range before it, so each range is read in order on its own.
    Null ids come first.  Only the bounds (one id per range) reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = bounds_of(rows, "id", shuffle_width(spark))
    part = F.lit(0)
    if bounds:
        cuts = np.array(bounds, np.int64 if isinstance(bounds[0], int) else object)

        @F.pandas_udf("int")
        def range_of(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=cuts.dtype), side="right").astype("int32"))

        part = F.when(F.col("id").isNull(), 0).otherwise(range_of(F.coalesce("id", F.lit(bounds[0]))))
    rows = rows.withColumn("part", part.cast("int")).withColumn("guest", F.lit(0))
    key = F.struct(F.col("id").isNotNull().alias("k"), F.col("id"))
    firsts = {r["part"]: r["i"]["id"] for r in rows.groupBy("part").agg(F.min(key).alias("i")).collect()}
    order = sorted(firsts)
    guests = rows.filter("false")
    if order:
        before = spark.createDataFrame([(p, order[i - 1], int(i == 0)) for i, p in enumerate(order)], "p int, part int, wrap int")
        ids = [i for i in firsts.values() if i is not None]
        lead = rows.filter(F.col("id").isin(ids) | F.col("id").isNull()) if None in firsts.values() else rows.filter(F.col("id").isin(ids))
        lead = lead.groupBy("part", "id").agg(F.min("text").alias("text")).withColumnRenamed("part", "p")
        guests = lead.join(F.broadcast(before), "p").select("id", "text", "part", F.lit(1).alias("guest"))
    dealt = rows.union(guests).repartition(shuffle_width(spark), "part")
    dealt = dealt.sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "text")
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in rows_of(batches, 256):
            ids, words, nexts = [], [], []
            for id_, text, part, guest in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[2] == part:
                    ids.append(held[0]), words.append(held[1]), nexts.append(text)
                held = None if guest else (id_, text, part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(words, pa.string()), pa.array(nexts, pa.string())],
                ["id", "text", "next"],
            )

    return modest_batches(dealt.select("id", "text", "part", "guest")).mapInArrow(run, f"id {kind}, text string, next string")


def op4(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and exact groups.

    A null text counts as empty; a document that is alone is its own next one.  Of documents
    with one id, the next is told by their texts' order.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, other in zip(texts(batch.column(1)), texts(batch.column(2))):
            changed = edited(text, other)
            a, b, c = fingerprint(text), fingerprint(changed), fingerprint(other)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
            rows.append((len(text), sha, bytes.fromhex(a), bytes.fromhex(b), likeness(a, b), likeness(a, c)))
        names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    groups = exact_groups(docs).select(F.col("doc_id").alias("i"), F.unhex("fingerprint").alias("f"), "group_id", "n_copies").distinct()
    groups = cut(groups)
    release(docs.sparkSession)  # the compared bytes need not stay while whole texts are moved
    out = map_arrow(with_next(docs), run, schema)
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fingerprint") == F.col("f"))
    out = out.join(groups, same, "left").drop("i", "f")
    for c in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        out = out.withColumn(c, F.lower(F.hex(c)))
    return out
