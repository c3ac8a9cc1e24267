"""Exact repeated substrings by the interval tree of an enhanced suffix array.

The suffix array is sparse and cut into buckets.  In every window of ``length`` bytes the
least hash of its 32-byte grams (leftmost of equals) names an anchor, a choice that depends
on the window's bytes alone, so two equal windows have their anchors at the same place.  The
suffixes that start at anchors with equal grams form a bucket; only buckets of two or more
suffixes can hold a repeat.  A bucket's suffixes are sorted, their common prefixes scanned
with a stack, and every interval of the tree (a right-maximal prefix with all its
occurrences) is split by the interval tree of the text to the left of the anchors.  Where the
left extensions differ, the group is a maximal repeat; groups of at least ``length`` bytes
are kept with all occurrences, not just neighbouring ones.

Occurrences with the same bytes around the anchor are collapsed to a count before any text
is moved.  Parts of buckets of more than ``MAX_BUCKET`` different surroundings (a passage with
very many contexts) are not sorted in one task: their windows are compared by 128-bit digests in a
partially combined aggregation instead, which finds the same bytes.  Before that a wide bucket
is parted by what two equal windows must share: the text right before or right after the anchor.

Texts are handled as whole UTF-8 byte strings; a match never crosses documents, but may lie in
one document twice, overlapping or not.  Null texts count as empty.  Texts shorter than
``length`` hold no repeats.  Repeated rows are repeats of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, MAX_BROADCAST_ROWS, U64, binary_texts, cut, map_arrow, mix64, modest_batches, rows_of, shuffle_width

LENGTH = 400
GRAM = 32
#: Buckets wider than this are parted first; parts wider than MAX_BUCKET aren't sorted in one task.
NARROW, MAX_BUCKET = 2_048, 16_384
#: A window holds the SIDE bytes before its anchor or else the LENGTH - SIDE + 1 after it.
SIDE = 184
CHUNK = 1 << 19
PLACE = U64((1 << 20) - 1)
MASK64 = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte substrings, by doubling."""
    h, width = data.astype(U64) + U64(1), 1
    while width < GRAM:
        h = h[:-width] * U64((GOLDEN * (2 * width + 1)) & MASK64 | 1) + h[width:]
        width *= 2
    return mix64(h)


def anchors_of(text: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(anchor, first window start, last window start, gram hash): runs that cover all windows."""
    out: list[tuple[int, int, int, int]] = []
    last = len(text) - length
    for base in range(0, last + 1, CHUNK):
        end = min(base + CHUNK - 1, last)
        h = gram_hashes(np.frombuffer(text, np.uint8, end - base + length, base))
        low = (h & ~PLACE) | np.arange(len(h), dtype=U64)
        span, width = length - GRAM + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        at = (low & PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        ends = np.append(starts[1:] - 1, len(at) - 1)
        places = at[starts]
        grams = h[places].view(np.int64)
        out.extend(zip((places + base).tolist(), (starts + base).tolist(), (ends + base).tolist(), grams.tolist()))
    return out


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(key, a, s0, s1, gram, around) of every anchor; key: the text's MD5."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, text in enumerate(binary_texts(batch.column(1))):
            for a, s0, s1, g in anchors_of(text, length):
                seed = (a - s0) * 4096 + (s1 - s0)
                rows.append((a, s0, s1, g, signed(xxhash.xxh3_64_intdigest(text[s0 : s1 + length], seed))))
                at.append(i)
        keys = batch.column(0).take(pa.array(at, pa.int64()))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, cols, kinds)], ["key", "a", "s0", "s1", "gram", "around"])

    return map_arrow(docs.select("key", "text"), run, "key binary, a int, s0 int, s1 int, gram long, around long", 256)


def surroundings(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(gram, around, n, left, bytes): the text around one occurrence of each row of ``found``."""
    wanted = found.groupBy(F.col("rep.key").alias("key")).agg(
        F.collect_list(F.struct("gram", "around", "n", "rep.a", "rep.s0", "rep.s1")).alias("at")
    )
    if found.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    held = docs.select("key", "text").join(wanted, "key").dropDuplicates(["key"]).select("text", "at")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, at in zip(binary_texts(batch.column(0)), batch.column(1).to_pylist()):
            for x in at:
                rows.append((x["gram"], x["around"], x["n"], x["a"] - x["s0"], text[x["s0"] : x["s1"] + length]))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols, kinds)], ["gram", "around", "n", "left", "bytes"])

    return map_arrow(held, run, "gram long, around long, n long, left int, bytes binary", 64)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def prefix_intervals(lcp, first: int, last: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, prefix) of the intervals of the tree; lcp[i] joins sorted places i - 1 and i."""
    stack = [(-1, first)]
    for i in range(first + 1, last + 2):
        now = lcp[i] if i <= last else -1
        left = i - 1
        while now < stack[-1][0]:
            prefix, left = stack.pop()
            if prefix >= least:
                yield left, i - 1, prefix
        if now > stack[-1][0]:
            stack.append((now, left))


def maximal_repeats(buckets: list[list[tuple[int, bytes]]], length: int) -> Iterator[tuple[int, list[int], int, int]]:
    """(bucket, members, left, right): the groups whose left + right is at least ``length``.

    A bucket is a list of (bytes left of the anchor, bytes around it).  All buckets are sorted
    as one array; members are places in the bucket.
    """
    flat = [(k, j, left, data) for k, rows in enumerate(buckets) for j, (left, data) in enumerate(rows)]
    if len(flat) < 2:
        return
    width = max(length, 1)
    n = len(flat)
    right, before = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
    len_r, len_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, (_, _, left, data) in enumerate(flat):
        r = np.frombuffer(data, np.uint8, len(data) - left, left)
        len_r[i], len_l[i] = len(r), left
        right[i, : len(r)] = r
        if left:
            before[i, :left] = np.frombuffer(data, np.uint8, left)[::-1]
    bucket = np.array([f[0] for f in flat])

    def order_by(side: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        keyed = np.zeros((n, width + 7), np.uint8)
        keyed[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(n, 4)
        keyed[:, 4 : 4 + width] = side
        keyed[:, 4 + width : 6 + width] = lengths.astype(">u2").view(np.uint8).reshape(n, 2)
        keyed[:, -1] = 1
        return np.argsort(keyed.reshape(-1).view(f"S{width + 7}"), kind="stable")

    order = order_by(right, len_r)
    rank = np.empty(n, np.int64)
    rank[order_by(before, len_l)] = np.arange(n)
    x, y = order[:-1], order[1:]
    lcp = np.minimum(common_prefix(right[x], right[y]), np.minimum(len_r[x], len_r[y]))
    lcp[bucket[x] != bucket[y]] = -1
    pair_left = np.minimum(common_prefix(before[x], before[y]), np.minimum(len_l[x], len_l[y])).tolist()
    lcp = [-1, *lcp.tolist()]
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    places = [f[1] for f in flat]
    for first, stop in zip([0, *edges.tolist()], [*edges.tolist(), n]):
        k = int(bucket[order[first]])
        for lo, hi, r in prefix_intervals(lcp, first, stop - 1, GRAM):
            need = length - r
            if hi - lo == 1:
                if pair_left[lo] >= need:
                    yield k, [places[order[lo]], places[order[hi]]], pair_left[lo], r
                continue
            members = order[lo : hi + 1]
            members = members[np.argsort(rank[members], kind="stable")]
            p, q = members[:-1], members[1:]
            left = np.minimum(common_prefix(before[p], before[q]), np.minimum(len_l[p], len_l[q]))
            if left.max() < need:
                continue
            for f, t, shared in prefix_intervals([-1, *left.tolist()], 0, len(members) - 1, max(need, 0)):
                yield k, [places[m] for m in members[f : t + 1]], shared, r


def in_buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[list[tuple]]]:
    """Rows sorted by their first column as lists of whole buckets, about ``size`` rows each."""
    done, open_, held, at = [], [], 0, None
    for batch in rows_of(batches, 1024):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and open_:
                done.append(open_)
                held += len(open_)
                open_ = []
                if held >= size:
                    yield done
                    done, held = [], 0
            at = row[0]
            open_.append(row)
    if open_:
        done.append(open_)
    if done:
        yield done


def _entries(rows: list[tuple]) -> tuple[list[tuple[int, bytes]], list[int]]:
    """A bucket's suffixes; surroundings that occur more than once are in it twice."""
    entries, of = [], []
    for j, (_, _, _, n, left, data) in enumerate(rows):
        for _ in range(min(2, n)):
            entries.append((left, data))
            of.append(j)
    return entries, of


def tree_reach(around: DataFrame, length: int) -> DataFrame:
    """(gram, around, before, after): how far repeats reach from the anchor, by the tree.

    ``around`` has bucket, gram, around, n, left and bytes; rows of a bucket are sorted together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets in in_buckets(batches, 1_000):
            made = [_entries(rows) for rows in buckets]
            reach: dict[tuple[int, int], list[int]] = {}
            for k, members, left, right in maximal_repeats([m[0] for m in made], length):
                for j in {made[k][1][m] for m in members}:
                    best = reach.setdefault((k, j), [0, 0])
                    best[0], best[1] = max(best[0], left), max(best[1], right)
            rows = [(*buckets[k][j][1:3], *best) for (k, j), best in reach.items()]
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols, kinds)], ["gram", "around", "before", "after"])

    dealt = around.select("bucket", "gram", "around", "n", "left", "bytes")
    dealt = dealt.repartition(shuffle_width(around.sparkSession), "bucket").sortWithinPartitions("bucket")
    return modest_batches(dealt).mapInArrow(run, "gram long, around long, before int, after int")


def wide_reach(around: DataFrame, length: int, max_bucket: int) -> DataFrame:
    """Reach within wide buckets, parted by the text on either side of the anchor.

    Two equal windows share SIDE bytes before the anchor or length - SIDE + 1 from it on, so each
    row goes to at most two parts, and parts of one row hold no repeat.  Parts that are still
    too wide are compared window by window.
    """
    parts = _parted(around, length)
    out = tree_reach(parts.filter(F.col("k") <= max_bucket), length)
    wide = parts.filter(F.col("k") > max_bucket)
    if not wide.isEmpty():
        out = out.union(window_reach(wide.dropDuplicates(["gram", "around"]), length))
    return out


def _parted(around: DataFrame, length: int) -> DataFrame:
    """``around`` once for each side of the anchor that is long enough, by what it reads there; k: rows of the part."""
    side = min(SIDE, length // 2)
    before = F.when(F.col("left") >= side, F.xxhash64("gram", F.lit(0), F.expr(f"substring(bytes, left - {side} + 1, {side})")))
    after_size = length - side + 1
    after = F.when(F.length("bytes") - F.col("left") >= after_size, F.xxhash64("gram", F.lit(1), F.expr(f"substring(bytes, left + 1, {after_size})")))
    parts = around.withColumn("bucket", F.explode(F.array_compact(F.array(before, after))))
    width = parts.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("m")).filter("m > 1").drop("m")
    return cut(parts.join(cut(width), "bucket"))


def repeated_windows(around: DataFrame, length: int) -> DataFrame:
    """(gram, around, n, back, digest): the windows of hot parts that are found twice, compared by digest, one row each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, (n, left, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
            for s in range(len(data) - length + 1):
                rows.append((left - s, xxhash.xxh3_128_digest(data[s : s + length])))
                at.append(i)
        take = pa.array(at, pa.int64())
        cols = list(zip(*rows)) if rows else [(), ()]
        arrays = [batch.column(c).take(take) for c in (0, 1, 2)] + [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["gram", "around", "n", "back", "digest"])

    windows = map_arrow(around.select("gram", "around", "n", "left", "bytes"), run, "gram long, around long, n long, back int, digest binary", 64)
    again = windows.groupBy("gram", "digest").agg(F.sum("n").alias("m")).filter("m > 1").select("gram", "digest")
    return windows.join(again, ["gram", "digest"], "left_semi")


def window_reach(around: DataFrame, length: int) -> DataFrame:
    """Reach within parts that are too wide for one task."""
    hit = repeated_windows(around, length)
    return hit.groupBy("gram", "around").agg(
        F.max("back").cast("int").alias("before"), (F.lit(length) - F.min("back")).cast("int").alias("after")
    )


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("key", F.unhex(F.md5("text")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(key, spans) for texts with repeats: [from, to) byte ranges, unmerged. docs: key, text."""
    rows = cut(anchor_rows(docs, length))
    # Cut off: a join of two plain shuffles is one whose hot keys Spark can split.
    twice = cut(rows.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram"))
    rows = cut(rows.join(twice, "gram", "left_semi"))
    kinds = rows.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "a", "s0", "s1")).alias("rep"))
    kinds = with_width(kinds)
    # A surrounding found several times: its suffixes agree to both ends, a leaf of the tree.
    alike = kinds.filter("n > 1").select("gram", "around", (F.col("rep.a") - F.col("rep.s0")).alias("before"), (F.col("rep.s1") + length - F.col("rep.a")).alias("after"))
    some = surroundings(docs, kinds.filter(F.col("k").between(2, NARROW)), length).withColumn("bucket", F.col("gram"))
    reach = alike.union(tree_reach(some, length))
    wide = kinds.filter(F.col("k") > NARROW)
    if not wide.isEmpty():
        reach = reach.union(wide_reach(cut(surroundings(docs, wide, length)), length, max_bucket))
    spans = rows.join(reach, ["gram", "around"]).select("key", F.struct((F.col("a") - F.col("before")).alias("f"), (F.col("a") + F.col("after")).alias("t")).alias("s"))
    return spans.groupBy("key").agg(F.collect_set("s").alias("spans"))


def with_width(kinds: DataFrame) -> DataFrame:
    """``kinds`` with k, the number of different surroundings of the gram, and m, of all occurrences."""
    width = cut(kinds.groupBy("gram").agg(F.count("*").alias("k"), F.sum("n").alias("m")))
    return cut(kinds.join(width, "gram"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, narrow: int = NARROW, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(group, id, start, length): maximal repeats with all occurrences, within their windows.

    A group's bytes reach as far as the windows around its anchor do; a longer passage is
    reported as several overlapping groups.  Buckets of over ``narrow`` surroundings are parted
    by the text on either side of the anchor, which all members of a group share on one side
    at least, so every group is whole in one part.  Parts of over ``max_bucket`` surroundings give
    a group for every repeated window of ``length`` bytes, with all its occurrences, and do not
    join neighbouring windows to a longer one.  Repeated rows are repeats of each other, reported once.
    """
    texts_ = cut(_keyed(docs.select(F.col(id_col).alias("id"), text_col), text_col).select("id", "key", "text"))
    rows = cut(anchor_rows(texts_, length))
    kinds = rows.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "a", "s0", "s1")).alias("rep"))
    kinds = with_width(kinds)
    around = cut(surroundings(texts_, kinds.filter("m > 1"), length).join(kinds.select("gram", "around", "k"), ["gram", "around"]))
    few, wide = around.filter(F.col("k") <= narrow).drop("k"), around.filter(F.col("k") > narrow).drop("k")
    parts = _parted(wide, length)
    dealt = few.withColumn("bucket", F.col("gram")).union(parts.filter(F.col("k") <= max_bucket).drop("k").select(*few.columns, "bucket"))
    hot = parts.filter(F.col("k") > max_bucket).dropDuplicates(["gram", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets in in_buckets(batches, 1_000):
            made = [_entries(rows) for rows in buckets]
            out = []
            for k, members, left, right in maximal_repeats([m[0] for m in made], length):
                before, data = made[k][0][members[0]]
                shared = xxhash.xxh3_128_digest(data[before - left : before + right])
                out.extend((shared, *buckets[k][j][1:3], left, right) for j in sorted({made[k][1][m] for m in members}))
            cols = list(zip(*out)) if out else [()] * 5
            kinds_ = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols, kinds_)], ["group", "gram", "around", "before", "after"])

    dealt = dealt.select("bucket", "gram", "around", "n", "left", "bytes")
    dealt = dealt.repartition(shuffle_width(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    groups = modest_batches(dealt).mapInArrow(run, "group binary, gram long, around long, before int, after int")
    groups = groups.union(repeated_windows(hot, length).select("digest", "gram", "around", F.col("back").cast("int"), (length - F.col("back")).cast("int")))
    found = rows.select("key", "a", "gram", "around").join(cut(groups), ["gram", "around"])
    found = found.select("group", "key", (F.col("a") - F.col("before")).alias("start"), (F.col("before") + F.col("after")).alias("length")).distinct()
    return found.join(texts_.select("id", "key").distinct(), "key").select(F.hex("group").alias("group"), F.col("id").alias(id_col), "start", "length")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for f, t in sorted(spans):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([f, t])
    return [tuple(x) for x in out]


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, kept, runs): the bytes that are left and the maximal removed runs of every row."""
    keyed = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col)), text_col).select("id", "key", "text")
    spans = repeated_spans(keyed, length, max_bucket)
    joined = keyed.join(spans, "key", "left").select("id", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, runs = [], []
        for text, found in zip(binary_texts(batch.column(1)), batch.column(2).to_pylist()):
            cuts = merged([(s["f"], s["t"]) for s in found or ()])
            at, parts = 0, []
            for f, t in cuts:
                parts.append(text[at:f])
                at = t
            kept.append(b"".join([*parts, text[at:]]))
            runs.append([{"f": f, "t": t} for f, t in cuts])
        kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(runs, kind)], ["id", "kept", "runs"])

    kind = keyed.schema["id"].dataType.simpleString()
    return map_arrow(joined, run, f"id {kind}, kept binary, runs array<struct<f:int,t:int>>", 256).withColumnRenamed("id", id_col)


def op10(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row without the 400-byte strings that start elsewhere too.

    Null texts count as empty and keep the digest of nothing.  Repeated rows hold each other's strings, so of texts of
    400 bytes or more nothing is left.  An empty table has no rows; other columns play no part.
    """
    out = removed(docs, max_bucket=max_bucket)
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["t"] - r["f"]))
    return out.select(
        "doc_id",
        (F.length("kept") + gone).alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
