"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits).  Two fingerprints that
differ in at most five bits have a segment that differs in at most one, so they agree on that
segment with one bit taken out.  Every fingerprint is indexed under its 64 one-wildcard
segment variants, an equality join of the variants finds the candidates, and the whole
fingerprints (and, on request, the shingle sets) verify them.

Equal fingerprints are collapsed before the join.  Dense clusters are collapsed as well: a
first pass links each fingerprint to the least one that shares two whole segments with it
(linear in the input), and the variant join then only returns pairs from different clusters,
each at its first matching variant, so a group of near copies never yields all its pairs.

Nulls and empty texts have the zero fingerprint and are linked like any other.  Repeated rows
and repeated ids are kept; ``component_id`` is the least id of the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, WordTable, binary_texts, components, cut, discard, distinct_sorted, free_name, map_arrow, mix64, modest_batches, release, rows_of, shingle_hashes, small, stored, word_hashes, xor_bits

SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_DISTANCE = 5
CHUNK = 1 << 16
#: A shingle that more texts share, besides the largest cluster's, comes late in the prefixes' order.
COMMON = 50
#: Fingerprints of a text in the near-duplicate search; texts of under FEW shingles have none.
PRINTS, FEW = 4, 16
FPS = [f"fp{j}" for j in range(PRINTS)]
#: Nodes whose sets are held together, on either side, when pairs are compared.
NODES_A_BLOCK = 1_000
#: Turns of leaders go on, TURNS at most, while they help and more pairs than these for each shared shingle of a text are left.
PAIRS_A_ROW, TURNS = 4, 8
#: Shared shingles of a text up to which the rest of them go with each, so that a pair comes out once.
FEW_KEYS = 128
#: Shingles put last at most: what the driver holds of them. All others keep their place.
MAX_LATE = 1 << 19


def shingle_digests(words: list[bytes], n: int, seed: int = 42) -> list[int]:
    """XXH64 of every run of n space-joined words, repeats included."""
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: len(words) - n]]
    f = xxhash.xxh64_intdigest
    return [f(joined[s:e], seed) for s, e in zip(starts, ends[n - 1 :])]


def fingerprints_of(hashes: np.ndarray, count: int) -> list[int]:
    """``count`` signed 64-bit fingerprints; the first from the hashes, the others from mixes."""
    out = []
    for j in range(count):
        h = hashes if j == 0 else mix64(hashes + U64((j * GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            part = np.ascontiguousarray(h[at : at + CHUNK]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(h), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, count: int = 1) -> DataFrame:
    """(id, fp0 .. fp<count-1>) of the whole texts, lower-cased in A-Z."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in binary_texts(batch.column(1)):
            hashes = np.array(shingle_digests(text.lower().split(), words), U64)
            rows.append(fingerprints_of(hashes, count))
        cols = list(zip(*rows)) if rows else [()] * count
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], [id_col, *(f"fp{j}" for j in range(count))]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"fp{j} bigint" for j in range(count))
    return map_arrow(docs.select(id_col, text_col), run, schema)


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _coarse_keys(fps: list[str]) -> Column:
    """Two whole segments of each fingerprint: keys for linking dense clusters."""
    keys = []
    for j, fp in enumerate(fps):
        for k, (shift, width) in enumerate(SEGMENTS):
            gap = ((1 << width) - 1) << shift
            mask = ~gap & 0xFFFFFFFFFFFFFFFF
            mask = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(j * 3 + k).cast("int").alias("part"), F.col(fp).bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def with_variants(reps: DataFrame, fp: str, number: int) -> DataFrame:
    """``reps`` once for each one-wildcard variant of ``fp``; key: (bit taken out, rest of segment)."""
    bits = reps.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__bit"))
    cases = " ".join(f"WHEN __bit < {shift + width} THEN {shift}" for shift, width in SEGMENTS)
    bits = bits.withColumn("__shift", F.expr(f"CASE {cases} END"))
    bits = bits.withColumn("__width", F.expr(f"CASE __shift WHEN {SEGMENTS[2][0]} THEN {SEGMENTS[2][1]} ELSE {SEGMENTS[0][1]} END"))
    bits = bits.withColumn("__part", F.expr(f"shiftrightunsigned({fp}, __shift) & (shiftleft(1L, __width) - 1)"))
    bits = bits.withColumn("__at", F.expr("__bit - __shift"))
    rest = "(__part & (shiftleft(1L, __at) - 1)) + shiftleft(shiftright(__part, __at + 1), __at)"
    return bits.select(*reps.columns, F.expr(f"shiftleft(CAST(__bit + {64 * number} AS BIGINT), 21) + {rest}").alias("key"))


def _first_variant(xors: list[Column]) -> Column:
    """Number of the first variant that a pair with these differing bits shares."""
    out = F.lit(-1)
    for j in reversed(range(len(xors))):
        for shift, width in reversed(SEGMENTS):
            d = _segment(xors[j], shift, width)
            bit = F.when(d == 0, F.lit(0)).otherwise(F.bit_count(d - 1))
            out = F.when(F.bit_count(d) <= 1, bit + F.lit(j * 64 + shift)).otherwise(out)
    return out


def _distance(fps: list[str], a: str, b: str) -> Column:
    out = xor_bits(F.col(f"{a}.{fps[0]}"), F.col(f"{b}.{fps[0]}"))
    for fp in fps[1:]:
        out = out + xor_bits(F.col(f"{a}.{fp}"), F.col(f"{b}.{fp}"))
    return out


def coarse_links(reps: DataFrame, fps: list[str], within: int) -> DataFrame:
    """(a, b): each node and the least node with two equal segments, if near enough. Linear."""
    keyed = reps.select("node", *fps, F.explode(_coarse_keys(fps)).alias("key"))
    least = keyed.groupBy("key").agg(F.min_by(F.struct("node", *fps), "node").alias("l"), F.count("*").alias("n"))
    near = keyed.alias("x").join(least.filter("n > 1").select("key", "l.*").alias("y"), "key")
    near = near.filter((F.col("x.node") != F.col("y.node")) & (_distance(fps, "x", "y") <= within))
    return near.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()


def variant_links(reps: DataFrame, fps: list[str], within: int, number: int = 0) -> DataFrame:
    """(a, b): pairs from different clusters near enough, by the variants of one fingerprint.

    ``reps`` holds node, cluster and the fingerprints.  Over all numbers each pair comes out
    once, at its first shared variant.
    """
    keyed = with_variants(reps.select("node", "cluster", *fps), fps[number], number)
    x, y = keyed.alias("x"), keyed.alias("y")
    xors = [F.col(f"x.{fp}").bitwiseXOR(F.col(f"y.{fp}")) for fp in fps]
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.cluster") != F.col("y.cluster"))
        & (_distance(fps, "x", "y") <= within)
        & (F.shiftright(F.col("x.key"), 21) == _first_variant(xors).cast("long")),
    )
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def with_component(df: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of ``node``: itself where it has no link."""
    right = parts.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    out = df.join(right, F.col(node) == F.col("__node"), "left")
    return out.withColumn(name, F.coalesce("__component", node)).drop("__node", "__component")


def hamming_components(prints: DataFrame, id_col: str = "doc_id", within: int = 4) -> DataFrame:
    """(id, fp0, component_id): components of the graph of fingerprints within ``within`` bits."""
    if within > MAX_DISTANCE:
        raise ValueError(f"three segments find pairs of at most {MAX_DISTANCE} differing bits")
    prints = cut(prints)
    reps = cut(prints.groupBy("fp0").agg(F.min(id_col).alias("first")).select(F.col("fp0").alias("node"), "fp0", "first"))
    near = cut(coarse_links(reps, ["fp0"], within))
    clusters = components(near)
    grouped = with_component(reps, clusters, "node", "cluster")
    links = near.union(variant_links(grouped, ["fp0"], within))
    whole = with_component(reps, components(links), "node", "part")
    least = whole.groupBy("part").agg(F.min("first").alias("component_id"))
    of = whole.join(least, "part").select(F.col("fp0").alias("__fp"), "component_id")
    return prints.join(of, F.col("fp0") == F.col("__fp")).drop("__fp")


def sketch(text: bytes, table: WordTable, words: int) -> tuple[bytes, np.ndarray]:
    """The text with A-Z and white space folded, and its sorted distinct shingle hashes."""
    tokens = text.lower().split()
    return b" ".join(tokens), distinct_sorted(shingle_hashes(word_hashes(table, tokens), words))


def prefix_of(own: np.ndarray, similarity: float, late: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of n sorted shingles; those in ``late`` (sorted) come after all others.

    Two sets of that similarity share one of their first ones, whatever the order, if it is the
    same for all texts.
    """
    if len(late) and len(own):
        at = np.minimum(np.searchsorted(late, own), len(late) - 1)
        own = own[np.argsort(late[at] == own, kind="stable")]
    return own[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1] if len(own) else own


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, late: list[int] = ()) -> DataFrame:
    """(i, raw, k1, k2, fp0 .. , n, prefix) of every row, in one pass over the texts.

    raw: the text's XXH64 as Spark has it; k1, k2: 128 bits of the folded text; n: its shingles; the fingerprints
    are null for texts of under FEW shingles; prefix: packed hashes, null where the task has met
    the text before.
    """
    last = np.array(sorted(late), U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = WordTable(), set()
        for batch in rows_of(batches, 256):
            raws, keys, prints, sizes, prefixes = [], [], [], [], []
            for text in binary_texts(batch.column(1)):
                folded, own = sketch(text, table, words)
                raws.append(xxhash.xxh64_intdigest(text, 42))
                digest = xxhash.xxh3_128_digest(folded)
                keys.append(np.frombuffer(digest, "<i8")), sizes.append(len(own))
                prints.append(fingerprints_of(own, PRINTS) if len(own) >= FEW else [None] * PRINTS)
                again = digest in seen
                prefixes.append(None if again else prefix_of(own, similarity, last).tobytes())
                if not again:
                    if len(seen) >= WordTable.limit:
                        seen.clear()
                    seen.add(digest)
            k = np.array(keys, np.int64).reshape(-1, 2)
            cols = [batch.column(0), pa.array(np.array(raws, U64).view(np.int64)), pa.array(k[:, 0]), pa.array(k[:, 1])]
            cols += [pa.array([p[j] for p in prints], pa.int64()) for j in range(PRINTS)] + [pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["i", "raw", "k1", "k2", *FPS, "n", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"i {kind}, raw long, k1 long, k2 long, {', '.join(f'{f} long' for f in FPS)}, n int, prefix binary"
    return modest_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))).mapInArrow(run, schema)


def exploded(prefixes: DataFrame) -> DataFrame:
    """(key, node): one row for each shingle of each packed prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
        nodes = np.repeat(batch.column(0).to_numpy(), [len(h) for h in held])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)), pa.array(nodes, pa.int64())], ["key", "node"])

    return map_arrow(prefixes.select("node", "prefix").filter("prefix IS NOT NULL"), run, "key long, node long", 1024)


def often_held(keyed: DataFrame) -> DataFrame:
    """(key, m) of the keys that several rows hold, stored; keys found once move alone."""
    return stored(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))


class Corpus:
    """The texts of a near-duplicate search: sketches, nodes and exact comparison.

    A node is a different folded text, by 128 bits (64 where no two share them).
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float):
        self.docs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
        self.words, self.similarity = words, similarity
        rows = stored(sketches(docs, id_col, text_col, words, similarity))
        self.sketches = rows
        torn = rows.groupBy("k1").agg(F.min("k2").alias("x"), F.max("k2").alias("y")).filter("x <> y")
        self.torn = [r["k1"] for r in torn.select("k1").collect()]  # about n * n / 2^65 of n texts
        self.rows = rows.withColumn("node", self.node())
        order = F.struct(F.col("i").isNull().alias("none"), "i", "raw")
        self.reps = stored(self.rows.groupBy("node").agg(F.min(order).alias("o"), *(F.max(f).alias(f) for f in (*FPS, "n"))))

    def node(self) -> Column:
        return F.when(F.col("k1").isin(self.torn), F.xxhash64("k1", "k2")).otherwise(F.col("k1")) if self.torn else F.col("k1")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(i, text) of one row of each node, and perhaps others with its id."""
        wanted = cut(self.reps.join(nodes, "node", "left_semi").select(F.col("o.i").alias("of")))
        return self.docs.join(small(wanted), F.col("i").eqNullSafe(F.col("of")), "left_semi")

    def signs(self, node: str, name: str) -> DataFrame:
        """(node, name): each node's fingerprints and size, under the names given."""
        return self.reps.select(F.col("node").alias(node), F.struct(*FPS, "n").alias(name))

    def may_be_near(self, x: str, y: str) -> Column:
        """Whether the sizes and fingerprints of two ``signs`` don't rule the similarity out.

        Two sets of similarity s differ in size by that factor at most.  At similarity s the share of differing bits is acos(2s / (1 + s)) / pi; pairs that differ
        in six standard deviations more are ruled out.
        """
        share = float(np.arccos(2 * self.similarity / (1 + self.similarity)) / np.pi)
        bits = 64 * PRINTS
        within = int(bits * share + 6 * np.sqrt(bits * share * (1 - share)))
        sized = F.least(f"{x}.n", f"{y}.n") >= F.lit(self.similarity - 1e-9) * F.greatest(f"{x}.n", f"{y}.n")
        return sized & F.coalesce(_distance(FPS, x, y) <= within, F.lit(True))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) that may be near."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return pairs.join(self.signs("a", "x"), "a").join(self.signs("b", "y"), "b").filter(self.may_be_near("x", "y")).select("a", "b")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose shingle sets are similar enough.

        Pairs are dealt into blocks by hashes of both nodes, so a node's set moves once to each
        block that has a pair of it, however many pairs those are; a block holds the sets of about
        2 NODES_A_BLOCK nodes.
        """
        pairs = cut(pairs)
        nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        many = F.lit(-(-nodes.count() // NODES_A_BLOCK) or 1)
        bucket = lambda c: F.pmod(F.xxhash64(c), many)
        blocked = pairs.select("a", "b", (bucket("a") * many + bucket("b")).alias("block"))
        wanted = blocked.select(F.col("block").alias("lot"), F.explode(F.array("a", "b")).alias("node")).distinct()
        packed = wanted.join(self.sets(nodes), "node").select("lot", "node", "shingles")
        least = self.similarity

        def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
            held = {n: np.frombuffer(s, U64) for n, s in zip(sets["node"], sets["shingles"])}
            keep = np.zeros(len(pairs), bool)
            for i, (x, y) in enumerate(zip(pairs["a"], pairs["b"])):
                a, b = held[x], held[y]
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = shared >= least * (len(a) + len(b) - shared)
            return pairs.loc[keep, ["a", "b"]]

        return blocked.groupBy("block").cogroup(packed.groupBy("lot")).applyInPandas(run, "a long, b long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles): the packed shingle hashes of the nodes."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = WordTable()
            for batch in rows_of(batches, 256):
                keys, packed = [], []
                for text in binary_texts(batch.column(1)):
                    folded, own = sketch(text, table, words)
                    keys.append(np.frombuffer(xxhash.xxh3_128_digest(folded), "<i8")), packed.append(own.tobytes())
                k = np.array(keys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(packed, pa.binary())], ["k1", "k2", "shingles"])

        found = modest_batches(self.texts_of(nodes)).mapInArrow(run, "k1 long, k2 long, shingles binary")
        return found.select(self.node().alias("node"), "shingles").dropDuplicates(["node"])

    def shared(self) -> DataFrame:
        """(key, node), stored: the shingles of all prefixes that several nodes hold.

        Shingles that very many rows hold come last in the order, so the prefixes with one of
        them are taken anew.
        """
        keyed = exploded(self.rows)
        often = often_held(keyed)
        most = cut(often.filter(F.col("m") > COMMON).orderBy(F.desc("m"), "key").limit(MAX_LATE).select("key"))
        late = [r["key"] & 0xFFFFFFFFFFFFFFFF for r in most.collect()]
        if not late:
            out = stored(keyed.join(often.select("key"), "key").distinct())
            discard(often)
            return out
        hold = cut(keyed.join(small(most), "key", "left_semi").select("node").distinct())
        again = sketches(self.texts_of(hold), "i", "text", self.words, self.similarity, late).withColumn("node", self.node())
        again = stored(again.join(hold, "node", "left_semi").select("node", "prefix"))
        discard(often)
        keyed = exploded(self.rows.select("node", "prefix").join(hold, "node", "left_anti").union(again))
        often = often_held(keyed)
        out = stored(keyed.join(often.select("key"), "key").distinct())
        discard(often, again)
        release(self.docs.sparkSession)
        return out

    def close(self) -> None:
        discard(self.sketches, self.reps)


def star_pairs(shared: DataFrame, clusters: DataFrame, turn: int) -> DataFrame:
    """(a, b): one node of every shared key, by the turn's order, with its nodes of other clusters."""
    held = with_component(shared, clusters, "node", "cluster")
    order = F.xxhash64("node", F.lit(turn))
    least = held.groupBy("key").agg(F.min_by(F.struct("node", "cluster"), order).alias("l"), F.min("cluster").alias("x"), F.max("cluster").alias("y"))
    least = cut(least.filter("x <> y").select("key", "l"))
    return held.join(least, "key").filter("cluster <> l.cluster").select(F.col("l.node").alias("a"), F.col("node").alias("b"))


def pairs_left(shared: DataFrame, clusters: DataFrame) -> int:
    """How many rows ``cross_pairs`` would make."""
    sizes = with_component(shared, clusters, "node", "cluster").groupBy("key", "cluster").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("major"))
    return int(keys.agg(F.sum((F.col("m") - F.col("major")) * F.col("m"))).first()[0] or 0)


def cross_pairs(corpus: Corpus, shared: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b), distinct: nodes of different clusters that share a key and may be near.

    The key's largest cluster only meets the others, so one large cluster costs its size.  Pairs that their signs rule out
    end in the join that makes them, and so do pairs that share a lesser key, where both nodes have FEW_KEYS at most.
    """
    held = with_component(shared, clusters, "node", "cluster")
    sizes = held.groupBy("key", "cluster").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg((F.sum("c") - F.max("c")).alias("n"), F.max_by("cluster", F.struct("c", "cluster")).alias("major"))
    mixed = held.join(cut(keys.filter("n > 0").select("key", "major")), "key")
    bare = cut(mixed.select("key", "node", "cluster", "major"))
    few = bare.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") <= FEW_KEYS).select("node")
    lists = bare.join(few, "node").groupBy("node").agg(F.collect_list("key").alias("keys"))
    mixed = stored(bare.join(corpus.signs("node", "s"), "node").join(lists, "node", "left").select("key", "node", "cluster", "major", "s", "keys"))
    x = mixed.filter("cluster <> major").select("key", F.col("node").alias("a"), F.col("cluster").alias("ca"), F.col("s").alias("x"), F.col("keys").alias("kx"))
    y = mixed.select("key", F.col("node").alias("b"), F.col("cluster").alias("cb"), "major", F.col("s").alias("y"), F.col("keys").alias("ky"))
    first = F.coalesce(F.array_min(F.array_intersect("kx", "ky")) == F.col("key"), F.lit(True))
    met = x.join(y, "key").filter(F.expr("ca <> cb AND (cb = major OR a < b)") & corpus.may_be_near("x", "y") & first)
    out = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(mixed)
    return out


def near_duplicate_links(corpus: Corpus) -> DataFrame:
    """(a, b) of nodes whose shingle sets have the corpus' similarity or more.

    Not all pairs come out, but enough to connect all that are similar.  Fingerprints alone miss some of these: the
    join of shared prefixes is the exact way for what the variants leave.

    First the variant join links the texts whose fingerprints differ in few bits, which nearly
    all copies with few changes do.  Then texts are joined by the shingles of their
    prefixes, which no similar pair escapes: first each text with one text of every shared
    shingle, another one each turn, so that groups of near copies fall into one cluster, then all
    pairs from different clusters.  The exact similarity decides on every pair.
    """
    spark = corpus.docs.sparkSession
    prints = corpus.reps.filter(F.col(FPS[0]).isNotNull()).select("node", *FPS)
    first = cut(prints.groupBy(FPS[0]).agg(F.min("node").alias("node")))
    equal = prints.join(first.withColumnRenamed("node", "to"), FPS[0]).filter("node <> to").select(F.col("to").alias("a"), F.col("node").alias("b"))
    near = cut(coarse_links(first, [FPS[0]], MAX_DISTANCE))
    grouped = with_component(first, components(near), "node", "cluster")
    links = equal.union(near).union(variant_links(grouped, [FPS[0]], MAX_DISTANCE))
    links = cut(corpus.similar(corpus.near(links)))
    release(spark)
    shared = corpus.shared()
    enough, left = PAIRS_A_ROW * shared.count(), None
    for turn in range(TURNS):
        clusters = cut(components(links))
        before, left = left, pairs_left(shared, clusters)
        if turn and (left <= enough or left > 0.9 * before):
            break
        links = cut(links.union(corpus.similar(corpus.near(star_pairs(shared, clusters, turn)))))
        release(spark)
    clusters = cut(components(links))
    release(spark)
    pairs = cross_pairs(corpus, shared, clusters)
    links = cut(links.union(corpus.similar(pairs)))
    discard(shared, pairs)
    release(spark)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts: the one with the least id.

    Exact copies (after folding A-Z and whitespace) are collapsed first, rows with equal ids
    by their text, so that only distinct texts are compared.  Null ids come after all others.
    Null and empty texts are one text.  All columns pass through, whatever their names.
    """
    corpus = Corpus(docs, id_col, text_col, words, similarity)
    parts = with_component(corpus.reps, components(near_duplicate_links(corpus)), "node", "part")
    keep = cut(parts.groupBy("part").agg(F.min("o").alias("o")).select("o.i", "o.raw"))
    twice = cut(corpus.rows.groupBy("i", "raw").agg(F.count("*").alias("n")).filter("n > 1").select("i", "raw"))
    corpus.close()
    release(docs.sparkSession)
    i, raw = (free_name(docs.columns, n) for n in ("__i", "__raw"))
    keyed = docs.withColumn(raw, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keep = keep.select(F.col("i").alias(i), F.col("raw").alias(f"{raw}_"))
    kept = keyed.join(keep, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(raw) == F.col(f"{raw}_")), "left_semi").drop(raw)
    if twice.isEmpty():
        return kept
    twice = twice.select(F.col("i").alias(i), F.col("raw").alias(f"{raw}_"))
    again = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(f"{raw}_"))
    once = kept.join(twice, again, "left_anti")
    repeated = kept.join(twice, again, "left_semi").withColumn(raw, F.coalesce(F.col(text_col), F.lit("")))
    return once.union(repeated.dropDuplicates([id_col, raw]).drop(raw))


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: links at 4 or fewer differing bits."""
    out = hamming_components(fingerprints(docs))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
