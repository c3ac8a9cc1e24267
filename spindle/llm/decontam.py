"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct five-word shingles, in powers of two.
For a partition of items with at most u shingles every document is cut into windows of
3u/2 shingles, u/2 apart, so an item lies whole in one of them and the similarity of item and
window stays high however long the document is.  A window is a candidate for an item if any
of ``HASHES`` minima agree (items of up to four shingles must be there whole, so their least
shingle decides).  Candidates are verified by exact containment: the share of the item's
distinct shingles that the whole document holds.

Words are lower-cased runs of letters, digits and underscores.  An item of fewer than five
words counts as one shingle of its own length; an item without words matches nothing.  Null
and empty documents contain nothing.  Repeated rows are reported one by one.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text (measured beforehand); a
larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import GOLDEN, U64, WordTable, map_arrow, mix64, modest_batches, shingle_hashes, texts, word_hashes

WORDS = 5
HASHES = 48
TINY = 4
BLOCK_BYTES = 8 << 20
TOKEN = re.compile(r"\w+")
#: Shingle hashes are mixed already, so a multiplication by an odd number permutes them anew.
FACTORS = mix64(np.arange(1, HASHES + 1, dtype=U64) * U64(GOLDEN)) | U64(1)
FILTER_BITS = 20


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def shingles_of(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words and n else set()


class Index:
    """Test items by partition: tables of minima and the shingles to verify with."""

    def __init__(self, items: list[tuple], table: WordTable):
        self.items = []
        self.parts: dict[int, list[int]] = defaultdict(list)
        self.tiny: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        minima = []
        for item_id, text in items:
            words = words_of(text or "")
            n = min(WORDS, len(words))
            grams = shingles_of(words, n)
            if not grams:
                continue
            k = len(self.items)
            self.items.append((item_id, n, grams))
            hashes = shingle_hashes(word_hashes(table, words), n)
            if len(grams) <= TINY or n < WORDS:
                self.tiny[n][int(hashes.min())].append(k)
                minima.append(None)
            else:
                self.parts[max(3, (len(grams) - 1).bit_length())].append(k)
                minima.append(np.array([(hashes * f).min() for f in FACTORS]))
        self.tables = {}
        for scale, members in self.parts.items():
            values = np.concatenate([minima[k] for k in members])
            ranks = np.tile(np.arange(HASHES), len(members))
            owner = np.repeat(members, HASHES)
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(values & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables[scale] = (values[order], ranks[order], owner[order], seen)
        self.tiny_keys = {n: np.array(sorted(d), U64) for n, d in self.tiny.items()}

    def candidates(self, words: np.ndarray) -> set[int]:
        found: set[int] = set()
        for n, keys in self.tiny_keys.items():
            if len(words) >= n:
                h = shingle_hashes(words, n)
                for x in np.unique(h[np.isin(h, keys)]):
                    found.update(self.tiny[n][int(x)])
        if self.tables and len(words) >= WORDS:
            h = shingle_hashes(words, WORDS)
            step = 1 << (min(self.tables) - 1)
            starts = np.arange(0, len(h), step)
            minima, turned = np.empty((len(starts), HASHES), U64), np.empty_like(h)
            for k, f in enumerate(FACTORS):
                minima[:, k] = np.minimum.reduceat(np.multiply(h, f, out=turned), starts)
            scale = min(self.tables)
            while True:
                if scale in self.tables:
                    self._look(scale, minima, found)
                if scale >= max(self.tables):
                    break
                if len(minima) % 2:
                    minima = np.concatenate([minima, minima[-1:]])
                minima = np.minimum(minima[0::2], minima[1::2])
                scale += 1
        return found

    def _look(self, scale: int, blocks: np.ndarray, found: set[int]) -> None:
        """Windows of three blocks (3u/2 shingles), one block apart."""
        if len(blocks) > 2:
            windows = np.minimum(np.minimum(blocks[:-2], blocks[1:-1]), blocks[2:])
        else:
            windows = blocks.min(0, keepdims=True)
        values, ranks, owner, seen = self.tables[scale]
        hit, rank = np.nonzero(seen[(windows & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if len(hit):
            look = windows[hit, rank]
            lo, hi = np.searchsorted(values, look, "left"), np.searchsorted(values, look, "right")
            for a, b, r in {(int(a), int(b), int(r)) for a, b, r in zip(lo, hi, rank) if b > a}:
                found.update(int(owner[i]) for i in range(a, b) if ranks[i] == r)

    def matches(self, text: str, table: WordTable, least: float) -> list[tuple]:
        words = words_of(text)
        if not words:
            return []
        out, grams = [], {}
        for k in sorted(self.candidates(word_hashes(table, words))):
            item_id, n, own = self.items[k]
            if n not in grams:
                grams[n] = shingles_of(words, n)
            shared = len(own & grams[n])
            if shared >= least * len(own):
                out.append((item_id, len(own), shared, shared / len(own)))
        return out


def item_blocks(items: DataFrame, item_col: str, item_text: str) -> list[list[tuple]]:
    """The items (id, text) in blocks of about BLOCK_BYTES of text at most; one block at least."""
    tests = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("words")).filter(F.col("words").isNotNull())
    size = tests.agg(F.sum(F.length("words") + 64)).first()[0] or 0
    blocks = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    return [[(r["item"], r["words"]) for r in (tests.filter(block == b) if blocks > 1 else tests).collect()] for b in range(blocks)]


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.8) -> DataFrame:
    """(id, item id, n_shingles, n_shared, containment) for every document that holds an item."""
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, n_shingles long, n_shared long, containment double"
    narrow = docs.select(id_col, text_col)
    out = None
    for rows in item_blocks(items, item_col, item_text):
        found = map_arrow(narrow, _searcher(rows, id_col, item_col, items, least), schema)
        out = found if out is None else out.union(found)
    return out


def _searcher(rows: list[tuple], id_col: str, item_col: str, items: DataFrame, least: float):
    made: list = []
    kind = to_arrow_type(items.schema[item_col].dataType)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            table = WordTable()
            made.extend([Index(rows, table), table])
        index, table = made
        at, got = [], []
        for i, text in enumerate(texts(batch.column(1))):
            for m in index.matches(text, table, least):
                at.append(i), got.append(m)
        ids = batch.column(0).take(pa.array(at, pa.int64()))
        cols = list(zip(*got)) if got else [(), (), (), ()]
        kinds = [kind, pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_col, item_col, "n_shingles", "n_shared", "containment"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.8) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds a test item.

    Every row is judged by its own text, so nothing is shuffled and no column name can clash;
    rows without a text stay.
    """
    out = modest_batches(docs)
    for rows in item_blocks(items, item_col, item_text):
        out = out.filter(~_holds(rows, least)(F.coalesce(F.col(text_col), F.lit(""))))
    return out


def _holds(rows: list[tuple], least: float):
    made: list = []

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        if not made:
            table = WordTable()
            made.extend([Index(rows, table), table])
        index, table = made
        return pd.Series([bool(index.matches(t, table, least)) for t in column], dtype=bool)

    return holds


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every (document, test item) of containment 0.8 or more; no row where none is held."""
    return contained(docs, items)


ORACLE = """
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
 ig AS (SELECT item_id, least(5, len(w)) AS n, len(w) AS m, w FROM i WHERE len(w) > 0),
 ishi AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
          FROM (SELECT *, unnest(range(1, m - n + 2)) AS k FROM ig)),
 d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
 dsh AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
         FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
               FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
 size AS (SELECT item_id, count(*) AS n_shingles FROM ishi GROUP BY item_id),
 hit AS (SELECT r, doc_id, item_id, count(*) AS n_shared FROM dsh JOIN ishi USING (n, s) GROUP BY r, doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM hit JOIN size USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""
