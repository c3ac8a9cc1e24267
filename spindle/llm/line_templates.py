"""Line deduplication with a log-template tree.

Every line is masked (a token with a digit, an address or a link becomes ``<*>``) and falls
through a tree of fixed depth: first by its number of tokens, then by its leading tokens.  In
a leaf the distinct masked lines are taken in order, those in most texts first and ties by their text: a line
belongs to the first line before it that leads a template and of whose tokens it shares
enough, or else leads one itself.  A template's tokens in which its lines differ are ``<*>``.  A template found in at least
``min_docs`` different texts recurs, and all its lines are dropped.

Exact copies of a text count once, so copies don't make each other's lines recur.  A leaf with
more than ``max_leaf`` distinct lines is taken in rounds: the first ``max_leaf`` lines that have no leader yet find theirs in
one task, then all others of the leaf, in as many tasks as it takes, look for theirs among the new leaders.  Every line
meets the same leaders in the same order as in one pass, so the result doesn't depend on ``max_leaf``.

Blank lines are kept and are no templates.  Null texts stay null, empty ones empty.  Repeated
rows lose the same lines.  Other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, map_arrow, small, text_key, texts

DEPTH = 3
MAX_LEAF = 4_000
WILD = "<*>"
#: What a variable field holds: only lines with one of these are looked at token by token.
HINT = re.compile(r"[\d@]|://|www\.")
FIELD = re.compile(r".*\d|.+@.+\..+|.*://|www\.")
SIGNED = 1 << 63


def masked(line: str) -> list[str]:
    tokens = line.split()
    return [WILD if FIELD.match(t) else t for t in tokens] if HINT.search(line) else tokens


def _hash(*tokens: str) -> int:
    h = xxhash.xxh64_intdigest(" ".join(tokens))
    return h - 2 * SIGNED if h >= SIGNED else h


def places(tokens: list[str]) -> tuple[int, int]:
    """Hashes of a masked line's leaf and of itself."""
    return _hash(str(len(tokens)), *tokens[:DEPTH]), _hash(*tokens)


def lines_of(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, dd, pos, leaf, line) of every line that is not blank; dd: the text's hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for i, t in enumerate(texts(batch.column(2))):
            for pos, line in enumerate(t.split("\n")):
                tokens = masked(line)
                if tokens:
                    at.append(i)
                    out.append((pos, *places(tokens)))
        take = pa.array(at, pa.int64())
        cols = list(zip(*out)) if out else [()] * 3
        arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
        return pa.RecordBatch.from_arrays(arrays, ["row", "dd", "pos", "leaf", "line"])

    rows = docs.select(F.col(row), F.xxhash64(text).alias("dd"), F.col(text))
    return map_arrow(rows, run, "row long, dd long, pos int, leaf long, line long", 256)


def masked_lines(docs: DataFrame, row: str, text: str, places_: DataFrame) -> DataFrame:
    """(leaf, line, masked): the masked text of one occurrence of each line in ``places_`` (leaf, line, row, pos)."""
    at = cut(places_.groupBy(F.col("row").alias("__r")).agg(F.collect_list(F.struct("leaf", "line", "pos")).alias("at")))
    held = docs.select(F.col(row).alias("__row"), F.col(text).alias("__text")).join(small(at), F.col("__row") == F.col("__r"))
    held = held.dropDuplicates(["__row"]).withColumn("__lines", F.split("__text", "\n", -1)).select(F.explode("at").alias("a"), "__lines")
    held = held.select("a.leaf", "a.line", F.get("__lines", F.col("a.pos")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [" ".join(masked(t)) for t in texts(batch.column(2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.string())], ["leaf", "line", "masked"])

    return map_arrow(held, run, "leaf long, line long, masked string")


def codes_of(lines: list[str], known: dict[str, int]) -> np.ndarray:
    """The tokens of lines of one length as numbers; -1 for a variable field."""
    return np.array([[known.setdefault(t, len(known)) for t in line.split(" ")] for line in lines], np.int32)


def first_fit(lines: list[str], leaders: list[str], similarity: float, grow: bool) -> list[int]:
    """The leader of each line, by number; lines of one length, in order.

    The first leader counts that shares ``similarity`` of the line's fixed tokens.  Lines without one
    become leaders themselves, numbered on, if ``grow``, and have -1 if not.
    """
    known = {WILD: -1}
    table = codes_of([*leaders, *lines], known)
    heads = np.empty_like(table)
    n = len(leaders)
    heads[:n] = table[:n]
    of = []
    for row in table[n:]:
        fixed = int((row != -1).sum())
        need = max(similarity * fixed, 1 if fixed else 0)
        fits = ((heads[:n] == row) & (row != -1)).sum(1) >= need
        k = int(fits.argmax()) if n else 0
        if n and fits[k]:
            of.append(k)
        elif grow:
            heads[n] = row
            of.append(n)
            n += 1
        else:
            of.append(-1)
    return of


ORDER = {"by": ["n", "masked"], "ascending": [False, True], "ignore_index": True}


def grown(tree: DataFrame, similarity: float) -> DataFrame:
    """(leaf, masked, n, template) of the masked lines (leaf, masked, n) of each leaf; template: the leader."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(**ORDER)
        of = first_fit(group["masked"].tolist(), [], similarity, True)
        heads: list[str] = []
        for k, line in zip(of, group["masked"]):
            if k == len(heads):
                heads.append(line)
        return group[["leaf", "masked", "n"]].assign(template=[heads[k] for k in of])

    return tree.groupBy("leaf").applyInPandas(run, "leaf long, masked string, n long, template string")


def grown_wide(tree: DataFrame, similarity: float, max_leaf: int) -> DataFrame:
    """The same for leaves of more than ``max_leaf`` lines, in rounds; (leaf, masked, n, template)."""

    def assign(lines: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        heads = heads.sort_values(**ORDER)["masked"].tolist()
        of = first_fit(lines["masked"].tolist(), heads, similarity, False) if len(lines) else []
        return lines[["leaf", "masked", "n"]].assign(template=[heads[k] if k >= 0 else None for k in of])

    schema = "leaf long, masked string, n long, template string"
    nth = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("n"), "masked"))
    open_, done = tree.select("leaf", "masked", "n"), None
    while True:
        # Each task keeps no more than max_leaf lines of a leaf before they meet.
        block = open_.withColumn("nth", nth).filter(F.col("nth") <= max_leaf).select("leaf", "masked", "n")
        block = cut(grown(block, similarity))
        done = block if done is None else done.union(block)
        rest = cut(open_.join(block.select("leaf", "masked"), ["leaf", "masked"], "left_anti"))
        if rest.isEmpty():
            return done
        chunks = rest.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(max_leaf)).alias("chunks"))
        dealt = rest.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("masked"), F.col("chunks")))
        heads = block.filter("masked = template").join(chunks, "leaf").select(F.col("leaf").alias("of"), "masked", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("lot"))
        found = cut(dealt.select("leaf", "chunk", "masked", "n").groupBy("leaf", "chunk").cogroup(heads.groupBy("of", "lot")).applyInPandas(assign, schema))
        done = done.union(found.filter("template IS NOT NULL"))
        open_ = found.filter("template IS NULL").select("leaf", "masked", "n")
        if open_.isEmpty():
            return done


def template_texts(lines: DataFrame) -> DataFrame:
    """(leaf, template, text) of lines (leaf, masked, template): the tokens that all lines of a template share."""
    each = lines.select("leaf", "template", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    token = F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(WILD)
    tokens = each.groupBy("leaf", "template", "pos").agg(token.alias("token"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    return tokens.groupBy("leaf", "template").agg(text.alias("text"))


def templates(docs: DataFrame, text: str, row: str, similarity: float, min_docs: int, max_leaf: int = MAX_LEAF) -> tuple[DataFrame, DataFrame]:
    """(lines, found): all lines, and (leaf, line, masked, template, n_docs) of those in recurring templates; template: its text."""
    lines, found = recurring(docs, text, row, similarity, min_docs, max_leaf)
    texts_ = template_texts(found.select("leaf", "template", "masked"))
    return lines, found.join(texts_, ["leaf", "template"]).select("leaf", "line", "masked", F.col("text").alias("template"), "n_docs")


def recurring(docs: DataFrame, text: str, row: str, similarity: float, min_docs: int, max_leaf: int = MAX_LEAF) -> tuple[DataFrame, DataFrame]:
    """The same with the template's leader in place of its text.

    A line is known by two hashes, its leaf's and its own, 128 bits together.
    """
    lines = cut(lines_of(docs, row, text))
    seen = cut(lines.select("leaf", "line", "dd").distinct())
    count = seen.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    leaves = count.groupBy("leaf").agg(F.count("*").alias("width"), F.sum("n").alias("m")).filter(F.col("m") >= min_docs)
    count = cut(count.join(leaves.select("leaf", "width"), "leaf"))
    # One occurrence of each line, taken before any join, so a line that all texts hold costs one row a task.
    first = lines.groupBy("leaf", "line").agg(F.min(F.struct("row", "pos")).alias("p")).join(count.select("leaf", "line"), ["leaf", "line"], "left_semi")
    named = masked_lines(docs, row, text, first.select("leaf", "line", "p.row", "p.pos"))
    tree = cut(count.join(named, ["leaf", "line"]).select("leaf", "line", "masked", "n", "width"))
    of = grown(tree.filter(F.col("width") <= max_leaf).select("leaf", "masked", "n"), similarity)
    wide = tree.filter(F.col("width") > max_leaf)
    if not wide.isEmpty():
        of = of.union(grown_wide(wide, similarity, max_leaf))
    assigned = cut(tree.select("leaf", "line", "masked").join(of.select("leaf", "masked", "template"), ["leaf", "masked"]))
    docs_of = seen.join(assigned.select("leaf", "line", "template"), ["leaf", "line"]).select("leaf", "template", "dd").distinct()
    recur = docs_of.groupBy("leaf", "template").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return lines, assigned.join(recur, ["leaf", "template"]).select("leaf", "line", "masked", "template", "n_docs")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.7, min_docs: int = 10, max_leaf: int = MAX_LEAF) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of the text column.

    Two columns are added: n_lines and n_dropped (names with leading underscores if taken).
    """
    row, total, gone, of, drop = (free_name(docs.columns, n) for n in ("__row", "n_lines", "n_dropped", "__of", "__drop"))
    keyed = docs.withColumn(row, text_key(docs, id_col, text_col))
    lines, found = recurring(keyed.select(row, text_col), text_col, row, similarity, min_docs, max_leaf)
    # Broadcast, or else two plain shuffles, whose hot keys Spark can split.
    found = small(cut(found.select("leaf", "line")))
    drops = lines.join(found, ["leaf", "line"]).groupBy(F.col("row").alias(of)).agg(F.collect_set("pos").alias(drop))
    drops = small(cut(drops))
    parts = F.split(F.col(text_col), "\n", -1)
    out = keyed.join(drops, F.col(row) == F.col(of), "left")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(drop, i)), "\n")
    out = out.withColumn(total, F.coalesce(F.size(parts), F.lit(0)).cast("long"))
    out = out.withColumn(total, F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col(total)))
    out = out.withColumn(gone, F.coalesce(F.when(F.col(drop).isNotNull(), F.size(drop)), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(drop).isNotNull(), left).otherwise(F.col(text_col)))
    return out.select(*docs.columns, total, gone)


def op3(docs: DataFrame) -> DataFrame:
    """Of every document: its lines, how many were dropped, and the length and digest of what is left."""
    out = drop_lines(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
