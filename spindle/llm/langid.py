"""Language identification by compression with per-language dictionaries.

``learn`` puts labelled texts of each language, long ones cut to ``PIECE``, into a raw-content zstandard dictionary
of at most ``DICT_BYTES`` (a bounded sample, see ``SAMPLE_DOCS``).  ``identify`` compresses
every whole text, in blocks, with each dictionary; the language with the smallest output
wins.  A text whose two best languages are within ``MIN_MARGIN`` of its size is rejected
(column ``rejected``), as is a text without letters, whose language is ``und``.

Null and empty texts are ``und`` with score 0.  With no labelled text every text is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, texts

DICT_BYTES = 112 << 10
#: Labelled texts per language that the dictionaries may see.
SAMPLE_DOCS = 160
#: Characters of a longer labelled text that a dictionary may see, from its first letter on.
PIECE = DICT_BYTES // 6
BLOCK = 16 << 10
LEVEL = 6
#: Least lead of the best language, in output bytes per input byte.
MIN_MARGIN = 0.001
LETTER = re.compile(r"[^\W\d_]")
SIGNS = re.compile(r"[\W\d_]+")


def prepared(text: str) -> bytes:
    """Lower-case words; signs and digits say nothing about the language."""
    return SIGNS.sub(" ", text.lower()).encode()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary from the rows of ``docs`` with a text and a language.

    The rows are picked by a hash of the id, per language, and texts of over PIECE characters
    give that many from their first letter on; what a language needs at most
    reaches the driver: SAMPLE_DOCS texts.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("lang")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 3 * SAMPLE_DOCS / n))).otherwise(share)
    some = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    some = some.withColumn("text", F.when(F.length("text") > PIECE, F.expr(rf"substring(text, regexp_instr(text, r'\p{{L}}'), {PIECE})")).otherwise(F.col("text")))
    order = Window.partitionBy("lang").orderBy("h", "text")
    some = some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_DOCS)
    found: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in some.orderBy("lang", "r").collect():
        found[r["lang"]].append(prepared(r["text"]))
    out = {}
    for lang in sorted(found):
        parts, size = [], 0
        for t in found[lang]:
            if size + len(t) <= DICT_BYTES:
                parts.append(t)
                size += len(t)
        if parts:
            out[lang] = b" ".join(parts)
    return out


def sizes_of(compressors: list, text: bytes) -> np.ndarray:
    """Output bytes of a whole text per language."""
    out = np.zeros(len(compressors), np.int64)
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK]
        for k, c in enumerate(compressors):
            out[k] += len(c.compress(part))
    return out


def judge(sizes: np.ndarray, n_bytes: int) -> tuple[int, float, bool]:
    """(best, score, rejected)."""
    best = int(sizes.argmin())
    score = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 60)).sum())
    lead = np.partition(sizes, 1)[1] - sizes[best] if len(sizes) > 1 else n_bytes
    return best, score, bool(lead < 1 or lead < MIN_MARGIN * n_bytes)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with lang_pred, score and rejected for every row."""
    langs = sorted(dictionaries)
    made: list = []

    def compressors() -> list:
        if not made:
            for lang in langs:
                d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))
        return made

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tools = compressors()
        lang, score, rejected = [], [], []
        for t in texts(batch.column(batch.num_columns - 1)):
            if not tools or not LETTER.search(t):
                lang.append("und"), score.append(0.0), rejected.append(True)
                continue
            data = prepared(t)
            best, p, no = judge(sizes_of(tools, data), len(data))
            lang.append(langs[best]), score.append(p), rejected.append(no)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            [*id_cols, "lang_pred", "score", "rejected"],
        )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return map_arrow(docs.select(*id_cols, text_col), run, f"{kinds}, lang_pred string, score double, rejected boolean")


def op5(docs: DataFrame) -> DataFrame:
    """Learns where crc32(doc_id) mod 5 is not 0; predicts every document."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    dictionaries = learn(docs.filter(~held))
    marked = docs.select("doc_id", held.alias("held_out"), "text")
    return identify(marked, dictionaries, ["doc_id", "held_out"])
