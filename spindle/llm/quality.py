"""Quality by positive-unlabelled learning: trusted good texts against unlabelled web text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import pu

#: Quality shows in a text's surface; a few words at most help.
MOST_WORDS = 60


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns where crc32(doc_id) mod 4 is not 2; scores every document (see pu)."""
    return pu.scored(docs, labels, "quality", 4, 2, MOST_WORDS)
