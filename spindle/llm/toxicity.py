"""Toxicity by positive-unlabelled learning: confirmed toxic texts against unlabelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import pu


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns where crc32(doc_id) mod 3 is not 1; scores every document (see pu)."""
    return pu.scored(docs, labels, "toxic", 3, 1)
