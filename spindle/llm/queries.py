"""The registered queries of the text operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import compact_windows, decontam, fingerprints, langid, line_templates, merkle, mixing, nn_descent, prefix_trie, quality, repeats, simhash, toxicity
from .common import documents, read_table


def op1_simhash(spark, sf_dir):
    """SimHash fingerprints and components of all documents."""
    return simhash.op1(documents(spark, sf_dir, "doc_id", "text"))


def op2_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    return toxicity.op2(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "labels"))


def op3_line_dedup(spark, sf_dir):
    """What is left of every document without lines of recurring templates."""
    return line_templates.op3(documents(spark, sf_dir, "doc_id", "text"))


def op4_fingerprints(spark, sf_dir):
    """Exact fingerprints of all documents and of their edited texts."""
    return fingerprints.op4(documents(spark, sf_dir, "doc_id", "text"))


def op5_language_id(spark, sf_dir):
    """The language of every document."""
    return langid.op5(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op6_quality(spark, sf_dir):
    """Quality scores of all documents."""
    return quality.op6(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark, sf_dir):
    """How many words of each document a weighted mix of sources takes."""
    return mixing.op7(documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_near_passages(spark, sf_dir):
    """Classes of documents that near-duplicate passages connect."""
    return compact_windows.op8(documents(spark, sf_dir, "doc_id", "text"))


def op9_decontamination(spark, sf_dir):
    """Documents that hold items of the benchmark."""
    return decontam.op9(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def op10_repeats(spark, sf_dir):
    """What is left of every document without 400-byte strings found elsewhere."""
    return repeats.op10(documents(spark, sf_dir, "doc_id", "text"))


def op11_nearest_neighbours(spark, sf_dir):
    """The 20 nearest neighbours of every twentieth vector."""
    return nn_descent.op11(read_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    """Every document's place in a Merkle tree, its proof and whether it holds after tampering."""
    return merkle.op12(documents(spark, sf_dir))


def op13_prefix_trie(spark, sf_dir):
    """The nodes of the trie of all conversations, with members, leaves and what sharing saves."""
    return prefix_trie.op13(read_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    all_ = (op1_simhash, op2_toxicity, op3_line_dedup, op4_fingerprints, op5_language_id, op6_quality, op7_mixing, op8_near_passages, op9_decontamination, op10_repeats, op11_nearest_neighbours, op12_merkle_manifest, op13_prefix_trie)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": decontam.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
