"""The corpus pipeline: five stages from raw documents to a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next stage's input.  All but the last return the columns of
``documents``; other columns that the input may have are not passed on.  Documents with a null or
empty text have no language and go in the first stage; an empty table gives an empty mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import common, decontam, langid, line_templates, mixing, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither compression nor sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    dictionaries = langid.learn(docs)
    kept = docs.withColumn("__row", F.struct(*docs.columns))
    told = langid.identify(kept, dictionaries, ["__row"], "text")
    return told.filter("not rejected").select("__row.*").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose templates recur across documents."""
    out = line_templates.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return simhash.near_dedup(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    before = None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            common.delete(spark, before)  # the next stage has all of it
        before = here
    return docs
