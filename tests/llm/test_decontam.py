"""Decontamination: rare matches, item ids of any type, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from spindle.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"


def many(spark, n=1_500, at=1_200):
    """Many batches in one partition, of which one row holds the item."""
    other = F.concat_ws(" ", *(F.concat(F.lit(w), F.col("id").cast("string")) for w in ("a", "b", "c", "d", "e", "f", "g")))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == at, F.lit(f"so {ITEM} again")).otherwise(other).alias("text"))


@pytest.mark.parametrize("kind", ["long", "smallint", "string"])
def test_one_match_in_many_batches(spark, kind):
    items = spark.createDataFrame([("7", ITEM), ("8", "nothing that any text here would hold at all")], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    got = decontam.contained(many(spark), items)
    assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert [(r["doc_id"], str(r["item_id"]), r["containment"]) for r in got.collect()] == [(1_200, "7", 1.0)]
    left = decontam.decontaminate(many(spark), items)
    assert left.count() == 1_499 and left.filter("doc_id = 1200").isEmpty()


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    docs = many(spark, 20, 3)
    assert decontam.contained(docs, none).isEmpty()
    assert decontam.decontaminate(docs, none).count() == 20
    assert decontam.contained(docs.filter("false"), some).isEmpty()
    assert decontam.decontaminate(docs.filter("false"), some).isEmpty()


def test_repeated_rows_nulls_and_clashing_columns(spark):
    """Repeated rows are reported and dropped one by one; names of the operator's own are the caller's."""
    rows = [(1, f"x {ITEM}", 5, "h"), (1, f"x {ITEM}", 5, "h"), (None, ITEM, 6, "i"), (2, None, 7, "j"), (3, "", 8, "k"), (4, ITEM.upper(), 9, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h int, item_id string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["__h"] for r in left.collect()) == [7, 8]
    got = decontam.contained(docs.drop("item_id"), items).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 4]


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    texts = [" ".join(f"{w}{k}" for w in ("one", "two", "three", "four", "five", "six", "seven")) for k in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start {t} end") for k, t in enumerate(texts)] + [(99, "clean text")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained(docs, items).collect()} == {(k, k) for k in range(40)}
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).collect()] == [99]
