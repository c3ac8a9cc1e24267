"""Snapshots of a stream: generations across batches and restarts, foreign and stale ones."""

from spindle.streaming import frames

SCHEMA = "owner string, dataset string, topology long, generation long, value double"


def run(spark, folder, checkpoint, schema=SCHEMA):
    """All that is new in the folder goes through; what comes out, batch by batch."""
    out = []
    stream = frames.newest_snapshots(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder))
    query = stream.writeStream.foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(out, key=str)


def put(folder, name, rows):
    import json

    (folder / name).write_text("\n".join(json.dumps(dict(zip(("owner", "dataset", "topology", "generation", "value"), r))) for r in rows))


def test_older_generations_stay_out_after_a_restart(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    put(folder, "1.json", [("a", "d", 1, 4, 0.5), ("a", "d", 1, 5, 1.0), ("b", "d", 1, 2, 2.0), (None, "d", 1, 9, 0.0), ("c", "d", 1, None, 0.0)])
    first = run(spark, str(folder), checkpoint)
    assert first == [("a", "d", 1, 5, 1.0), ("b", "d", 1, 2, 2.0)]
    put(folder, "2.json", [("a", "d", 1, 3, 9.0), ("b", "d", 1, 7, 3.0), ("a", "d", 1, 5, 9.0)])
    assert run(spark, str(folder), checkpoint) == [("b", "d", 1, 7, 3.0)]
    put(folder, "3.json", [("a", "d", 1, 6, 4.0), ("b", "d", 1, 6, 9.0), ("e", "d", 1, 0, 5.0)])
    assert run(spark, str(folder), checkpoint) == [("a", "d", 1, 6, 4.0), ("e", "d", 1, 0, 5.0)]


def test_foreign_and_stale(spark):
    roots = spark.createDataFrame([("a", "d", 2), ("b", "e", 1)], "owner string, dataset string, topology long")
    rows = [("a", "d", 2, 1, 0.0), ("a", "d", 1, 1, 0.0), ("a", "x", 2, 1, 0.0), ("b", None, 1, 1, 0.0), ("z", "d", 1, 1, 0.0)]
    got = frames.resolved_snapshots(spark.createDataFrame(rows, SCHEMA), roots)
    assert sorted((r["owner"], r["status"]) for r in got.collect()) == [("a", "foreign"), ("a", "ready"), ("a", "stale"), ("b", "foreign"), ("z", "foreign")]
