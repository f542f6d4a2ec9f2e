"""The event sink: frames, and batches that are cut off or come again."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import events

SCHEMA = "n long, type string, token string, turnId string, usage struct<inputTokens: int, outputTokens: int>"


def test_frames():
    assert events.framed({"type": "token", "token": "é\n", "turnId": "t", "other": 1}) == '{"type":"token","token":"é\\n","turnId":"t"}\n'
    assert events.framed({"type": "completed", "turnId": "t"}, "sse") == 'data: {"type":"completed","done":true,"turnId":"t"}\n\n'
    with pytest.raises(ValueError):
        events.framed({"type": "odd"})


def run(spark, folder, out, where, **more):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = rows.withColumns(more) if more else rows
    query = rows.writeStream.format("weft_events").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()


def test_each_batch_once(spark, tmp_path):
    events.register(spark)
    folder, out, where = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    add = lambda lo, hi: spark.range(lo, hi, 1, 3).selectExpr("id AS n", "'token' AS type", "string(id) AS token", "'t' AS turnId", "named_struct('inputTokens', 1, 'outputTokens', 2) AS usage").coalesce(1).write.mode("append").parquet(folder)
    seen = lambda: sorted(int(json.loads(r["line"])["token"]) for r in events.read_events(spark, out).collect())
    add(0, 10)
    run(spark, folder, out, where)
    assert seen() == list(range(10))
    add(10, 20)
    # a task that fails half way: the batch leaves no manifest, and comes again whole
    with pytest.raises(Exception, match="."):
        run(spark, folder, out, where, type=F.when(F.col("n") == 15, "broken").otherwise("token"))
    assert seen() == list(range(10))
    run(spark, folder, out, where)
    assert seen() == list(range(20))
    # the manifest was written but Spark's own commit was lost: the batch comes again and counts once
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(spark, folder, out, where)
    assert seen() == list(range(20))
    parts = {p.name for p in (tmp_path / "out" / "parts").iterdir()}
    named = {n for p in (tmp_path / "out" / "batches").glob("[0-9]*.json") for n in json.loads(p.read_text())["parts"]}
    assert named <= parts
