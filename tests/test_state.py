"""Streams whose state ends: restarts, generations, timers and expired spans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftgraph.plans.stream_queries import ROCKS
from weftgraph.streaming import runs, state

T0 = dt.datetime(2024, 1, 1)
STEPS = "job string, generation long, at timestamp, seq long, step string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_jobs_go_on_after_a_restart(spark, tmp_path):
    folder, where = f"file://{tmp_path}/in", f"file://{tmp_path}/run"

    def run(rows):
        spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("append").parquet(folder)
        got = runs.run_appends(state.job_attempts(stream(spark, folder, STEPS), "10 seconds"), "jobs", where, ROCKS)
        return sorted((r["job"], r["attempt"], int((r["started"] - T0).total_seconds()), int((r["ended"] - T0).total_seconds()), r["outcome"]) for r in got.collect())

    first = run([("a", 1, at(0), 1, "started"), ("a", 1, at(5), 2, "failed"), ("a", 1, at(6), 3, "started"), ("b", 1, at(6), 4, "started"), ("b", 1, at(7), 5, "started"), ("b", 1, at(50), 6, "completed"), ("c", 2, at(1), 7, "started"), ("c", 1, at(2), 8, "completed")])
    # b's second start changes nothing, c's end is of an older generation; the attempts of a and c still run
    assert first == [("a", 1, 0, 5, "failed"), ("b", 1, 6, 50, "completed")]
    second = run([("b", 1, at(60), 9, "started"), ("a", 1, at(61), 10, "started"), ("c", 3, at(62), 11, "started"), ("c", 3, at(63), 12, "completed"), ("z", 1, at(300), 13, "seen")])
    # the attempts begun before the restart end at their limit; b is over and starts no more; c begins anew
    assert second == [("a", 1, 0, 5, "failed"), ("a", 2, 6, 51, "timeout"), ("a", 3, 61, 106, "timeout"), ("b", 1, 6, 50, "completed"), ("c", 1, 1, 46, "timeout"), ("c", 1, 62, 63, "completed")]
    third = run([("a", 1, at(310), 14, "started"), ("a", 1, at(311), 15, "completed"), ("y", 1, at(9000), 16, "seen")])
    assert third == second  # a has failed three times; what is known of it goes with the last row's watermark
    assert run([("a", 1, at(9001), 17, "started"), ("a", 1, at(9002), 18, "completed"), ("y", 1, at(9100), 19, "seen")])[1:2] == [("a", 1, 9001, 9002, "completed")]


def test_entries_end_after_their_retention(spark, tmp_path):
    schema = "id string, at timestamp, seq long, status string"
    folder, where = f"file://{tmp_path}/in", f"file://{tmp_path}/run"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = runs.run_appends(state.retained_entries(stream(spark, folder, schema), "10 seconds"), "entries", where, ROCKS)
        return sorted((r["id"], int((r["began"] - T0).total_seconds()), r["n"], r["status"]) for r in got.collect())

    assert run([("a", at(0), 1, "running"), ("a", at(3000), 2, "running"), ("b", at(10), 3, "running")]) == []
    assert run([("a", at(6000), 4, "completed"), ("c", at(6100), 5, "running")]) == [("b", 10, 1, "running")]
    assert run([("a", at(20000), 6, "again"), ("d", at(30000), 7, "running")]) == [("a", 0, 3, "completed"), ("a", 20000, 1, "again"), ("b", 10, 1, "running"), ("c", 6100, 1, "running")]


def test_spans_without_an_end_come_out(spark, tmp_path):
    s, e = "id string, seq long, at timestamp", "id string, seq long, at timestamp, status string"
    f = {k: f"file://{tmp_path}/{k}" for k in "ser"}

    def run(starts, ends):
        for rows, schema, k in ((starts, s, "s"), (ends, e, "e")):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f[k])
        got = runs.run_appends(state.joined_spans(stream(spark, f["s"], s), stream(spark, f["e"], e), "10 seconds", "100 seconds"), "spans", f["r"])
        return sorted((r["id"], r["start_seq"], r["status"]) for r in state.first_ends(got, ["id", "start_seq", "started"]).collect())

    assert run([("a", 1, at(0)), ("b", 2, at(1)), ("c", 3, at(2))], [("a", 4, at(30), "completed"), ("a", 5, at(20), "failed"), ("x", 6, at(5), "completed")]) == [("a", 1, "failed")]
    # c's end comes in time though in a later run, b never has one
    assert run([("d", 7, at(500))], [("c", 8, at(90), "completed"), ("d", 9, at(510), "failed")]) == [("a", 1, "failed"), ("b", 2, None), ("c", 3, "completed"), ("d", 7, "failed")]


@pytest.fixture(autouse=True)
def _utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and F is not None
