"""Lookups, version constraints and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import joins
from ..streaming import runs
from .graph_queries import derive, table


def first_lookup(spark, d):
    """The first part (least key) of each line's brand, whatever the case."""
    brands = table(spark, d, "part").select("p_brand").distinct().withColumn("asked", F.upper("p_brand"))
    return joins.first_lookup(brands, F.col("asked"), table(spark, d, "part"), F.col("p_brand"), F.col("p_partkey"), F.col("p_partkey"), "first_part").select("asked", "first_part")


def resolve_or_create(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey")
    return joins.resolve_or_create(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), known, "c_custkey", "CODE_ONLY_OR_HISTORICAL")


def first_existing(spark, d):
    """Of three candidate order keys of each part the first that exists."""
    k = F.col("p_partkey")
    files = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    return joins.first_existing(table(spark, d, "part"), "p_partkey", F.array(*[(k * m).cast("string") for m in (97, 3, 1)]), files, "path")


def edge_endpoints(spark, d):
    nodes, edges = derive(spark, d)
    return joins.endpoints(edges, nodes).groupBy("type", "src_kind", "dst_kind").agg(F.count("*").alias("n"))


def version_constraints(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")).alias("version"))
    return p.select("p_partkey", values.satisfies(F.col("version"), F.lit(">=9.2, <30")).alias("within"), values.satisfies(F.col("version"), F.lit("=7")).alias("is_seven"))


def stream_window_counts(spark, d):
    got = runs.run_updates(runs.window_counts(runs.folder_stream(spark, f"{d}/events.parquet"), "ts", "event_type"), ["start", "event_type"], "windows")
    return got.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def stream_last_event(spark, d):
    return runs.run_updates(runs.last_of_key(runs.folder_stream(spark, f"{d}/events.parquet"), "user_id", ["ts", "event_id"], ["event_id", "event_type"]), ["user_id"], "last")


def stream_run_text(spark, d):
    got = runs.run_updates(runs.run_text(runs.folder_stream(spark, f"{d}/conversations.parquet"), "conv_id", ["turn", "role"], "text"), ["conv_id"], "text")
    return got.select("conv_id", "n", F.sha2("content", 256).alias("digest"))


def stream_spans(spark, d):
    """SM2: activities (users) as spans, from their events."""
    got = runs.run_updates(runs.activity_spans(runs.folder_stream(spark, f"{d}/events.parquet"), "user_id", "ts", "event_type", ("purchase", "error")), ["user_id"], "spans")
    return got.select("user_id", ((F.unix_micros("ended") - F.unix_micros("started")) / 1000).cast("long").alias("elapsed_ms"), "n")


def stream_turns(spark, d):
    """SM5, SK25: each message once."""
    got = runs.run_updates(runs.first_of_turn(runs.folder_stream(spark, f"{d}/conversations.parquet"), ["conv_id", "turn", "role"], ["text"]), ["conv_id", "turn", "role"], "turns")
    return got.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "n")


def stream_jobs(spark, d):
    """SM7: the states of jobs (users)."""
    return runs.run_updates(runs.job_states(runs.folder_stream(spark, f"{d}/events.parquet"), "user_id", "event_id", "event_type", "error", 5), ["user_id"], "jobs")


QUERIES = {f.__name__: f for f in (stream_spans, stream_turns, stream_jobs, first_lookup, resolve_or_create, first_existing, edge_endpoints, version_constraints, stream_window_counts, stream_last_event, stream_run_text)}

ORACLE = {
    "first_lookup": "SELECT upper(b.p_brand) AS asked, (SELECT min(p_partkey) FROM part p WHERE lower(p.p_brand) = lower(b.p_brand)) AS first_part FROM (SELECT DISTINCT p_brand FROM part) b",
    "resolve_or_create": "SELECT c_custkey, 'KNOWN' AS status FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'CODE_ONLY_OR_HISTORICAL' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "first_existing": "SELECT p_partkey, CASE WHEN p_partkey * 97 IN (SELECT o_orderkey FROM orders) THEN (p_partkey * 97)::VARCHAR WHEN p_partkey * 3 IN (SELECT o_orderkey FROM orders) THEN (p_partkey * 3)::VARCHAR WHEN p_partkey IN (SELECT o_orderkey FROM orders) THEN p_partkey::VARCHAR END AS found FROM part",
    "version_constraints": "SELECT p_partkey, (p_size > 9 OR (p_size = 9 AND p_partkey % 12 >= 2)) AND p_size < 30 AS within, p_size = 7 AS is_seven FROM part",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_last_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "stream_run_text": "SELECT conv_id, count(*) AS n, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "stream_spans": "SELECT user_id, ((epoch_us(max(ts) FILTER (event_type IN ('purchase', 'error'))) - epoch_us(min(ts))) // 1000)::BIGINT AS elapsed_ms, count(*) AS n FROM events GROUP BY user_id",
    "stream_turns": "SELECT conv_id, turn, role, md5(min(text)) AS digest, count(*) AS n FROM conversations GROUP BY ALL",
    "stream_jobs": "SELECT user_id, arg_max(event_type, event_id) AS last, count(*) FILTER (event_type = 'error') AS fails, count(*) FILTER (event_type = 'error') > 5 AS given_up FROM events GROUP BY user_id",
}
