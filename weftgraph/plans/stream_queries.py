"""Streams whose state ends by timers and watermarks, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import runs, state

HOUR = 3600
ROCKS = {"spark.sql.streaming.stateStore.providerClass": state.PROVIDER}


def _events(spark, d):
    e = runs.folder_stream(spark, f"{d}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))


def stream_job_attempts(spark, d):
    """SM7, SM12: jobs (users) with a limit of two hours an attempt and two retries; an attempt is started by a click."""
    step = F.when(F.col("status") == "click", "started").when(F.col("status") == "purchase", "completed").when(F.col("status") == "error", "failed").otherwise("seen")
    steps = _events(spark, d).select(F.col("id").alias("job"), F.lit(1).cast("long").alias("generation"), "at", "seq", step.alias("step"))
    got = runs.run_appends(state.job_attempts(steps, limit_s=2 * HOUR, retain_s=400 * 24 * HOUR), "attempts", conf=ROCKS)
    return got.select("job", "attempt", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "outcome")


def stream_retained(spark, d):
    """SM9: progress entries (users) that end six hours after their last report."""
    got = runs.run_appends(state.retained_entries(_events(spark, d), retain_s=6 * HOUR), "retained", conf=ROCKS)
    return got.select("id", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "n", "status")


def stream_joined_spans(spark, d):
    """SM1, SM2: each view with the first purchase or error of its user within six hours, or none (-1) once none can come."""
    e = _events(spark, d)
    ends = _events(spark, d).where("status in ('purchase', 'error')").withColumn("status", F.when(F.col("status") == "error", "failed").otherwise("completed"))
    got = runs.run_appends(state.joined_spans(e.where("status = 'view'"), ends, limit="6 hours"), "joined")
    first = state.first_ends(got, ["id", "start_seq", "started"])
    return first.select("id", "start_seq", F.coalesce(((F.unix_micros("ended") - F.unix_micros("started")) / 1000).cast("long"), F.lit(-1)).alias("elapsed_ms"), "status")


QUERIES = {f.__name__: f for f in (stream_job_attempts, stream_retained, stream_joined_spans)}

_LIMIT = 2 * HOUR * 1_000_000


def _attempts() -> str:
    """Three attempts at most, one after the other: each starts at the first click after the end of the one before it."""
    out = ["e AS (SELECT user_id::VARCHAR AS job, epoch_us(ts) AS us, event_id AS seq, event_type AS kind FROM events), mark AS (SELECT max(us) - 60000000 AS mark FROM e), a0 AS (SELECT DISTINCT job, -1::BIGINT AS us, -1::BIGINT AS seq, 0 AS fails, false AS over FROM e)"]
    for k in (1, 2, 3):
        out.append(f"""s{k} AS (SELECT p.job, p.fails, min((e.us, e.seq)) AS b FROM a{k - 1} p JOIN e ON e.job = p.job AND e.kind = 'click' AND (e.us, e.seq) > (p.us, p.seq) WHERE NOT p.over GROUP BY ALL),
t{k} AS (SELECT s.job, s.fails, s.b[1] AS began, min((e.us, e.seq, e.kind)) FILTER (e.kind IN ('purchase', 'error') AND e.us <= s.b[1] + {_LIMIT}) AS x, max(e.us) AS newest FROM s{k} s JOIN e ON e.job = s.job AND (e.us, e.seq) >= s.b GROUP BY ALL),
o{k} AS (SELECT job, {k} AS attempt, began, coalesce(x[1], began + {_LIMIT}) AS ended, CASE x[3] WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'timeout' END AS outcome, fails, coalesce(x[2], 9223372036854775807) AS seq FROM t{k}, mark WHERE x IS NOT NULL OR newest > began + {_LIMIT} OR began + {_LIMIT} < mark),
a{k} AS (SELECT job, ended AS us, seq, fails + (outcome <> 'completed')::INT AS fails, outcome = 'completed' OR fails + (outcome <> 'completed')::INT > 2 AS over FROM o{k})""")
    return "WITH " + ",\n".join(out) + " SELECT job, attempt, began AS started, ended, outcome FROM (FROM o1 UNION ALL FROM o2 UNION ALL FROM o3)"


ORACLE = {
    "stream_job_attempts": _attempts(),
    "stream_retained": f"""WITH e AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) AS us, event_id AS seq, event_type AS status FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {6 * HOUR * 1_000_000} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY id ORDER BY us, seq)),
n AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY us, seq) AS part FROM g),
s AS (SELECT id, part, min(us) AS began, max(us) AS ended, count(*) AS n, arg_max(status, (us, seq)) AS status, max(part) OVER (PARTITION BY id) AS newest FROM n GROUP BY id, part)
SELECT id, began, ended, n, status FROM s WHERE part < newest OR ended + {6 * HOUR * 1_000_000} < (SELECT max(us) - 60000000 FROM e)""",
    "stream_joined_spans": f"""WITH e AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) AS us, event_id AS seq, event_type AS kind FROM events),
mark AS (SELECT least(max(us) FILTER (kind = 'view'), max(us) FILTER (kind IN ('purchase', 'error'))) - 600000000 AS mark FROM e),
j AS (SELECT s.id, s.seq, s.us, min((f.us, CASE f.kind WHEN 'error' THEN 'failed' ELSE 'completed' END)) FILTER (f.us IS NOT NULL) AS x FROM e s LEFT JOIN e f ON f.id = s.id AND f.kind IN ('purchase', 'error') AND f.us BETWEEN s.us AND s.us + {6 * HOUR * 1_000_000} WHERE s.kind = 'view' GROUP BY ALL)
SELECT id, seq AS start_seq, coalesce((x[1] - us) // 1000, -1) AS elapsed_ms, x[2] AS status FROM j, mark WHERE x[1] IS NOT NULL OR us + {6 * HOUR * 1_000_000} < mark""",
}
