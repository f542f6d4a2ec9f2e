"""State tables made of customers, orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import records
from .graph_queries import table


def _manifests(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 2 = 0")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    return o.join(last, "o_custkey").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") == F.col("m")).alias("is_current"))


def manifest_save(spark, d):
    """SK11: new and known manifests saved, the promoted ones first."""
    o = table(spark, d, "orders")
    pick = lambda m: o.where(F.col("o_orderkey") % 10 == m).groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderkey").alias("version")).withColumn("status", F.lit(f"new{m}"))
    return records.save_manifest(records.save_manifest(_manifests(spark, d), pick(3), True), pick(4), False)


def manifest_activate(spark, d):
    """SK14, SK15: each project's first version made current, all but it and the last pruned."""
    m = _manifests(spark, d)
    first = m.groupBy("project").agg(F.min("version").alias("version"))
    return records.prune_manifests(records.activate(m, first), m.groupBy("project").agg(F.max("version").alias("version")))


def summary_update(spark, d):
    """SK10: summaries written only where all keys agree and the version is active."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("cache"), F.lit("old").alias("summary"))
    u = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).cast("bigint").alias("cache"), F.col("s_name").alias("summary"))
    return records.compare_and_set(s, u, ["project", "id", "cache"], ["summary"], F.col("project") % 4 > 0)


def rows_replaced(spark, d):
    """SK9, SK16, SK21, SK22: rows deleted and inserted by keys that may be null."""
    c = table(spark, d, "customer")
    key = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey"))
    t = c.select(key.alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_custkey").alias("v"))
    new = c.where("c_custkey % 17 = 0").select(key.alias("a"), F.col("c_mktsegment").alias("b"), (-F.col("c_custkey")).alias("v"))
    return records.replace_rows(t, new, ["a", "b"])


def messages_inserted(spark, d):
    """SK25: messages that aren't there yet, once."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    twice = c.where("conv_id % 3 = 0").select("conv_id", "turn", "role", F.explode(F.array(F.col("size") + 1, F.col("size") + 2)).alias("size"))
    return records.insert_missing(c.where("conv_id % 2 = 0"), twice, ["conv_id", "turn", "role"])


def artifacts_saved(spark, d):
    """SK20, JN21: imports upserted by hash and kind, joined with their candidates."""
    p = table(spark, d, "part")
    old = p.where("p_partkey % 3 = 0").groupBy(F.concat_ws(":", "p_brand", "p_type").alias("hash")).agg(F.min("p_partkey").alias("id")).withColumn("imported", F.lit("old"))
    new = p.where("p_partkey % 2 = 0").groupBy(F.concat_ws(":", "p_brand", "p_type").alias("hash")).agg(F.min("p_partkey").alias("id")).withColumn("imported", F.lit("new"))
    from ..operators.merge import upsert

    saved = upsert(old, new, "hash", ["id"], ["imported"])
    return saved.join(p.select(F.col("p_partkey").alias("id"), "p_name"), "id").select("hash", "id", "imported", "p_name")


def run_states(spark, d):
    """SK19, SK23: the last state of runs by an append-only log, with the steps that aren't allowed."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    return records.latest_state(e, "user_id", "event_id", {"": ("view", "click"), "view": ("click", "purchase"), "click": ("purchase", "error", "view"), "error": ("click",)})


def favourites(spark, d):
    """SK19, SK22b: a flag set on listed rows; those in three states alone are shown."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("state"), F.lit(False).alias("favourite"))
    u = table(spark, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("favourite"))
    return records.compare_and_set(o, u, ["id"], ["favourite"]).where("substring(state, 1, 1) in ('1', '2', '4')")


def cascaded(spark, d):
    """SK24: what is left of customers, orders and their lines when some customers go."""
    gone = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"))
    t = {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders"), "lineitem": table(spark, d, "lineitem")}
    left = records.cascade_delete(t, {"customer": "c_custkey", "orders": "o_custkey"}, gone, {"lineitem": ("l_orderkey", "orders", "o_orderkey")})
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def turn_actions(spark, d):
    """SM5: what becomes of asked turns."""
    c = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("conv"), "turn", F.md5("text").alias("hash"))
    state = F.element_at(F.array(*map(F.lit, ("Completed", "Failed", "Running", "Cancelled"))), (F.col("conv") % 4 + 1).cast("int"))
    known = c.where("conv % 5 > 0").groupBy("conv", "turn").agg(F.min("hash").alias("hash")).select("conv", "turn", F.when(F.col("turn") % 6 == 0, "x").otherwise(F.col("hash")).alias("hash"), state.alias("state"), (F.col("conv") % 3).cast("int").alias("attempt"))
    return records.begin_turns(known, c.unionByName(c))


def queue_states(spark, d):
    """SM7: jobs of an event log by user."""
    e = table(spark, d, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "started", "view", "queued", "purchase", "done", "error", "failed")]), F.col("event_type"))
    jobs = e.select("user_id", (F.col("event_id") % 2).alias("version"), F.coalesce(kind, F.lit("failed")).alias("kind"), "event_id")
    return records.queue_states(jobs, ["user_id", "version"], "event_id", F.col("version") == 1)


def prewarm_candidates(spark, d):
    """GR31, SM8: the largest reports that still need a summary."""
    r = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("members")).withColumns({"tier": F.when(F.col("id") % 4 == 0, "C1").otherwise("C0"), "state": F.when(F.col("id") % 3 == 0, "Completed").when(F.col("id") % 3 == 1, "Failed")})
    return records.prewarm(r, 10)


def recent_progress(spark, d):
    """SM9, SM10: the newest event of users, of the last hours."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    end = e.agg(F.max("ts").alias("ts")).first()["ts"]
    return records.recent_progress(e, "user_id", "ts", F.lit(end).cast("timestamp"), 48).select("user_id", "event_id", "event_type")


def current_runs(spark, d):
    """SM1, SM12, WN7: the events of each user's newest run (a day), in their sequence."""
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("run"), "ts", "event_id")
    return records.numbered(records.current_run(e, "user_id", "run"), "user_id", ["ts", "event_id"]).select("user_id", "run", "event_id", "sequence")


def fragment_merge(spark, d):
    """MG4, MG5, MG6, MG13: edges of fragments in their phases."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.lit("CALLS").alias("type"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.struct((F.col("l_linenumber") % 3).alias("phase"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).alias("seq"), F.col("l_linenumber").cast("bigint").alias("occurrence_count"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey")).alias("p"), F.when(F.col("l_orderkey") % 3 == 0, F.array(F.col("l_orderkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("locations"))
    m = records.merge_fragments(rows, "seq", ["p"], "locations")
    return m.select("src", "dst", "occurrence_count", "p", F.array_join("locations", ",").alias("locations"))


def counted_merge(spark, d):
    """MG7, MG11: occurrence counts that add up, by type of edge."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("T"), (F.col("l_linenumber") % 3).cast("string")).alias("type"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 9).alias("dst"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_orderkey") % 4).alias("occurrence_count"))
    return records.add_up_counts(li)


def declared_merge(spark, d):
    """MG3, MG8, MG9: kinds of declarations that others don't overwrite, beside whole rows that do."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    a = records.merge_declared(e, ["user_id"], "event_id", "kind", F.col("kind") == "purchase", ["value"])
    b = records.whole_row_wins(e, ["user_id"], "event_id").select("user_id", F.col("kind").alias("last_kind"), F.col("value").alias("last_value"))
    return a.join(b, "user_id")


def raw_ingest(spark, d):
    """SC24, PF5: raw kinds in the vocabulary's spelling, and how many it doesn't have."""
    from ..schema import NODE_KINDS

    raw = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("TYPE", "method", "Databaseobject", "nothing"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"))
    known, unknown = records.ingest(raw, "kind", NODE_KINDS)
    return known.groupBy("kind").agg(F.count("*").alias("n")).unionByName(unknown.agg(F.lit("unknown").alias("kind"), F.count("*").alias("n")))


def source_fingerprint(spark, d):
    """SC25: the hash of the configured sources."""
    return records.source_fingerprint(table(spark, d, "supplier"), "s_name", ["s_name", "s_nationkey"])


def snapshot_verify(spark, d):
    """FT18, SC12: the first paths that changed, and how many."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return records.verify_snapshot(docs, docs.where("doc_id % 9 > 0").withColumn("digest", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.col("digest"))), "doc_id", "digest")


def marker_folders(spark, d):
    """SC14, SC19: folders with a marker file, once each."""
    p = table(spark, d, "part").select(F.concat(F.lit("r/a"), (F.col("p_partkey") % 13).cast("string"), F.element_at(F.array(*map(F.lit, ("/SKILL.md", "/skill.MD", "/.mcp.json", "/x.txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("path"), F.col("p_partkey").alias("seq"))
    return records.first_markers(p, "path", {"Skill": "SKILL.md", "McpServer": ".mcp.json"}, "seq")


def token_usage(spark, d):
    """AG10, AG16: tokens and counts by role, and their shares by kind of length."""
    c = table(spark, d, "conversations").withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    return c.groupBy("role", F.when(F.col("tokens") > 40, "long").otherwise("short").alias("kind")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if(F.col("turn") == 0).alias("first"))


def conversation_list(spark, d):
    """PF7, ST4, ST6, WN9: conversations of one route, newest first, ranked, a clamped number of them."""
    from ..operators.views import clamp

    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).withColumn("project", F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 3))
    top = c.where("project is null").orderBy(F.desc("updated"), "conv_id").limit(clamp(5000, 1, 40))
    return records.numbered(top.withColumn("one", F.lit(1)).withColumn("newest", -F.col("updated")), "one", ["newest", "conv_id"]).select("conv_id", "updated", F.col("sequence").alias("rank"))


def normal_paths(spark, d):
    """SC23: the selected one of several solutions, and each path's normal form."""
    names = [f"{x}.sln" for x in ("a", "B")]
    chosen = records.choose_one(names, "b.SLN")
    return table(spark, d, "region").select("r_regionkey", F.lit(chosen).alias("chosen"), paths.normalize_path(F.concat(F.lit("c:\\s\\"), F.col("r_name"), F.lit("/"))).alias("path"))


QUERIES = {f.__name__: f for f in (manifest_save, manifest_activate, summary_update, rows_replaced, messages_inserted, artifacts_saved, run_states, favourites, cascaded, turn_actions, queue_states, prewarm_candidates, recent_progress, current_runs, fragment_merge, counted_merge, declared_merge, raw_ingest, source_fingerprint, snapshot_verify, marker_folders, token_usage, conversation_list, normal_paths)}

_MAN = "m0 AS (SELECT o_custkey AS project, o_orderkey AS version, o_orderstatus AS status, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders WHERE o_custkey % 2 = 0)"
_PICK = "SELECT o_custkey AS project, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 10 = {m} GROUP BY 1"

ORACLE = {
    "run_states": """WITH RECURSIVE o AS (SELECT user_id, event_type AS st, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, '' AS state, 0 AS rejected FROM o
  UNION ALL SELECT f.user_id, o.k, CASE WHEN ok THEN st ELSE state END, rejected + (NOT ok)::INTEGER
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1, LATERAL (SELECT (f.state, o.st) IN (('', 'view'), ('', 'click'), ('view', 'click'), ('view', 'purchase'), ('click', 'purchase'), ('click', 'error'), ('click', 'view'), ('error', 'click')) AS ok) t
) SELECT user_id, arg_max(state, k) AS state, max(rejected) AS rejected FROM f GROUP BY user_id""",
    "manifest_save": f"""WITH {_MAN}, a AS ({_PICK.format(m=3)}), b AS ({_PICK.format(m=4)}),
m1 AS (SELECT coalesce(m0.project, a.project) AS project, coalesce(m0.version, a.version) AS version, CASE WHEN a.version IS NOT NULL THEN 'new3' ELSE m0.status END AS status, CASE WHEN a.version IS NOT NULL THEN true WHEN coalesce(m0.project, a.project) IN (SELECT project FROM a) THEN false ELSE m0.is_current END AS is_current FROM m0 FULL JOIN a ON m0.project = a.project AND m0.version = a.version)
SELECT coalesce(m1.project, b.project) AS project, coalesce(m1.version, b.version) AS version, CASE WHEN b.version IS NOT NULL AND NOT coalesce(m1.is_current, false) THEN 'new4' ELSE m1.status END AS status, coalesce(m1.is_current, false) AS is_current FROM m1 FULL JOIN b ON m1.project = b.project AND m1.version = b.version""",
    "manifest_activate": f"WITH {_MAN} SELECT project, version, status, version = min(version) OVER (PARTITION BY project) AS is_current FROM m0 QUALIFY version = min(version) OVER (PARTITION BY project) OR version = max(version) OVER (PARTITION BY project)",
    "summary_update": "SELECT s_nationkey AS project, s_suppkey AS id, s_suppkey % 3 AS cache, CASE WHEN s_suppkey % 3 = s_suppkey % 2 AND s_nationkey % 4 > 0 THEN s_name ELSE 'old' END AS summary, s_suppkey % 3 = s_suppkey % 2 AND s_nationkey % 4 > 0 AS updated FROM supplier",
    "rows_replaced": "WITH t AS (SELECT CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS a, c_mktsegment AS b, c_custkey AS v FROM customer), n AS (SELECT a, b, -v AS v FROM t WHERE v % 17 = 0) SELECT * FROM t WHERE NOT EXISTS (SELECT * FROM n WHERE n.a IS NOT DISTINCT FROM t.a AND n.b = t.b) UNION ALL SELECT * FROM n",
    "messages_inserted": "SELECT conv_id, turn, role, (length(text) + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END)::INTEGER AS size FROM conversations WHERE conv_id % 2 = 0 OR conv_id % 3 = 0",
    "artifacts_saved": "WITH p AS (SELECT p_brand || ':' || p_type AS hash, min(p_partkey) FILTER (p_partkey % 3 = 0) AS a, min(p_partkey) FILTER (p_partkey % 2 = 0) AS b FROM part GROUP BY 1) SELECT hash, coalesce(a, b) AS id, CASE WHEN b IS NOT NULL THEN 'new' ELSE 'old' END AS imported, p_name FROM p JOIN part ON p_partkey = coalesce(a, b)",
    "favourites": "SELECT o_orderkey AS id, o_orderpriority AS state, o_orderkey % 9 = 0 AS favourite, o_orderkey % 9 = 0 AS updated FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2', '4')",
    "cascaded": "SELECT 'customer' AS \"table\", count(*) AS n FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0))",
    "turn_actions": """WITH c AS (SELECT conv_id AS conv, turn, min(md5(text)) AS h, count(DISTINCT md5(text)) AS kinds FROM conversations WHERE role = 'user' GROUP BY ALL),
k AS (SELECT *, conv % 5 > 0 AS known, (['Completed', 'Failed', 'Running', 'Cancelled'])[conv % 4 + 1] AS state FROM c),
a AS (SELECT *, CASE WHEN kinds > 1 OR (known AND turn % 6 = 0) THEN 'mismatch' WHEN NOT known THEN 'begin' WHEN state = 'Completed' THEN 'replay' WHEN state IN ('Failed', 'Cancelled') THEN 'resume' ELSE 'wait' END AS action FROM k)
SELECT conv, turn, action, CASE WHEN action = 'begin' THEN 1 WHEN action = 'resume' THEN conv % 3 + 1 WHEN known THEN conv % 3 END::INTEGER AS attempt FROM a""",
    "queue_states": """WITH e AS (SELECT user_id, event_id % 2 AS version, CASE event_type WHEN 'click' THEN 'started' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS kind, event_id FROM events),
g AS (SELECT user_id, version, arg_max(kind, event_id) AS last, count(*) FILTER (kind = 'failed') AS fails, count(*) FILTER (kind = 'started') AS attempts FROM e GROUP BY ALL)
SELECT user_id, version, CASE WHEN version <> 1 THEN 'dropped' WHEN last = 'done' THEN 'done' WHEN last = 'failed' AND fails > 2 THEN 'failed' WHEN last = 'failed' THEN 'retrying' WHEN last = 'started' THEN 'running' ELSE 'queued' END AS state, attempts FROM g""",
    "prewarm_candidates": "SELECT id FROM (SELECT c_nationkey AS id, count(*) AS members FROM customer WHERE c_nationkey % 4 > 0 GROUP BY 1 ORDER BY members DESC, id LIMIT 10) WHERE id % 3 <> 0",
    "recent_progress": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR",
    "current_runs": "WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS run, ts, event_id FROM events), n AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS m FROM e) SELECT user_id, run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS sequence FROM n WHERE run = m",
    "fragment_merge": """WITH r AS (SELECT l_suppkey AS src, l_partkey % 20 AS dst, (l_linenumber % 3, l_orderkey, l_linenumber) AS seq, l_linenumber::BIGINT AS occurrence_count, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey END AS p, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey::VARCHAR END AS loc FROM lineitem)
SELECT src, dst, arg_max(occurrence_count, seq) AS occurrence_count, arg_max(p, seq) FILTER (p IS NOT NULL) AS p, arg_max(loc, seq) FILTER (loc IS NOT NULL) AS locations FROM r GROUP BY ALL""",
    "counted_merge": "SELECT 'T' || l_linenumber % 3 AS type, l_suppkey AS src, l_partkey % 9 AS dst, sum(greatest(coalesce(CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey % 4 END, 1), 1))::BIGINT AS occurrence_count FROM lineitem GROUP BY ALL",
    "declared_merge": "SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (event_type = 'purchase'), arg_max(event_type, event_id) FILTER (event_type IS NOT NULL)) AS kind, arg_max(value, event_id) FILTER (event_id % 3 = 0 AND value IS NOT NULL) AS value, arg_max(event_type, event_id) AS last_kind, CASE WHEN max(event_id) % 3 = 0 THEN arg_max(value, event_id) END AS last_value FROM events GROUP BY user_id",
    "raw_ingest": "SELECT (['Type', 'Method', 'DatabaseObject', 'unknown'])[p_partkey % 4 + 1] AS kind, count(*) AS n FROM part GROUP BY 1",
    "source_fingerprint": "SELECT sha256(string_agg(s_name || chr(0) || s_nationkey, chr(0) ORDER BY lower(s_name), s_name)) AS fingerprint FROM supplier",
    "snapshot_verify": "WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 9 = 0 AND text IS NOT NULL) OR (doc_id % 9 > 0 AND doc_id % 6 = 0)) SELECT *, (SELECT count(*) FROM c) AS changes FROM c ORDER BY doc_id LIMIT 10",
    "marker_folders": "SELECT CASE WHEN p_partkey % 4 < 2 THEN 'Skill' ELSE 'McpServer' END AS kind, 'r/a' || p_partkey % 13 AS folder, min(p_partkey) AS seq FROM part WHERE p_partkey % 4 < 3 GROUP BY ALL",
    "token_usage": "WITH c AS (SELECT *, greatest(1, length(text) // 4) AS t FROM conversations) SELECT role, CASE WHEN t > 40 THEN 'long' ELSE 'short' END AS kind, count(*) AS n, sum(t)::BIGINT AS tokens, count(*) FILTER (turn = 0) AS first FROM c GROUP BY ALL",
    "conversation_list": "SELECT conv_id, updated, row_number() OVER (ORDER BY updated DESC, conv_id)::INTEGER AS rank FROM (SELECT conv_id, max(turn) AS updated FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id ORDER BY updated DESC, conv_id LIMIT 40)",
    "normal_paths": "SELECT r_regionkey, 'B.sln' AS chosen, upper('C:/S/' || r_name) AS path FROM region",
}
