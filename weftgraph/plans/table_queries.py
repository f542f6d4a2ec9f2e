"""Relational bookkeeping: joins, upserts, staleness, manifests, scores, conversations, events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import merge
from .graph_queries import table


def catalog_resolve(spark, d):
    """Two-tier lookup: the qualified name first, else the first candidate by bare name, whatever the case."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("name"), F.lower("r_name").alias("space"), "n_nationkey")
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.lower("n_name").alias("qn"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("none")).otherwise(F.lit("asia")).alias("qs"))
    exact = asked.join(n, (F.col("qn") == F.col("name")) & (F.col("qs") == F.col("space")), "left").select("q", "qn", F.col("n_nationkey").alias("exact"))
    bare = n.groupBy("name").agg(F.min("n_nationkey").alias("bare"))
    return exact.join(bare, F.col("qn") == F.col("name"), "left").select(F.col("q").alias("asked"), F.coalesce("exact", "bare").alias("found"), F.col("exact").isNotNull().alias("qualified"))


def self_join_parent(spark, d):
    c = table(spark, d, "conversations")
    up = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role")).distinct()
    return c.join(up, ["conv_id", "turn"]).select("conv_id", "turn", "role", "parent_role")


def fallback_join(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 3 <> 0")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.concat(F.lit("customer:"), "c_custkey"), F.concat(F.lit("order:"), "o_orderkey")).alias("owner"), F.when(F.col("c_custkey").isNull(), "fallback").otherwise("direct").alias("how"))


def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def page_filter(spark, d):
    p = table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") > 10))
    page = p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(20)
    return page.crossJoin(p.agg(F.count("*").alias("total"))).select("p_partkey", "p_retailprice", "total")  # a page and one row


def upsert_preserve(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.lit("first").alias("seen"), F.col("c_acctbal").alias("score"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("again").alias("seen"), (F.col("c_acctbal") + 1).alias("score"))
    return merge.upsert(old, new, "c_custkey", ["seen"], ["score"])


def miss_stale_prune(spark, d):
    s = table(spark, d, "supplier").withColumn("misses", F.col("s_suppkey") % 4)
    seen = table(spark, d, "lineitem").where("l_quantity > 49").select("l_suppkey").distinct()
    m = s.join(seen, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("misses", F.when(F.col("l_suppkey").isNull(), F.col("misses") + 1).otherwise(0))
    m = m.withColumn("stale", F.col("misses") >= 3)
    return m.orderBy("stale", F.desc("s_acctbal"), "s_suppkey").limit(5000).select("s_suppkey", "misses", "stale")


def manifest_current(spark, d):
    by = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("k", F.row_number().over(by)).where("k <= 2").select("o_custkey", "o_orderkey", (F.col("k") == 1).alias("is_current"))


def discovery_score(spark, d):
    age = (F.lit(1735689600) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) / 86400.0
    fresh = F.greatest(F.lit(0.0), 10 - F.greatest(F.lit(0.0), age) / 36.5)
    popular = F.least(F.lit(15.0), F.log10(F.greatest(F.lit(1.0), F.col("o_totalprice"))) * 5)
    total = F.when(F.col("o_orderstatus") == "F", 0).otherwise(15) + popular + fresh + F.least(F.lit(20.0), fresh * 2)
    return table(spark, d, "orders").select("o_orderkey", F.bround(total.cast("decimal(18,8)"), 2).cast("double").alias("score"))


def conversation_nested(spark, d):
    c = table(spark, d, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"]))
    return c.groupBy("conv_id").agg(F.array_join(turns, " ").alias("turns"), F.count("*").alias("n"))


def turn_idempotent(spark, d):
    c = table(spark, d, "conversations")
    twice = c.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    return merge.last_row(twice, ["conv_id", "turn", "role"], F.col("attempt"), F.col("text")).select("conv_id", "turn", "role", "attempt")


def activity_elapsed(spark, d):
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("ts").over(by))
    return e.where("before is not null").select("event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1000).cast("long").alias("elapsed_ms"))


def job_state_hist(spark, d):
    last = merge.last_row(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return last.agg(F.count("*").alias("jobs"), *[F.count_if(F.col("event_type") == x).alias(x) for x in ("click", "error", "purchase")], F.when(F.count("*") == 0, 100.0).otherwise(F.round(100.0 * F.count_if(F.col("event_type") == "purchase") / F.greatest(F.count("*"), F.lit(1)), 6)).alias("percent"))


def retrieval_p95(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.min("value").alias("least"), F.max("value").alias("most"))


def snapshot_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    new = docs.where("doc_id % 7 <> 0").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("digest")))
    return merge.snapshot_diff(docs.where("doc_id % 11 <> 0"), new, "doc_id", "digest")


def recall_golden(spark, d):
    gold = table(spark, d, "labels").where("quality = 1").select("doc_id")
    found = table(spark, d, "documents").where("n_chars > 500").select("doc_id", F.lit(1).alias("hit"))
    return gold.join(found, "doc_id", "left").agg(F.count("*").alias("golden"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def anti_semi(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer")
    none = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("anti").alias("side"))
    some = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit("semi").alias("side"))
    return none.unionByName(some)


QUERIES = {f.__name__: f for f in (catalog_resolve, self_join_parent, fallback_join, json_flatten, page_filter, upsert_preserve, miss_stale_prune, manifest_current, discovery_score, conversation_nested, turn_idempotent, activity_elapsed, job_state_hist, retrieval_p95, snapshot_diff, recall_golden, anti_semi)}

ORACLE = {
    "catalog_resolve": "WITH n AS (SELECT lower(n_name) AS name, lower(r_name) AS space, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT n_nationkey AS q, lower(n_name) AS qn, CASE WHEN n_nationkey % 2 = 0 THEN 'none' ELSE 'asia' END AS qs FROM nation) SELECT q AS asked, coalesce(e.n_nationkey, b.k) AS found, e.n_nationkey IS NOT NULL AS qualified FROM a LEFT JOIN n e ON qn = e.name AND qs = e.space LEFT JOIN (SELECT name, min(n_nationkey) AS k FROM n GROUP BY name) b ON qn = b.name",
    "self_join_parent": "SELECT c.conv_id, c.turn, c.role, p.role AS parent_role FROM conversations c JOIN (SELECT DISTINCT conv_id, turn, role FROM conversations) p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1",
    "fallback_join": "SELECT o_orderkey, coalesce('customer:' || c_custkey, 'order:' || o_orderkey) AS owner, CASE WHEN c_custkey IS NULL THEN 'fallback' ELSE 'direct' END AS how FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey",
    "json_flatten": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "page_filter": "SELECT p_partkey, p_retailprice, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20",
    "upsert_preserve": "WITH o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL THEN 'first' ELSE 'again' END AS seen, coalesce(n.c_acctbal, o.c_acctbal) AS score FROM o FULL JOIN n ON o.c_custkey = n.c_custkey",
    "miss_stale_prune": "WITH m AS (SELECT s_suppkey, s_acctbal, CASE WHEN l_suppkey IS NULL THEN s_suppkey % 4 + 1 ELSE 0 END AS misses FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49) ON s_suppkey = l_suppkey) SELECT s_suppkey, misses, misses >= 3 AS stale FROM m QUALIFY row_number() OVER (ORDER BY misses >= 3, s_acctbal DESC, s_suppkey) <= 5000",
    "manifest_current": "SELECT o_custkey, o_orderkey, k = 1 AS is_current FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 2",
    "discovery_score": "WITH f AS (SELECT *, greatest(0.0::DOUBLE, 10 - greatest(0.0::DOUBLE, (1735689600 - floor(epoch(o_orderdate)))::DOUBLE / 86400.0::DOUBLE) / 36.5::DOUBLE) AS fresh FROM orders) SELECT o_orderkey, round_even(((CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 15 END + least(15.0::DOUBLE, log10(greatest(1.0::DOUBLE, o_totalprice)) * 5) + fresh + least(20.0::DOUBLE, fresh * 2)))::DECIMAL(18,8), 2)::DOUBLE AS score FROM f",
    "conversation_nested": "SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn, role, text) AS turns, count(*) AS n FROM conversations GROUP BY conv_id",
    "turn_idempotent": "SELECT DISTINCT conv_id, turn, role, 1 AS attempt FROM conversations",
    "activity_elapsed": "SELECT event_id, ((epoch_us(ts) - epoch_us(b)) // 1000)::BIGINT AS elapsed_ms FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL",
    "job_state_hist": "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) SELECT count(*) AS jobs, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, round(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*), 6) AS percent FROM l",
    "retrieval_p95": "SELECT event_type, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "snapshot_diff": "WITH o AS (SELECT doc_id, sha256(text) AS g FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS g FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.g IS NULL THEN 'added' WHEN n.g IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.g IS DISTINCT FROM n.g",
    "recall_golden": "SELECT count(*) AS golden, count(d.doc_id) AS found, round(count(d.doc_id) / count(*), 6) AS recall FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 500) d ON l.doc_id = d.doc_id WHERE quality = 1",
    "anti_semi": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'semi' ELSE 'anti' END AS side FROM customer",
}
