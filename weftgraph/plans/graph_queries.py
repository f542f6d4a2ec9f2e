"""Graph queries over a graph derived from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import edge_id, stable_id
from ..operators import graph, merge
from ..schema import BACKBONE, CENTRAL, STRUCTURAL
from ..storage import GraphStore, listing, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stores: dict[tuple[str, str, str], GraphStore] = {}


def derive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the star schema as a property graph: the current snapshot of a store in the shared folder.

    The first query of an application builds, validates and promotes it; all others read it, pruned by kind and type.
    """
    return stored(spark, sf_dir).snapshot("star", 1)


def stored(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The store that derive() reads; a table that has been rewritten since gets a new one."""
    key = (spark.sparkContext.applicationId, sf_dir, listing(spark, sf_dir))
    if key not in _stores:
        store = GraphStore(spark, f"{scratch_dir(spark)}/{key[0]}/graph-{uuid.uuid4().hex}")
        nodes, edges = build(spark, sf_dir)
        store.stage("star", 1, nodes, edges.drop("edge_id"))
        store.promote("star", 1)
        _stores[key] = store
    return _stores[key]


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) derived from the tables."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    props = lambda **p: F.to_variant_object(F.struct(*[F.expr(v).alias(k) for k, v in p.items()])) if p else F.parse_json(F.lit(None).cast("string"))

    def node(name: str, prefix: str, k: str, kind: str, label: str, **own: str) -> DataFrame:
        return t(name).select(key(prefix, k).alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("name"), props(**own).alias("properties"))

    def edge(df: DataFrame, type_: str, src: Column, dst: Column, n: Column | None = None, **own: str) -> DataFrame:
        return df.select(F.lit(type_).alias("type"), src.alias("src"), dst.alias("dst"), (n if n is not None else F.lit(1)).cast("long").alias("occurrence_count"), props(**own).alias("properties"))

    nodes = [
        node("region", "region", "r_regionkey", "Database", "r_name"),
        node("nation", "nation", "n_nationkey", "Namespace", "n_name", qualifiedName="concat('world.', lower(n_name))"),
        node("customer", "customer", "c_custkey", "MenuItem", "c_name", route="concat('/customers/', c_custkey)", description="lower(c_mktsegment)"),
        node("supplier", "supplier", "s_suppkey", "ApiEndpoint", "s_name", route="concat('/api/suppliers/', s_suppkey)"),
        node("part", "part", "p_partkey", "Type", "p_name", filePath="concat('src/', p_brand, '.cs')", objectName="p_brand", signature="concat(lower(p_type), ' ', p_name)", startLine="p_size"),
        node("orders", "order", "o_orderkey", "Method", "o_orderstatus", filePath="concat('src/', o_orderpriority, '.cs')", startLine="o_custkey % 500 + 1"),
    ]
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    n = lines.count()  # from the files' footers
    parts = 1 + max(n // 500_000, min(n // 20_000, spark.sparkContext.defaultParallelism))  # by rows: edges are far wider than the keys that Spark would measure
    of = lambda k, *c: lines.select(k, *c).repartition(parts, k)  # noqa: E731  # nearly all pairs are distinct, so they are dealt out first and grouped once
    edges = [
        edge(t("nation"), "CONTAINS_PROJECT", key("region", "n_regionkey"), key("nation", "n_nationkey")),
        edge(t("customer"), "DEFINED_IN_PROJECT", key("customer", "c_custkey"), key("nation", "c_nationkey")),
        edge(t("supplier"), "DEFINED_IN_PROJECT", key("supplier", "s_suppkey"), key("nation", "s_nationkey")),
        edge(t("orders"), "FOREIGN_KEY_TO", key("order", "o_orderkey"), key("customer", "o_custkey"), reference="o_orderstatus"),
        edge(of("l_orderkey", "l_partkey", "l_linenumber").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("line")), "CALLS", key("order", "l_orderkey"), key("part", "l_partkey"), F.col("n"), location="concat('src/', l_orderkey % 100, '.cs')", line="line"),
        edge(of("l_partkey", "l_suppkey").distinct(), "READS", key("part", "l_partkey"), key("supplier", "l_suppkey")),
    ]
    n, e = nodes[0], edges[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.unionByName(x)
    return n, e.withColumn("edge_id", edge_id(F.col("type"), F.col("src"), F.col("dst")))


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


GRAPH = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Database' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Namespace', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'MenuItem', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'ApiEndpoint', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Type', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Method', o_orderstatus FROM orders
), edges0 AS (
  SELECT 'CONTAINS_PROJECT' AS type, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 1::BIGINT AS occurrence_count FROM nation
  UNION ALL SELECT 'DEFINED_IN_PROJECT', 'customer:' || c_custkey, 'nation:' || c_nationkey, 1 FROM customer
  UNION ALL SELECT 'DEFINED_IN_PROJECT', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'FOREIGN_KEY_TO', 'order:' || o_orderkey, 'customer:' || o_custkey, 1 FROM orders
  UNION ALL SELECT 'CALLS', 'order:' || l_orderkey, 'part:' || l_partkey, count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'READS', 'part:' || l_partkey, 'supplier:' || l_suppkey, 1 FROM lineitem
), edges AS (SELECT *, sha256(type || '|' || src || '|' || dst) AS edge_id FROM edges0),
incident AS (
  SELECT src AS center, dst AS neighbor, 'outgoing' AS direction, type, edge_id FROM edges
  UNION ALL SELECT dst, src, 'incoming', type, edge_id FROM edges WHERE src <> dst
)"""
WEIGHT = f"CASE WHEN type IN ({_in(BACKBONE)}) THEN 100 WHEN type IN ({_in(STRUCTURAL)}) THEN 80 ELSE 50 END"


def edge_merge_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("CALLS").alias("type"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.struct("l_linenumber", "l_shipdate").alias("seq"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    out = merge.merge_edges(rows, "seq", ["day"])
    return out.select("src", "dst", "occurrence_count", F.col("day").alias("first_day"))


def node_merge_last_wins(spark, d):
    return merge.last_non_null(table(spark, d, "events"), ["user_id"], "event_id", ["event_type", "value"]).select("user_id", "event_type", "value")


def neighbors_topk(spark, d):
    return graph.neighbors(derive(spark, d)[1].drop("edge_id"), None, 5).select("center", "neighbor", "direction", "type", "edge_id", "rank")


def neighbors_directed(spark, d):
    return graph.directed_neighbors(derive(spark, d)[1], "nation:3", False, 50)




def _reach(spark, d):
    edges = derive(spark, d)[1]
    return graph.breadth_first(edges, ["region:0"], 3)


def bfs_depth3(spark, d):
    return _reach(spark, d).select("id", "depth")


def shortest_paths(spark, d):
    return _reach(spark, d).select("id", "depth", "path")


def var_length_paths(spark, d):
    edges = derive(spark, d)[1].where(F.col("type").isin("CONTAINS_PROJECT") | F.col("src").startswith("supplier:"))
    down = edges.where("type = 'DEFINED_IN_PROJECT'").unionByName(edges.where("type = 'CONTAINS_PROJECT'").select("type", F.col("dst").alias("src"), F.col("src").alias("dst"), "occurrence_count", "edge_id"))
    return graph.trails(down, 4)


def central_nodes(spark, d):
    return graph.central_nodes(*derive(spark, d), 200).select("id", "kind", "degree")


def facet_counts(spark, d):
    n, e = derive(spark, d)
    return n.groupBy(F.lit("node").alias("facet"), F.col("kind").alias("value")).count().unionByName(e.groupBy(F.lit("edge").alias("facet"), F.col("type").alias("value")).count()).withColumnRenamed("count", "n")


def induced_subgraph(spark, d):
    n, e = derive(spark, d)
    return graph.induced(e, n.where(F.col("kind").isin("Namespace", "Database", "ApiEndpoint"))).select("type", "src", "dst", "occurrence_count")


def edge_sample_core(spark, d):
    n, e = derive(spark, d)
    return graph.edge_core(e, F.when(F.col("type") == "CONTAINS_PROJECT", 0).when(F.col("type") == "DEFINED_IN_PROJECT", 1).otherwise(2), 100)


def same_group_subgraph(spark, d):
    docs = table(spark, d, "documents")
    groups = docs.where("doc_id in (1, 2, 3)").select("source").distinct()
    return docs.join(groups, "source", "left_semi").select("doc_id", "source", F.col("doc_id").isin(1, 2, 3).alias("center"))


def list_nodes_filter(spark, d):
    n, _ = derive(spark, d)
    return n.where((F.col("kind") == "Type") & F.contains(F.lower("name"), F.lit("a"))).orderBy(F.lower("name"), "id").limit(200).select("id", "name")


def graph_validate(spark, d):
    return graph.validate(*derive(spark, d))


def storage_diag(spark, d):
    """GR27: how many versions a store holds, and the nodes of the current one and of the others: an older one has no methods."""
    store = GraphStore(spark, f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/diag-{uuid.uuid4().hex}")
    nodes, edges = derive(spark, d)
    edges = edges.drop("edge_id")  # the rule's, so the store makes them
    old = nodes.where("kind <> 'Method'")
    store.stage("star", 1, old, graph.induced(edges, old))
    store.promote("star", 1)
    store.stage("star", 2, nodes, edges)
    store.promote("star", 2, instead_of=1)
    found = store.diagnostics("star")
    return spark.createDataFrame([tuple(found.values())], "versions long, active long, inactive long")


def community_local_move(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("a"), F.concat(F.lit("part:"), "l_partkey").alias("b"))
    return graph.communities(e.withColumn("w", F.lit(1.0)))  # which adds up the weights of a pair


def community_diag(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("members"))
    n = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.agg(F.count("*").alias("communities"), F.min("members").alias("fewest"), F.max("members").alias("most"), F.count_if(F.col("r_regionkey").isNull()).alias("without_parent"), F.sum("members").alias("assigned"))


def digest_stable(spark, d):
    return table(spark, d, "nation").select("n_nationkey", stable_id("nation", F.col("n_name"), F.col("n_regionkey")).alias("stable_id"), edge_id(F.lit("T"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("edge_id"))


QUERIES = {f.__name__: f for f in (edge_merge_counts, node_merge_last_wins, neighbors_topk, neighbors_directed, bfs_depth3, shortest_paths, var_length_paths, central_nodes, facet_counts, induced_subgraph, edge_sample_core, same_group_subgraph, list_nodes_filter, graph_validate, storage_diag, community_local_move, community_diag, digest_stable)}

_BFS = f"""
WITH {GRAPH}, near AS (SELECT * FROM incident),
l0 AS (SELECT 'region:0' AS id, 0 AS depth, 'region:0' AS path),
c1 AS (SELECT neighbor AS id, 1 AS depth, path || '>' || neighbor AS path, row_number() OVER (PARTITION BY neighbor ORDER BY center, edge_id, path) AS k FROM l0 JOIN near ON center = id),
l1 AS (SELECT id, depth, path FROM c1 WHERE k = 1 AND id NOT IN (SELECT id FROM l0)), s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
c2 AS (SELECT neighbor AS id, 2 AS depth, path || '>' || neighbor AS path, row_number() OVER (PARTITION BY neighbor ORDER BY center, edge_id, path) AS k FROM l1 JOIN near ON center = id),
l2 AS (SELECT id, depth, path FROM c2 WHERE k = 1 AND id NOT IN (SELECT id FROM s1)), s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
c3 AS (SELECT neighbor AS id, 3 AS depth, path || '>' || neighbor AS path, row_number() OVER (PARTITION BY neighbor ORDER BY center, edge_id, path) AS k FROM l2 JOIN near ON center = id),
l3 AS (SELECT id, depth, path FROM c3 WHERE k = 1 AND id NOT IN (SELECT id FROM s2)), s3 AS (SELECT * FROM s2 UNION ALL SELECT * FROM l3)
"""
_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(CENTRAL)) + f" ELSE {len(CENTRAL)} END"

ORACLE = {
    "edge_merge_counts": "SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS occurrence_count, arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_linenumber, l_shipdate)) AS first_day FROM lineitem GROUP BY ALL",
    "node_merge_last_wins": "SELECT user_id, arg_max(event_type, event_id) FILTER (event_type IS NOT NULL) AS event_type, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id",
    "neighbors_topk": f"WITH {GRAPH} SELECT * FROM (SELECT center, neighbor, direction, type, edge_id, row_number() OVER (PARTITION BY center ORDER BY {WEIGHT} DESC, neighbor, edge_id) AS rank FROM incident) WHERE rank <= 5",
    "neighbors_directed": f"WITH {GRAPH} SELECT src AS neighbor, type, edge_id FROM edges WHERE dst = 'nation:3' ORDER BY type, neighbor, edge_id LIMIT 50",
    "bfs_depth3": _BFS + "SELECT id, depth FROM s3",
    "shortest_paths": _BFS + "SELECT id, depth, path FROM s3",
    "var_length_paths": "WITH e AS (SELECT 'supplier:' || s_suppkey AS s, 'nation:' || s_nationkey AS d FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation) SELECT s AS start, d AS \"end\", 1 AS length, s || '>' || d AS path FROM e UNION ALL SELECT a.s, b.d, 2, a.s || '>' || a.d || '>' || b.d FROM e a JOIN e b ON a.d = b.s",
    "central_nodes": f"WITH {GRAPH}, deg AS (SELECT center, count(*) AS n FROM incident GROUP BY center) SELECT id, kind, coalesce(n, 0) AS degree FROM nodes LEFT JOIN deg ON id = center ORDER BY {_PRIORITY}, degree DESC, id LIMIT 200",
    "facet_counts": f"WITH {GRAPH} SELECT 'node' AS facet, kind AS value, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "induced_subgraph": f"WITH {GRAPH}, k AS (SELECT id FROM nodes WHERE kind IN ('Namespace', 'Database', 'ApiEndpoint')) SELECT type, src, dst, occurrence_count FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "same_group_subgraph": "SELECT doc_id, source, doc_id IN (1, 2, 3) AS center FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (1, 2, 3))",
    "list_nodes_filter": f"WITH {GRAPH} SELECT id, name FROM nodes WHERE kind = 'Type' AND contains(lower(name), 'a') ORDER BY lower(name), id LIMIT 200",
    "graph_validate": f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) - count(DISTINCT id) FROM nodes) AS repeated_nodes, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM edges)) AS types, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS dangling_edges",
    "storage_diag": f"WITH {GRAPH}, v AS (SELECT *, unnest([1, 2]) AS version FROM nodes), w AS (SELECT * FROM v WHERE version = 2 OR kind <> 'Method') SELECT count(DISTINCT version) AS versions, count(*) FILTER (version = 2) AS active, count(*) FILTER (version <> 2) AS inactive FROM w",
    "community_diag": "SELECT count(*) AS communities, min(members) AS fewest, max(members) AS most, count(*) FILTER (r_regionkey IS NULL) AS without_parent, sum(members)::BIGINT AS assigned FROM (SELECT s_nationkey, count(*) AS members FROM supplier GROUP BY s_nationkey) LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "digest_stable": "SELECT n_nationkey, 'nation:' || upper(left(sha256(n_name || chr(31) || n_regionkey), 32)) AS stable_id, sha256('T|' || n_name || '|' || n_regionkey) AS edge_id FROM nation",
}
