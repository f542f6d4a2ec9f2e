"""Clauses executed over positional, fielded indexes, and the open properties of stored nodes and edges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import search
from ..operators import fielded, graph, views
from ..storage import listing, property_of, scratch_dir
from .graph_queries import GRAPH, _in, stored, table

QUESTIONS = ["large widget", "Brand#12 economy", "small ring of Brand#3", "customers building", "world.nation suppliers/1"]
WEIGHTS = {"name": 2.0, "objectName": 1.5}
CENTERS = ["part:1", "part:2", "region:0"]
_indexes: dict[tuple[str, str, str, str], fielded.FieldedIndex] = {}


def _index(spark, d, what):
    """The application's index of the documents (text and source) or of the graph's nodes, built by its first query."""
    key = (spark.sparkContext.applicationId, d, what, listing(spark, d))
    if key not in _indexes:
        index = fielded.FieldedIndex(spark, f"{scratch_dir(spark)}/{key[0]}/{what}-{uuid.uuid4().hex}")
        if what == "documents":
            index.build(table(spark, d, "documents"), "doc_id", {"text": F.col("text"), "source": F.col("source")})
        else:
            nodes, _ = stored(spark, d).snapshot("star", 1, properties=True)
            index.build(nodes, "id", {"name": F.col("name")} | {f: property_of(f) for f in fielded.NODE_FIELDS[1:]})
        _indexes[key] = index
    return _indexes[key]


def _scored(hits, name):
    return hits.select(F.col("query").alias(name), F.col("id"), F.round("score", 5).alias("score"))


def phrase_search(spark, d):
    """FT3, FT5: the documents in which the first two terms of a benchmark item stand side by side."""
    terms = F.slice(fielded.tokens(F.col("text")), 1, 2)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.lit(0).alias("clause"), F.lit(fielded.PHRASE).alias("kind"), terms.alias("terms"))
    return _scored(_index(spark, d, "documents").search(asked), "item_id").withColumnRenamed("id", "doc_id")


def _prefixes(spark, d):
    terms = F.transform(F.slice(fielded.tokens(F.col("text")), 1, 2), lambda t: F.left(t, F.lit(4)))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.posexplode(terms).alias("clause", "p"))
    return asked.select("query", "clause", F.lit(fielded.PREFIX).alias("kind"), F.array("p").alias("terms"))


def prefix_search(spark, d):
    """FT3, FT5: the documents with a term that begins with the first four characters of a benchmark item's first or second term."""
    return _scored(_index(spark, d, "documents").search(_prefixes(spark, d)), "item_id").withColumnRenamed("id", "doc_id")


def fielded_search(spark, d):
    """FT1, FT3, FT5, FT7: questions as clauses over the ten fields of nodes, names weighing most."""
    asked = fielded.clauses(spark.createDataFrame(list(enumerate(QUESTIONS)), "q int, text string"), "q", F.col("text"))
    return _scored(_index(spark, d, "nodes").search(asked, WEIGHTS), "q")


def node_properties(spark, d):
    """SK1, SK3, PF8, PF10: the stored properties of types and menu items as a table, with their envelope."""
    nodes, _ = stored(spark, d).snapshot("star", 1, properties=True)
    rows = nodes.where("kind in ('Type', 'MenuItem')").select("id", "project_id", "graph_version", F.col("properties").cast("map<string,string>").alias("p"))
    return rows.select("id", "project_id", "graph_version").join(views.property_table(rows, "id", "id", "p"), "id")


def edge_evidence(spark, d):
    """SK2, GR8, BG4: what each call and key rests on, from the stored properties of the edges."""
    _, edges = stored(spark, d).snapshot("star", 1, properties=True)
    line = search.evidence_line(F.col("type"), property_of("location"), property_of("line", "int"), property_of("reference"))
    return edges.where("type in ('CALLS', 'FOREIGN_KEY_TO', 'READS')").select("edge_id", line.alias("evidence"))


def _same_file(spark, d):
    nodes, edges = stored(spark, d).snapshot("star", 1, properties=True)
    return graph.same_file(nodes.select("id", "kind", "name", property_of("filePath").alias("path")), edges, CENTERS, 60)


def same_file_nodes(spark, d):
    """GR4, GR5: the nodes in the files of three centers, one of which has no file."""
    return _same_file(spark, d)[0].select("id", "path", "degree", "center")


def same_file_edges(spark, d):
    """GR5: the edges among them, beside the view's counts."""
    _, edges, counts = _same_file(spark, d)
    return counts.join(edges.select("edge_id"), how="left", on=F.lit(True))  # one row


def incremental_search(spark, d):
    """SK16, FT13, FT18: prefix_search's clauses over an index that was built from an earlier state of the documents and then brought up to date.

    Earlier, each third document was not there, each fourth had another text, and some were there that have gone.
    """
    docs, k = table(spark, d, "documents").select("doc_id", "text", "source"), F.col("doc_id")
    gone = docs.where(k % 5 == 0).withColumn("doc_id", -1 - k)
    before = docs.where(k % 3 != 0).withColumn("text", F.when(k % 4 == 0, F.upper("source")).otherwise(F.col("text"))).unionByName(gone)
    fields = {"text": F.col("text"), "source": F.col("source")}
    index = fielded.IncrementalIndex(spark, f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/incremental-{uuid.uuid4().hex}")
    index.build(before, "doc_id", fields).update(docs, "doc_id", fields)
    return _scored(index.search(_prefixes(spark, d)), "item_id").withColumnRenamed("id", "doc_id")


_SELECT = "SELECT e.edge_id AS relation, e.src AS `from`, n.name FROM graph_edges e JOIN graph_nodes n ON n.id = e.src WHERE e.type = 'CONTAINS_PROJECT' ORDER BY e.edge_id"


def selected_subgraph(spark, d):
    """GR16: the nodes and edges that an ad-hoc query names: edges from regions, whose other ends are added while there is room."""
    nodes, edges = stored(spark, d).snapshot("star", 1)
    shown, links = views.selected_subgraph(views.select_graph(nodes, edges, _SELECT, 5000), nodes, edges, 15)
    return shown.select(F.lit("node").alias("part"), "id").unionByName(links.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id")))


def faceted_view(spark, d):
    """PF5, PF6: the view of two node categories and one edge type."""
    shown, links = views.faceted(*stored(spark, d).snapshot("star", 1), [("node-category", ["namespace", "ApiEndpoint"]), ("Edge-Type", ["defined_in_project"])])
    return shown.select(F.lit("node").alias("part"), "id").unionByName(links.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id")))


QUERIES = {f.__name__: f for f in (phrase_search, prefix_search, fielded_search, node_properties, edge_evidence, same_file_nodes, same_file_edges, selected_subgraph, faceted_view, incremental_search)}

_TOK = r"'[\p{L}\p{N}_./:-]{2,}'"
_MET = """lens AS (SELECT id, field, w, len(w) AS len FROM f WHERE len(w) > 0),
stats AS (SELECT field, count(*)::DOUBLE AS n, avg(len) AS mean FROM lens GROUP BY field),
met AS (
  SELECT query, clause, kind, id, field, len,
    CASE WHEN kind = 'prefix' THEN (len(list_filter(w, lambda x: starts_with(x, terms[1]))) > 0)::INT
         WHEN len(terms) = 1 THEN len(list_filter(w, lambda x: x = terms[1]))
         WHEN list_has_all(w, terms) THEN len(list_filter(range(1, len(w) - len(terms) + 2), lambda i: w[i:i + len(terms) - 1] = terms)) ELSE 0 END AS tf
  FROM asked, lens
), hit AS (SELECT *, count(*) OVER (PARTITION BY query, clause, field) AS df FROM met WHERE tf > 0)"""
_SCORE = "round(sum({w} * CASE WHEN kind = 'prefix' THEN 1.0 ELSE ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) END), 5)"
_DOCS = f"f AS (SELECT doc_id AS id, unnest(['text', 'source']) AS field, unnest([regexp_extract_all(lower(text), {_TOK}), regexp_extract_all(lower(source), {_TOK})]) AS w FROM documents)"
_PROPS = f"""{GRAPH}, props AS (
  SELECT 'part:' || p_partkey AS id, 'src/' || p_brand || '.cs' AS path FROM part UNION ALL SELECT 'order:' || o_orderkey, 'src/' || o_orderpriority || '.cs' FROM orders
), files AS (SELECT DISTINCT path FROM props WHERE id IN ({_in(CENTERS)})),
deg AS (SELECT center, count(*) AS n FROM incident GROUP BY center),
wanted AS (SELECT n.id, p.path, coalesce(g.n, 0) AS degree, n.id IN ({_in(CENTERS)}) AS center FROM nodes n LEFT JOIN props p USING (id) LEFT JOIN deg g ON g.center = n.id WHERE n.id IN ({_in(CENTERS)}) OR p.path IN (SELECT path FROM files)),
shown AS (SELECT * FROM wanted ORDER BY center DESC, degree DESC, id LIMIT 60),
among AS (SELECT edge_id FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) ORDER BY edge_id LIMIT 240)"""
_ASKED = "UNION ALL ".join(
    f"SELECT {q} AS query, {c} AS clause, '{kind}' AS kind, [{', '.join(repr(t) for t in terms)}] AS terms "
    for q, text in enumerate([["large", "widget"], ["brand", "12", "economy"], ["small", "ring", "of", "brand"], ["customers", "building"], ["world.nation", "suppliers/1"]])
    for c, (kind, terms) in enumerate([("phrase", text), *[x for t in text for x in (("phrase", [t]), ("prefix", [t]))]])
)

ORACLE = {
    "phrase_search": f"WITH {_DOCS}, asked AS (SELECT item_id AS query, 0 AS clause, 'phrase' AS kind, regexp_extract_all(lower(text), {_TOK})[1:2] AS terms FROM benchmark), {_MET} SELECT query AS item_id, id AS doc_id, {_SCORE.format(w='1.0')} AS score FROM hit JOIN stats USING (field) GROUP BY query, id",
    "prefix_search": f"WITH {_DOCS}, asked AS (SELECT item_id AS query, c AS clause, 'prefix' AS kind, [left(w[c + 1], 4)] AS terms FROM (SELECT item_id, regexp_extract_all(lower(text), {_TOK}) AS w FROM benchmark), range(2) t(c) WHERE len(w) > c), {_MET} SELECT query AS item_id, id AS doc_id, {_SCORE.format(w='1.0')} AS score FROM hit JOIN stats USING (field) GROUP BY query, id",
    "fielded_search": f"""WITH {GRAPH}, g AS (
  SELECT id, 'name' AS field, name AS t FROM nodes UNION ALL SELECT 'nation:' || n_nationkey, 'qualifiedName', 'world.' || lower(n_name) FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'route', '/customers/' || c_custkey FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'description', lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'route', '/api/suppliers/' || s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'objectName', p_brand FROM part UNION ALL SELECT 'part:' || p_partkey, 'signature', lower(p_type) || ' ' || p_name FROM part
), f AS (SELECT id, field, regexp_extract_all(lower(t), {_TOK}) AS w FROM g), asked AS ({_ASKED}), {_MET}
SELECT query::INT AS q, id, {_SCORE.format(w="CASE field WHEN 'name' THEN 2.0 WHEN 'objectName' THEN 1.5 ELSE 1.0 END")} AS score FROM hit JOIN stats USING (field) GROUP BY query, id""",
    "node_properties": """SELECT 'part:' || p_partkey AS id, 'star' AS project_id, 1::BIGINT AS graph_version, NULL AS description, NULL AS route, 'src/' || p_brand || '.cs' AS "filePath", p_brand AS "objectName", lower(p_type) || ' ' || p_name AS signature, p_size::VARCHAR AS "startLine" FROM part
UNION ALL SELECT 'customer:' || c_custkey, 'star', 1, lower(c_mktsegment), '/customers/' || c_custkey, NULL, NULL, NULL, NULL FROM customer""",
    "edge_evidence": f"""WITH {GRAPH}, c AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, min(l_linenumber) AS line, 'src/' || (l_orderkey % 100) || '.cs' AS location FROM lineitem GROUP BY l_orderkey, l_partkey)
SELECT edge_id, type || '；' || location || CASE WHEN line > 0 THEN ':' || line ELSE '' END AS evidence FROM edges JOIN c USING (src, dst) WHERE type = 'CALLS'
UNION ALL SELECT edge_id, 'FOREIGN_KEY_TO；extractor；' || o_orderstatus FROM edges JOIN orders ON src = 'order:' || o_orderkey WHERE type = 'FOREIGN_KEY_TO' UNION ALL SELECT edge_id, NULL FROM edges WHERE type = 'READS'""",
    "same_file_nodes": f"WITH {_PROPS} SELECT id, path, degree, center FROM shown",
    "same_file_edges": f"WITH {_PROPS} SELECT (SELECT count(*) FROM nodes) AS total, (SELECT count(*) FROM shown) AS nodes, (SELECT count(*) FROM among) AS edges, (SELECT count(*) FROM wanted) > (SELECT count(*) FROM shown) AS truncated, edge_id FROM (SELECT 1) LEFT JOIN among ON true",
    "selected_subgraph": f"""WITH {GRAPH}, links AS (SELECT * FROM edges WHERE type = 'CONTAINS_PROJECT'), named AS (SELECT DISTINCT src AS id FROM links),
ends AS (SELECT id, min(edge_id) AS first FROM (SELECT src AS id, edge_id FROM links UNION ALL SELECT dst, edge_id FROM links) GROUP BY id),
shown AS (SELECT id FROM ends ORDER BY id IN (SELECT id FROM named) DESC, first, id LIMIT 15)
SELECT 'node' AS part, id FROM shown UNION ALL SELECT 'edge', edge_id FROM links WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)""",
    "faceted_view": f"""WITH {GRAPH}, shown AS (SELECT id FROM nodes WHERE kind IN ('Namespace', 'ApiEndpoint'))
SELECT 'node' AS part, id FROM shown UNION ALL SELECT 'edge', edge_id FROM edges WHERE type = 'DEFINED_IN_PROJECT' AND src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)""",
}
ORACLE["incremental_search"] = ORACLE["prefix_search"]
