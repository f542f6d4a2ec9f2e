"""Retrieval, views, communities and symbols over the derived graph and the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, retrieval, text, views
from ..schema import BACKBONE
from ..storage import listing, materialize, scratch_dir
from .graph_queries import _PRIORITY, GRAPH, WEIGHT, _in, derive, table

_indexes: dict[tuple[str, str, str], text.TextIndex] = {}
QUESTION, ASKED = "方法 large widget", ["large widget", "Large-Widget", "part widget"]


def _node_index(spark, d):
    key = (spark.sparkContext.applicationId, d, listing(spark, d))
    if key not in _indexes:
        _indexes[key] = text.TextIndex(spark, f"{scratch_dir(spark)}/{key[0]}/node-index-{uuid.uuid4().hex}").build(derive(spark, d)[0], "id", F.col("name"))
    return _indexes[key]


def _found(spark, d, limit=12):
    """The planned search's nodes, written once for whatever reads them several times."""
    nodes, _ = derive(spark, d)
    return materialize(retrieval.search_plan(_node_index(spark, d), nodes, QUESTION, ASKED, limit), "found")


def search_plan(spark, d):
    """RT4: the nodes of a planned search."""
    return _found(spark, d)


def seed_union(spark, d):
    """RT5: a first search with one hit and a second one, for three queries."""
    hits = _found(spark, d, 40)
    return retrieval.seeds(hits.orderBy("id").limit(1), hits, 3).select("id", "kind", "score", "intent")


def local_search(spark, d):
    """GR6, GR9: what lies within three steps of the seeds, best first, within a budget of 80 nodes."""
    _, edges = derive(spark, d)
    return retrieval.local_search(edges, _found(spark, d)).select("id", "depth", F.round("score", 6).alias("score"))


def local_edges(spark, d):
    """GR6: the edges seen on the way, and whether the budget was used up."""
    _, edges = derive(spark, d)
    _, walked, truncated = graph.expansion(edges, _found(spark, d).select("id", "score"))
    return walked.withColumn("truncated", F.lit(truncated))


def backbone_chase(spark, d):
    """GR7: as local_search from the best seed, eight steps along edges of the heaviest class."""
    _, edges = derive(spark, d)
    return retrieval.chase_backbone(edges, _found(spark, d, 1)).select("id", "depth", F.round("score", 6).alias("score"))


def _hits(spark, d):
    return _node_index(spark, d).search(["widget", "large", "part"]).withColumn("score", F.round("score", 6))


def visual_search(spark, d):
    """FT9, FT10: hits of one kind that touch calls."""
    shown, more = retrieval.visual_search(_hits(spark, d), *derive(spark, d), 10, ["Type", "MenuItem"], ["CALLS"])
    return shown.select("id", "kind", "score").crossJoin(more)  # one row


def agent_search(spark, d):
    """FT11: exact names first."""
    return retrieval.agent_search(_hits(spark, d), derive(spark, d)[0], "large widget", 15).select("id", "boost", "score")


def community_search(spark, d):
    """FT2, FT8: summaries of one tier below one parent, by score."""
    c = table(spark, d, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "C0").otherwise("C1").alias("tier"), F.concat(F.lit("p"), (F.col("s_suppkey") % 2).cast("string")).alias("parent"), F.round(F.col("s_acctbal") / 1000, 3).alias("score"))
    return retrieval.community_search(c, "C1", "p1", 12)


def context_pack(spark, d):
    """BG7: the pack of a question: seeds, relationships among what lies around them, evidence."""
    nodes, edges = derive(spark, d)
    found = _found(spark, d, 4)
    within = materialize(retrieval.local_search(edges, found), "within")
    return retrieval.context_pack(QUESTION, found, nodes, edges, within, 4000, 500)


def visual_neighbors(spark, d):
    """GR4: two steps against the edges' direction."""
    nodes, edges = derive(spark, d)
    return graph.visual_neighbors(nodes, edges, ["nation:3", "region:1"], 2, 500, "in", types=["CONTAINS_PROJECT", "DEFINED_IN_PROJECT", "FOREIGN_KEY_TO"])





def visual_graph(spark, d):
    """GR11, GR13: a view of 60 nodes."""
    nodes, edges = derive(spark, d)
    shown, _ = graph.visual_graph(nodes, edges, 60, F.when(F.col("type") == "DEFINED_IN_PROJECT", 0).otherwise(1))
    return shown.select("id", "degree")


def node_details(spark, d):
    """GR20, GR29, GR30: a node with its degree, its edges, and the graph's size."""
    nodes, edges = derive(spark, d)
    return graph.one_hop(nodes, edges, "supplier:2").join(graph.node_by_id(nodes, edges, "supplier:2").select(F.col("id").alias("center"), "degree"), "center").crossJoin(graph.stats(nodes, edges)).select("center", "neighbor", "direction", "type", "degree", "nodes", "edges")  # one row


def edge_lookup(spark, d):
    """GR15, GR21: an edge by its ends and type, beside the highlighted ids around its source."""
    _, edges = derive(spark, d)
    e = graph.edge_between(edges, "nation:3", "region:3", "CONTAINS_PROJECT").select("edge_id").unionByName(graph.edge_between(edges, "region:3", "nation:3", "CONTAINS_PROJECT").select("edge_id"))
    return e.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")).unionByName(graph.highlight(edges, "region:3").select(F.lit("near").alias("what"), "id"))


def endpoint_completion(spark, d):
    """GR13: what is shown, filled up with missing ends."""
    nodes, edges = derive(spark, d)
    return graph.complete_endpoints(nodes.where("kind = 'Namespace'"), edges.where("type = 'DEFINED_IN_PROJECT'"), 60)


def view_merge(spark, d):
    """MG12: two overlapping views of customers."""
    c = table(spark, d, "customer")
    view = lambda m, name, flag: c.where(F.col("c_custkey") % m != 0).select(F.col("c_custkey").alias("id"), name.alias("name"), (F.col("c_custkey") * m % 11).alias("degree"), flag.alias("expanded"))
    return views.merge_views(view(3, F.col("c_name"), F.col("c_custkey") % 2 == 0), view(2, F.when(F.col("c_custkey") % 5 > 0, F.upper("c_name")), F.lit(None).cast("boolean")))


def hidden_kinds(spark, d):
    """GR15: the view without two kinds, as counts."""
    n, e = views.hide(*derive(spark, d), ["Method", "MenuItem"])
    return n.groupBy(F.lit("node").alias("part"), F.col("kind").alias("value")).count().unionByName(e.groupBy(F.lit("edge").alias("part"), F.col("type").alias("value")).count()).withColumnRenamed("count", "n")


def export_graph(spark, d):
    """SK27, SK28: nodes and edges of the small kinds as JSON texts."""
    n, e = derive(spark, d)
    few = n.where("kind in ('Database', 'Namespace')")
    return views.export_json(few, graph.induced(e, few))


def open_properties(spark, d):
    """SK3, PF8, PF9, PF10: open properties of events: storable ones, an alias, safe values, as a table."""
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("list"), F.concat(F.lit('["a","'), F.col("event_type"), F.lit('"]')), F.lit("deep"), F.lit('[{"x":1}]'), F.lit("object"), F.col("props"), F.lit("id"), F.lit("r"), F.lit("file_path"), F.when(F.col("event_id") % 3 == 0, F.lit('"p"')))
    e = table(spark, d, "events").select("event_id", m.alias("raw")).withColumn("kept", views.storable(F.col("raw"), ["id"]))
    t = views.property_table(e, "event_id", "event_id", "kept")
    return t.join(e.select("event_id", views.alias_value(F.col("kept"), "filePath", "file_path", "k").alias("alias"), views.safe_value(F.col("raw")["list"]).alias("safe"), views.safe_value(F.col("raw")["object"]).alias("whole")), "event_id")


def select_graph(spark, d):
    """GR16: an ad-hoc SELECT over the snapshot."""
    return views.select_graph(*derive(spark, d), "SELECT n.kind, e.type, count(*) AS n FROM graph_edges e JOIN graph_nodes n ON e.src = n.id GROUP BY n.kind, e.type ORDER BY n.kind, e.type;", 100)


def query_templates(spark, d):
    """GR17, GR19: the ready-made query of the highest degrees."""
    return views.TEMPLATES["high_degree"](*derive(spark, d), 30).select("id", "degree")


def community_reports(spark, d):
    """GR25, GR32: reports of communities that are nations with their suppliers and customers."""
    nodes, edges = derive(spark, d)
    m = edges.where("type = 'DEFINED_IN_PROJECT'").select(F.col("dst").alias("community"), F.col("src").alias("id"))
    return graph.community_reports(m, nodes, ["MenuItem"], ["ApiEndpoint"], 3)


def community_tiers(spark, d):
    """AG7: least, most and counted members by tier."""
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("members"))
    tier = F.when(F.col("members") > 2, "C0").otherwise("C1")
    return c.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.min("members").alias("least"), F.max("members").alias("most"), F.count_if(F.col("members") % 2 == 0).alias("even"))


def symbol_search(spark, d):
    """FT15, FT16: the identifiers of the documents, and one of them."""
    index = text.symbols(table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\ncall a.b.Widget and Widget")).alias("text")), "doc_id", F.col("text"))
    return index.where("identifier in ('Widget', 'The', 'b')").unionByName(text.search_symbols(index, "b.Widget", 0))


def traced_paths(spark, d):
    """GR8: the paths of two steps around a supplier, 60 of them."""
    _, edges = derive(spark, d)
    return graph.trace_paths(edges, "supplier:2", 2, 12, 60)


QUERIES = {f.__name__: f for f in (local_edges, traced_paths, search_plan, seed_union, local_search, backbone_chase, visual_search, agent_search, community_search, context_pack, visual_neighbors, visual_graph, node_details, edge_lookup, endpoint_completion, view_merge, hidden_kinds, export_graph, open_properties, select_graph, query_templates, community_reports, community_tiers, symbol_search)}

_TOK = r"'[\p{L}\p{N}_./:-]{2,}'"


def _bm25(terms: list[str], name: str = "hits") -> str:
    return f"""tk AS (SELECT id, kind, name, regexp_extract_all(lower(name), {_TOK}) AS w FROM nodes), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM tk),
po AS (SELECT id, len(w) AS len, unnest(w) AS term FROM tk), tf AS (SELECT id, len, term, count(*) AS tf FROM po WHERE term IN ({_in(terms)}) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
{name} AS (SELECT id, kind, name, round(sum(ln(1.0::DOUBLE + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN nodes USING (id), st GROUP BY id, kind, name)"""


def _boost(q: str, same: int, bare: int, part: int, least: int = 0) -> str:
    import re

    low, plain = q.strip().lower(), re.sub("[^a-z0-9]", "", q.lower())
    of = lambda c: f"CASE WHEN lower({c}) = '{low}' THEN {same} WHEN regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g') = '{plain}' THEN {bare} WHEN contains(lower({c}), '{low}') THEN {part} ELSE 0 END"
    return f"greatest({of('name')}, {of('id')})"


_PLAN = f"""WITH {GRAPH}, {_bm25(["large", "large-widget", "part", "widget"])},
exact AS (SELECT *, greatest({", ".join(_boost(q, 400, 300, 100) for q in ASKED)}) AS exact, CASE kind WHEN 'MenuItem' THEN 10 WHEN 'Method' THEN 8 ELSE 0 END AS intent FROM hits)"""


def _plan(limit: int, name: str) -> str:
    return f"{name} AS (SELECT id, kind, name, score, exact, intent FROM (SELECT * FROM exact ORDER BY score DESC, id LIMIT {min(100, max(20, 4 * limit))}) ORDER BY exact DESC, intent DESC, score DESC, id LIMIT {limit})"


def _expand_sql(seed: str, per_node: int, budget: int, types: str, depth: int) -> str:
    out = [f"n0 AS MATERIALIZED (SELECT id, 0 AS depth, score FROM {seed} ORDER BY score DESC, id LIMIT {budget}), x0 AS MATERIALIZED (SELECT * FROM n0)"]
    for k in range(1, depth + 1):
        out.append(f"""b{k} AS MATERIALIZED (SELECT * FROM (SELECT center, neighbor, edge_id, type, row_number() OVER (PARTITION BY center ORDER BY {WEIGHT} DESC, neighbor, edge_id) AS rank FROM incident WHERE center IN (SELECT id FROM n{k - 1}) {types}) WHERE rank <= {per_node} AND (SELECT count(*) FROM x{k - 1}) < {budget}),
w{k} AS (SELECT neighbor AS id, arg_min(score, (-score, center, rank)) AS score, min((-score, center, rank)) AS pos FROM b{k} JOIN n{k - 1} ON center = id WHERE neighbor NOT IN (SELECT id FROM x{k - 1}) GROUP BY neighbor),
n{k} AS MATERIALIZED (SELECT id, {k} AS depth, score * 0.85::DOUBLE AS score FROM w{k} ORDER BY pos, id LIMIT (SELECT {budget} - count(*) FROM x{k - 1})),
x{k} AS MATERIALIZED (SELECT * FROM x{k - 1} UNION ALL SELECT * FROM n{k})""")
    out.append(f"ex AS MATERIALIZED (SELECT * FROM x{depth}), walked AS (" + " UNION ".join(f"SELECT edge_id, type FROM b{k}" for k in range(1, depth + 1)) + ")")
    return ",\n".join(out)


_CORE = """ranked AS (SELECT src, dst, row_number() OVER (ORDER BY {priority}, edge_id) AS pos FROM edges ORDER BY pos LIMIT {sample}),
ends AS (SELECT unnest([src, dst]) AS id, pos FROM ranked), fr AS (SELECT id, min(pos) AS pos FROM ends GROUP BY id), steps AS (SELECT pos, sum(count(*)) OVER (ORDER BY pos) AS s FROM fr GROUP BY pos),
ov AS (SELECT min(pos) AS pos FROM steps WHERE s > {n}), tk0 AS (SELECT id FROM fr, ov WHERE ov.pos IS NULL OR fr.pos < ov.pos),
rest AS (SELECT DISTINCT e.id, e.pos FROM ends e, ov WHERE e.pos >= ov.pos AND e.id NOT IN (SELECT id FROM tk0) AND (SELECT count(*) FROM tk0) < {n}),
one AS (SELECT any_value(id) AS id, pos FROM rest GROUP BY pos HAVING count(*) = 1 ORDER BY pos LIMIT 1), core AS (SELECT id FROM tk0 UNION ALL SELECT id FROM one)"""
_SEED_LINE = "'- [' || kind || '] ' || name || ' (nodeId: ' || id || ', score: ' || round(score, 3)::DOUBLE || ')'"

ORACLE = {
    "search_plan": f"{_PLAN} SELECT id, kind, name, score, exact, intent FROM exact ORDER BY exact DESC, intent DESC, score DESC, id LIMIT 12",
    "seed_union": f"{_PLAN}, {_plan(40, 'p')} SELECT id, kind, score, intent FROM p ORDER BY intent DESC, score DESC, id LIMIT 12",
    "local_search": f"{_PLAN}, {_plan(12, 'p')}, {_expand_sql('p', 20, 80, '', 3)} SELECT id, depth, round(score, 6) AS score FROM ex",
    "local_edges": f"{_PLAN}, {_plan(12, 'p')}, {_expand_sql('p', 20, 80, '', 3)} SELECT edge_id, type, (SELECT count(*) FROM ex) >= 80 AS truncated FROM walked",
    "backbone_chase": f"{_PLAN}, {_plan(1, 'p')}, {_expand_sql('p', 8, 61, f'AND type IN ({_in(BACKBONE)})', 8)} SELECT id, depth, round(score, 6) AS score FROM ex",
    "visual_search": f"WITH {GRAPH}, {_bm25(['large', 'part', 'widget'])}, t AS (SELECT * FROM hits WHERE kind IN ('Type', 'MenuItem') ORDER BY score DESC, id LIMIT 30), k AS (SELECT * FROM t WHERE id IN (SELECT src FROM edges WHERE type = 'CALLS' UNION SELECT dst FROM edges WHERE type = 'CALLS')) SELECT id, kind, score, (SELECT count(*) > 10 FROM k) AS has_more FROM k ORDER BY score DESC, id LIMIT 10",
    "agent_search": f"WITH {GRAPH}, {_bm25(['large', 'part', 'widget'])}, t AS (SELECT * FROM hits ORDER BY score DESC, id LIMIT 60) SELECT id, {_boost('large widget', 1000, 900, 500)} AS boost, score FROM t ORDER BY boost DESC, score DESC, id LIMIT 15",
    "community_search": "SELECT 'c' || s_suppkey AS id, 'C1' AS tier, 'p1' AS parent, round(s_acctbal / 1000, 3) AS score FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 1 ORDER BY score DESC, id LIMIT 12",
    "context_pack": f"""{_PLAN}, {_plan(4, 'p')}, {_expand_sql('p', 20, 80, '', 3)},
top0 AS (SELECT 0 AS place, '{QUESTION}' AS line UNION ALL SELECT row_number() OVER (ORDER BY score DESC, id), {_SEED_LINE} FROM p),
bud AS (SELECT greatest(0, 3500 - sum(length(line) + 1))::BIGINT AS r, trunc(greatest(0, 3500 - sum(length(line) + 1)) * 0.35::DOUBLE)::BIGINT AS e FROM top0),
am AS (SELECT e.type, e.edge_id, e.occurrence_count, -({WEIGHT}) AS w, '- [' || a.kind || '] ' || a.name || ' (nodeId: ' || a.id || ') -(' || e.type || ')-> [' || b.kind || '] ' || b.name || ' (nodeId: ' || b.id || ')' AS line FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.id IN (SELECT id FROM ex) AND b.id IN (SELECT id FROM ex)),
ln AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY w, edge_id ROWS UNBOUNDED PRECEDING) AS used FROM am),
ev0 AS (SELECT '- ' || type || '；extractor；x' || occurrence_count AS line, arg_min(type, edge_id) AS type, min(edge_id) AS edge_id FROM am GROUP BY 1),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY edge_id) AS turn, min(edge_id) OVER (PARTITION BY type) AS fs FROM ev0),
ev2 AS (SELECT * FROM ev1 ORDER BY turn, fs LIMIT 40), ev3 AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY turn, type ROWS UNBOUNDED PRECEDING) AS used FROM ev2)
SELECT 0 AS part, place, line FROM top0 UNION ALL SELECT 1, row_number() OVER (ORDER BY w, edge_id), line FROM ln, bud WHERE used <= r - e UNION ALL SELECT 2, row_number() OVER (ORDER BY turn, type), line FROM ev3, bud WHERE used <= e""",
    "visual_neighbors": f"WITH {GRAPH}, n AS (SELECT * FROM incident WHERE direction = 'incoming' AND type IN ('CONTAINS_PROJECT', 'DEFINED_IN_PROJECT', 'FOREIGN_KEY_TO')), l0 AS (SELECT unnest(['nation:3', 'region:1']) AS id), l1 AS (SELECT DISTINCT neighbor AS id FROM n WHERE center IN (SELECT id FROM l0) AND neighbor NOT IN (SELECT id FROM l0)), l2 AS (SELECT DISTINCT neighbor AS id FROM n WHERE center IN (SELECT id FROM l1) AND neighbor NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1)) SELECT * FROM (SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) ORDER BY depth, id LIMIT 500",
    "visual_graph": f"WITH {GRAPH}, {_CORE.format(priority=chr(67) + 'ASE WHEN type = ' + repr('DEFINED_IN_PROJECT') + ' THEN 0 ELSE 1 END', sample=240, n=60)}, deg AS (SELECT center, count(*) AS n FROM incident GROUP BY center) SELECT id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN deg ON id = center ORDER BY CASE WHEN id IN (SELECT id FROM core) THEN 0 ELSE 1 END, degree DESC, id LIMIT 60",
    "node_details": f"WITH {GRAPH} SELECT center, neighbor, direction, type, (SELECT count(*) FROM incident WHERE center = 'supplier:2') AS degree, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges FROM incident WHERE center = 'supplier:2'",
    "edge_lookup": f"WITH {GRAPH} SELECT 'edge' AS what, edge_id AS id FROM edges WHERE type = 'CONTAINS_PROJECT' AND src = 'region:3' AND dst = 'nation:3' UNION ALL SELECT 'near', id FROM (SELECT neighbor AS id FROM incident WHERE center = 'region:3' UNION SELECT 'region:3')",
    "endpoint_completion": f"WITH {GRAPH}, n AS (SELECT id, 0 AS o FROM nodes WHERE kind = 'Namespace'), m AS (SELECT DISTINCT unnest([src, dst]) AS id, 1 AS o FROM edges WHERE type = 'DEFINED_IN_PROJECT') SELECT id FROM (SELECT * FROM n UNION ALL SELECT * FROM m WHERE id NOT IN (SELECT id FROM n)) ORDER BY o, id LIMIT 60",
    "view_merge": "WITH b AS (SELECT c_custkey AS id, c_name AS name, c_custkey * 3 % 11 AS degree, c_custkey % 2 = 0 AS x FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN upper(c_name) END AS name, c_custkey * 2 % 11 AS degree FROM customer WHERE c_custkey % 2 <> 0) SELECT coalesce(b.id, i.id) AS id, coalesce(i.name, b.name) AS name, greatest(b.degree, i.degree) AS degree, coalesce(b.x, false) AS expanded FROM b FULL JOIN i ON b.id = i.id",
    "hidden_kinds": f"WITH {GRAPH}, k AS (SELECT * FROM nodes WHERE kind NOT IN ('Method', 'MenuItem')) SELECT 'node' AS part, kind AS value, count(*) AS n FROM k GROUP BY kind UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY type",
    "export_graph": f"""WITH {GRAPH}, k AS (SELECT * FROM nodes WHERE kind IN ('Database', 'Namespace')) SELECT 'node' AS part, '{{"id":"' || id || '","kind":"' || kind || '","name":"' || name || '"}}' AS json FROM k UNION ALL SELECT 'edge', '{{"src":"' || src || '","dst":"' || dst || '","type":"' || type || '","edge_id":"' || edge_id || '"}}' FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""",
    "open_properties": """SELECT event_id, json_extract_string(props, '$.k') AS k, '["a","' || event_type || '"]' AS list, CASE WHEN event_id % 3 = 0 THEN '"p"' END AS file_path, CASE WHEN event_id % 3 = 0 THEN '"p"' ELSE json_extract_string(props, '$.k') END AS alias, 'a, ' || event_type AS safe, props AS whole FROM events""",
    "select_graph": f"WITH {GRAPH} SELECT n.kind, e.type, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.id GROUP BY n.kind, e.type",
    "query_templates": f"WITH {GRAPH}, deg AS (SELECT center, count(*) AS n FROM incident GROUP BY center) SELECT id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN deg ON id = center ORDER BY {_PRIORITY}, degree DESC, id LIMIT 30",
    "community_reports": f"""WITH {GRAPH}, m AS (SELECT e.dst AS community, n.id, n.kind, n.name FROM edges e JOIN nodes n ON e.src = n.id WHERE e.type = 'DEFINED_IN_PROJECT'),
k AS (SELECT community, kind, count(*) AS c FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY name, id) AS p FROM m)
SELECT community, 'community:' || left(sha256(string_agg(id, chr(10) ORDER BY id)), 24) AS community_id, count(*) AS members, (SELECT string_agg(kind || ':' || c, ',' ORDER BY c DESC, kind) FROM k WHERE k.community = m.community) AS kinds, arg_min(name, id) AS title,
coalesce((SELECT string_agg(name, ',' ORDER BY p) FROM r WHERE r.community = m.community AND kind = 'ApiEndpoint' AND p <= 3), '') AS tables, coalesce((SELECT string_agg(name, ',' ORDER BY p) FROM r WHERE r.community = m.community AND kind = 'MenuItem' AND p <= 3), '') AS entries FROM m GROUP BY community""",
    "community_tiers": "WITH c AS (SELECT count(*) AS members FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT CASE WHEN members > 2 THEN 'C0' ELSE 'C1' END AS tier, count(*) AS n, min(members) AS least, max(members) AS most, count(*) FILTER (members % 2 = 0) AS even FROM c GROUP BY 1",
    "symbol_search": r"""WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || 'call a.b.Widget and Widget', chr(10))) AS row, generate_subscripts(string_split(text || chr(10) || 'call a.b.Widget and Widget', chr(10)), 1) AS line FROM documents),
w AS (SELECT doc_id, line, row, unnest(list_distinct(regexp_extract_all(row, '[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*'))) AS whole FROM l),
s AS (SELECT regexp_extract(whole, '([^.]+)$', 1) AS identifier, doc_id, line, instr(row, whole) AS "column", regexp_extract(whole, '^(.*)\.[^.]+$', 1) AS container FROM w)
SELECT * FROM s WHERE identifier IN ('Widget', 'The', 'b') UNION ALL SELECT * FROM s WHERE identifier = 'Widget' AND (container = 'b' OR ends_with(container, '.b'))""",
}
_STEP = "' -[' || type || ' ' || direction || ']-> ' || neighbor"
ORACLE["traced_paths"] = f"""WITH {GRAPH}, n1 AS (SELECT *, row_number() OVER (ORDER BY {WEIGHT} DESC, neighbor, edge_id) AS rank FROM incident WHERE center = 'supplier:2'),
f1 AS (SELECT neighbor AS id, min((rank, 'supplier:2' || {_STEP})) AS m FROM n1 WHERE rank <= 12 AND neighbor <> 'supplier:2' GROUP BY neighbor), l1 AS (SELECT id, 1 AS depth, (row_number() OVER (ORDER BY m, id))::INTEGER AS place, m[2] AS path FROM f1),
n2 AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY {WEIGHT} DESC, neighbor, edge_id) AS rank FROM incident WHERE center IN (SELECT id FROM l1)),
f2 AS (SELECT neighbor AS id, min((place, rank, path || {_STEP})) AS m FROM n2 JOIN l1 ON center = l1.id WHERE rank <= 12 AND neighbor <> 'supplier:2' AND neighbor NOT IN (SELECT id FROM l1) GROUP BY neighbor),
l2 AS (SELECT id, 2 AS depth, (row_number() OVER (ORDER BY m, id))::INTEGER AS place, m[3] AS path FROM f2 ORDER BY m, id LIMIT (SELECT 60 - count(*) FROM l1)) SELECT * FROM l1 UNION ALL SELECT * FROM l2"""
#: SQL for the greedy core of graph_queries.edge_sample_core, by the same reasoning as the operator's.
ORACLE["edge_sample_core"] = f"WITH {GRAPH}, {_CORE.format(priority='CASE type WHEN ' + repr('CONTAINS_PROJECT') + ' THEN 0 WHEN ' + repr('DEFINED_IN_PROJECT') + ' THEN 1 ELSE 2 END', sample=20000, n=100)} SELECT id FROM core"
ORACLE["edge_endpoints"] = f"WITH {GRAPH} SELECT e.type, a.kind AS src_kind, b.kind AS dst_kind, count(*) AS n FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id GROUP BY ALL"
