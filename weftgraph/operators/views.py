"""Forms that clients of the graph ask for: merged views, aliases, open properties as tables, validated filters, ad-hoc SELECTs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_TYPES, NODE_KINDS
from ..storage import materialize
from .graph import central_nodes, edge_between, one_hop, trails


def clamp(n: int, low: int, high: int) -> int:
    return min(high, max(low, n))


def canonical(wanted: list[str], vocabulary: list[str]) -> list[str]:
    """The vocabulary's spelling of each name, whatever its case, each once; an unknown name is an error."""
    by_name = {v.lower(): v for v in vocabulary}
    unknown = [w for w in wanted if w.strip().lower() not in by_name]
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return list(dict.fromkeys(by_name[w.strip().lower()] for w in wanted))


# fixed values: the viewer's facets, by what their tokens name
FACETS = {"node-category": NODE_KINDS, "edge-type": EDGE_TYPES}


def facet_filters(filters: list[tuple[str, list[str] | None]]) -> tuple[list[str], list[str]]:
    """(kinds, types) that (facet, tokens) filters ask for, whatever their case; a blank facet or one without tokens counts for nothing, an unknown facet or token is an error."""
    wanted: dict[str, list[str]] = {f: [] for f in FACETS}
    for facet, tokens in filters:
        if facet and facet.strip() and tokens is not None:
            wanted[canonical([facet], list(FACETS))[0]] += [t for t in tokens if t and t.strip()]
    return canonical(wanted["node-category"], NODE_KINDS), canonical(wanted["edge-type"], EDGE_TYPES)


def faceted(nodes: DataFrame, edges: DataFrame, filters: list[tuple[str, list[str] | None]]) -> tuple[DataFrame, DataFrame]:
    """The view of some kinds and types: all kinds or types where no filter names any; edges that lose an end go."""
    kinds, types = facet_filters(filters)
    shown = nodes.where(F.col("kind").isin(kinds)) if kinds else nodes
    ids = shown.select("id")
    links = edges.where(F.col("type").isin(types)) if types else edges
    return shown, links.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def merge_views(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, name, degree, expanded) of both views: the incoming name where there is one, the larger degree, either's flag."""
    b, i = base.select("id", *[F.col(c).alias(f"b_{c}") for c in ("name", "degree", "expanded")]), incoming.select("id", *[F.col(c).alias(f"i_{c}") for c in ("name", "degree", "expanded")])
    return b.join(i, "id", "full").select("id", F.coalesce("i_name", "b_name").alias("name"), F.greatest("b_degree", "i_degree").alias("degree"), (F.coalesce("b_expanded", F.lit(False)) | F.coalesce("i_expanded", F.lit(False))).alias("expanded"))


def hide(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The view without nodes of these kinds and without edges that lose an end."""
    left = nodes.where(~F.col("kind").isin(kinds))
    ids = left.select("id")
    return left, edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def alias_value(props: Column, *names: str) -> Column:
    """The first of a map's values under these names that isn't blank."""
    return F.coalesce(*[F.when(F.trim(F.try_element_at(props, F.lit(n))) != "", F.try_element_at(props, F.lit(n))) for n in names])


def safe_value(value: Column) -> Column:
    """JSON text as a table shows it: scalars plain, arrays of scalars joined by commas, anything else as its JSON."""
    items = F.from_json(value, "array<string>")
    scalar = ~value.rlike(r"^\s*[\[{]")
    flat = value.rlike(r"^\s*\[") & ~value.rlike(r"^\s*\[.*[\[{]")
    return F.when(scalar, F.regexp_replace(F.trim(value), r'^"|"$', "")).when(flat, F.array_join(items, ", ")).otherwise(value)


def property_columns(rows: DataFrame, order: str, props: str, most: int = 24) -> list[str]:
    """The keys of an open map column in the order in which they first appear, `most` of them."""
    keys = rows.select(order, F.posexplode(F.map_keys(props)).alias("n", "key")).groupBy("key").agg(F.min(F.struct(order, "n")).alias("at"))
    return [r["key"] for r in keys.orderBy("at", "key").limit(most).collect()]


def property_table(rows: DataFrame, id_col: str, order: str, props: str, most: int = 24) -> DataFrame:
    """A column for each of the first keys of an open map."""
    return rows.select(id_col, *[F.try_element_at(props, F.lit(k)).alias(k) for k in property_columns(rows, order, props, most)])


def storable(props: Column, reserved: list[str]) -> Column:
    """A map of JSON texts without reserved names, nulls, nested arrays and objects."""
    return F.map_filter(props, lambda k, v: ~k.isin(reserved) & v.isNotNull() & (v != "null") & ~v.rlike(r"^\s*\{") & ~v.rlike(r"^\s*\[.*[\[{]"))


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a JSON text for each node and edge, ends as ids."""
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "kind", "name")).alias("json")).unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("src", "dst", "type", "edge_id")).alias("json")))


def look_ahead(rows: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, bool]:
    """(the first rows, whether there are more), from limit + 1 of them."""
    top = rows.orderBy(*order).limit(limit + 1)
    return top.limit(limit), top.count() > limit


# fixed values: the parser's names of what only reads
_READS = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedHint", "UnresolvedHaving", "Union", "UnionLoop", "Except", "Intersect", "OneRowRelation", "UnresolvedInlineTable", "WithWindowDefinition", "Window", "Generate", "Pivot", "Unpivot", "Sample",
    "UnresolvedOrdinal", "LocalRelation",
}
# fixed values: functions that run code by name or tell what lies outside the views
_REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "raise_error", "assert_true"}


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _check_plan(plan, allowed: set[str]) -> None:
    """Raise unless a parsed plan, with all plans inside it, only reads relations of these names."""
    kind = plan.getClass().getSimpleName()
    if kind not in _READS:
        raise ValueError(f"only a SELECT is allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = _seq(plan.multipartIdentifier())
        if len(name) != 1 or name[0].lower() not in allowed:
            raise ValueError(f"no such relation: {'.'.join(name)}")
    if kind == "UnresolvedWith":
        for named in _seq(plan.cteRelations()):
            # a name holds for the tables after it and for the query; in a recursive one for itself too
            if plan.allowRecursion():
                allowed = allowed | {named._1().lower()}
            _check_plan(named._2(), allowed)
            allowed = allowed | {named._1().lower()}
    left = _seq(plan.expressions())
    while left:
        e = left.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction" and _seq(e.nameParts())[-1].lower() in _REFUSED:
            raise ValueError(f"no such function: {_seq(e.nameParts())[-1]}")
        left += _seq(e.children())
    for inner in [*_seq(plan.children()), *_seq(plan.subqueries())]:
        _check_plan(inner, allowed)


def select_graph(nodes: DataFrame, edges: DataFrame, query: str, limit: int) -> DataFrame:
    """An ad-hoc SELECT over graph_nodes and graph_edges, which hold one version alone; at most `limit` rows (1 to 5000).

    What Spark's parser makes of it is walked before anything is planned or run: every part must be one that only reads,
    and every relation one of the two or a table that the query itself defines, so that no command, file, catalog table or
    table function passes, whatever its columns are called.
    """
    spark, bare = nodes.sparkSession, query.strip().rstrip(";").strip()
    if not bare:
        raise ValueError("only a SELECT is allowed")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)
    except Exception as e:
        raise ValueError(f"no SELECT can be read: {str(e).splitlines()[0]}") from None
    _check_plan(parsed, {"graph_nodes", "graph_edges"})
    nodes.createOrReplaceTempView("graph_nodes")
    edges.createOrReplaceTempView("graph_edges")
    return spark.sql(bare).limit(clamp(limit, 1, 5000))


def selected_subgraph(rows: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that an ad-hoc query's rows name in any of their text columns, by node or edge id.

    At most `limit` nodes: of more, the ends of the edges by edge id first, then by id. Ends that are missing
    are added in that order while there is room; edges that lack one go, and 4 limit (20,000 at most) by id stay.
    """
    texts = [F.col(f"`{c}`") for c, kind in rows.dtypes if kind == "string"]
    if not texts:
        return nodes.limit(0), edges.limit(0)
    named = materialize(rows.select(F.explode(F.array(*texts)).alias("id")).where("id is not null").distinct(), "named")
    own, links = nodes.join(named, "id", "left_semi").select("id"), edges.join(named.withColumnRenamed("id", "edge_id"), "edge_id", "left_semi")
    # a node's place: as an end of the first edge that has it, or after all edges; those that rows name before those that don't
    ends = links.select("edge_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.min("edge_id").alias("first"))
    placed = own.withColumn("named", F.lit(True)).join(ends, "id", "full").select("id", F.coalesce("named", F.lit(False)).alias("named"), "first")
    kept = placed.orderBy(F.desc("named"), F.col("first").isNull(), "first", "id").limit(limit).select("id")
    shown = materialize(nodes.join(kept, "id", "left_semi"), "subgraph")
    ids = shown.select("id")
    whole = links.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return shown, whole.orderBy("edge_id").limit(min(4 * limit, 20000))


#: The four ready-made queries, by name.
TEMPLATES = {
    "paths": lambda nodes, edges, limit: trails(edges, 4).orderBy("length", "path").limit(limit),
    "high_degree": lambda nodes, edges, limit: central_nodes(nodes, edges, limit),
    "one_hop": lambda nodes, edges, node: one_hop(nodes, edges, node),
    "edge": lambda nodes, edges, src, dst, type_: edge_between(edges, src, dst, type_),
}
