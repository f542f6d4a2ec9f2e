"""Catalog queries: suppliers stand for database objects, parts for columns, customers for parameters, nations for keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from .graph_queries import table


def _objects(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    num = lambda m: (k * m % 10 + 1).cast("string")
    text = F.concat(F.lit("CREATE x AS /* FROM Obj1 */ SELECT * FROM [S"), (k % 3).cast("string"), F.lit("] . [OBJ"), num(3), F.lit("] -- JOIN Obj9\n join Obj"), num(7), F.lit(" x UPDATE  Obj"), num(9), F.lit(" INSERT INTO nope.Obj"), num(11), F.lit(" EXEC S1.Obj"), num(13), F.lit(" WHERE Obj5.y = Obj"), k.cast("string"), F.lit("; delete from Obj4; execute getStuff; exec [sys].[p1]; EXEC Other 1"))
    code = F.element_at(F.array(*map(F.lit, ("U ", "V ", "P ", "FN", "XX"))), (k % 5 + 1).cast("int"))
    return s.select(k.alias("object_id"), (k % 3).alias("space_id"), F.concat(F.lit("Obj"), k.cast("string")).alias("name"), code.alias("code"), text.alias("definition"))


def _catalog(spark, d):
    raw = _objects(spark, d)
    spaces = spark.range(3).select(F.col("id").alias("space_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("space"))
    objects = catalog.load_objects(raw.drop("definition"), spaces, raw.where("code <> 'U '").select("object_id", "definition"))
    p, c, n = table(spark, d, "part"), table(spark, d, "customer"), table(spark, d, "nation")
    columns = p.select((F.col("p_partkey") % 12 + 1).alias("object_id"), F.concat(F.lit("Col"), F.col("p_partkey").cast("string")).alias("column"), F.col("p_partkey").cast("int").alias("ordinal"), F.col("p_type").alias("type"))
    keyed = p.where("p_size % 4 = 0").select(F.concat(F.lit("s"), ((F.col("p_partkey") % 12 + 1) % 3).cast("string")).alias("space"), F.concat(F.lit("OBJ"), (F.col("p_partkey") % 12 + 1).cast("string")).alias("object"), F.concat(F.lit("col"), F.col("p_partkey").cast("string")).alias("column"))
    cols = catalog.load_columns(columns, objects, keyed)
    params = catalog.load_parameters(c.select((F.col("c_custkey") % 12 + 1).alias("object_id"), F.concat(F.lit("@p"), F.col("c_custkey").cast("string")).alias("parameter"), (F.col("c_custkey") % 5).alias("ordinal")), objects)
    k = F.col("n_nationkey")
    key_columns = n.select(k.alias("key_id"), F.lit(1).alias("ordinal"), (k % 12 + 1).alias("object_id"), F.when(k % 12 == 0, 12).otherwise(k % 12).alias("column_id"), (k * 5 % 12 + 1).alias("to_object_id"), F.when(k * 5 % 12 == 0, 12).otherwise(k * 5 % 12).alias("to_column_id"))
    keys = catalog.load_keys(n.select(k.alias("key_id"), F.col("n_name").alias("name")), key_columns, objects, columns)
    return objects, cols, params, keys


def catalog_objects(spark, d):
    """SC1, SC3: objects with their spaces, types and definitions."""
    o = _catalog(spark, d)[0]
    return o.select("space", "name", "type", F.sha2(F.coalesce("definition", F.lit("")), 256).alias("digest"))


def catalog_columns(spark, d):
    """SC4, JN22: columns with their key flag."""
    return _catalog(spark, d)[1]


def catalog_parameters(spark, d):
    """SC5."""
    return _catalog(spark, d)[2]


def catalog_keys(spark, d):
    """SC6, SC9: foreign keys with the names of both ends."""
    return _catalog(spark, d)[3]


def catalog_probe(spark, d):
    """SC2, SC10: whether all wanted tables are there; names whatever their case."""
    present = _catalog(spark, d)[0].select("name")
    a = catalog.has_tables(present, ["OBJ1", "obj2", "Obj3"]).withColumn("asked", F.lit("three"))
    return a.unionByName(catalog.has_tables(present, ["Obj1", "Missing"]).withColumn("asked", F.lit("missing")))


def released_menus(spark, d):
    """SC7, SC8: menus made of orders."""
    m = table(spark, d, "orders").select((F.col("o_orderkey") + 8800).alias("id"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") != "F").alias("released"), F.when(F.col("o_orderkey") % 6 == 0, "").when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("/m/"), F.col("o_orderkey").cast("string"))).alias("link"))
    return catalog.load_menus(m, [9001, 9002]).select("id", "parent", "link")


def catalog_graph(spark, d):
    """EX14, JN3: the catalog as nodes and edges."""
    o, c, p, k = _catalog(spark, d)
    n = catalog.catalog_nodes("db", o, c, p).select(F.lit("node").alias("part"), F.col("kind").alias("type"), F.col("id").alias("src"), F.coalesce("detail", F.lit("")).alias("dst"))
    return n.unionByName(catalog.catalog_edges("db", o, c, p, k).select(F.lit("edge").alias("part"), "type", "src", "dst"))


def sql_references(spark, d):
    """SF7, SF8, EX22: what the definitions mention and how."""
    o = _catalog(spark, d)[0]
    found = catalog.references(o.where("definition is not null"), "name", "definition", o)
    return found.select("id", "space", "name", "type", "access", "confidence", catalog.code_relation(F.col("type")).alias("relation"))


def catalog_dependencies(spark, d):
    """SF9, EX15: edges between objects by their definitions."""
    return catalog.dependencies(_catalog(spark, d)[0])


def procedure_calls(spark, d):
    """SF10, EX20, JN15: procedures that definitions execute."""
    o = _catalog(spark, d)[0]
    return catalog.procedure_calls(o.where("definition is not null"), "name", "definition", o)


def listed_objects(spark, d):
    """PF2, ST5: the first objects of two sources with a part of the name."""
    o = _catalog(spark, d)[0]
    two = o.withColumn("source", F.lit("a")).unionByName(o.where("type <> 'View'").withColumn("source", F.lit("b")))
    rows, more = catalog.list_objects(two, "BJ1", "Unknown", 5)
    return rows.select("source", "space", "name", "type").crossJoin(more)  # one row


def described_table(spark, d):
    """PF3, PF4: a table's columns, and the start of a definition as a row of its own."""
    o, c, _, k = _catalog(spark, d)
    t = catalog.describe_table(c, k, "s2", "OBJ5")
    text = catalog.definition(o, "S1", "obj1", 20).select(F.col("definition").alias("column"), F.lit(0).alias("ordinal"), "type", F.lit(False).alias("is_key"), F.lit(None).cast("string").alias("refers_to"))
    return t.unionByName(text)


def appended_catalog(spark, d):
    """MG14: a second catalog appended, with the document's provider and names."""
    o = _catalog(spark, d)[0]
    rows, doc = catalog.append_catalog(o.withColumn("source", F.lit("main")), o.where("type = 'Table'").withColumn("source", F.concat(F.lit("lite"), "space")), "SqlServer", "Sqlite")
    return rows.groupBy(F.col("provider").alias("of")).agg(F.count("*").alias("n")).crossJoin(doc)  # one row


QUERIES = {f.__name__: f for f in (catalog_objects, catalog_columns, catalog_parameters, catalog_keys, catalog_probe, released_menus, catalog_graph, sql_references, catalog_dependencies, procedure_calls, listed_objects, described_table, appended_catalog)}

_CATALOG = r"""
raw AS (SELECT s_suppkey AS k, 'S' || s_suppkey % 3 AS space, 'Obj' || s_suppkey AS name, CASE s_suppkey % 5 WHEN 0 THEN 'Table' WHEN 1 THEN 'View' WHEN 2 THEN 'StoredProcedure' WHEN 3 THEN 'UDF' END AS type,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'CREATE x AS /* FROM Obj1 */ SELECT * FROM [S' || s_suppkey % 3 || '] . [OBJ' || (s_suppkey * 3 % 10 + 1) || '] -- JOIN Obj9' || chr(10) || ' join Obj' || (s_suppkey * 7 % 10 + 1) || ' x UPDATE  Obj' || (s_suppkey * 9 % 10 + 1) || ' INSERT INTO nope.Obj' || (s_suppkey * 11 % 10 + 1) || ' EXEC S1.Obj' || (s_suppkey * 13 % 10 + 1) || ' WHERE Obj5.y = Obj' || s_suppkey || '; delete from Obj4; execute getStuff; exec [sys].[p1]; EXEC Other 1' END AS definition FROM supplier),
o AS (SELECT * FROM raw WHERE type IS NOT NULL),
c AS (SELECT o.space, o.name AS object, 'Col' || p_partkey AS "column", p_partkey::INTEGER AS ordinal, p_type AS type, p_size % 4 = 0 AS is_key, o.k AS object_id FROM part JOIN o ON p_partkey % 12 + 1 = o.k),
pa AS (SELECT o.space, o.name AS object, '@p' || c_custkey AS parameter, c_custkey % 5 AS ordinal FROM customer JOIN o ON c_custkey % 12 + 1 = o.k WHERE c_custkey % 5 > 0),
fk AS (SELECT n_name AS name, a.space, a.object, a."column", b.space AS to_space, b.object AS to_object, b."column" AS to_column, 1 AS ordinal FROM nation JOIN c a ON n_nationkey % 12 + 1 = a.object_id AND a.ordinal = CASE WHEN n_nationkey % 12 = 0 THEN 12 ELSE n_nationkey % 12 END JOIN c b ON n_nationkey * 5 % 12 + 1 = b.object_id AND b.ordinal = CASE WHEN n_nationkey * 5 % 12 = 0 THEN 12 ELSE n_nationkey * 5 % 12 END)
"""


def _sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}:' || upper(left(sha256({' || chr(31) || '.join(parts)}), 32))"


_OBJ = _sid("db-object", "'db'", "lower({s})", "lower({n})")
_PAIRS = r"'\[?[A-Za-z_]\w*\]?(?:\s*\.\s*\[?[A-Za-z_]\w*\]?)?'"
_REFS = rf"""
cl AS (SELECT name AS id, type AS source_type, space AS source_space, regexp_replace(definition, '/\*[\s\S]*?\*/|--[^\r\n]*', ' ', 'g') AS c FROM o WHERE definition IS NOT NULL),
tk AS (SELECT id, source_type, source_space, regexp_extract_all(c, {_PAIRS}) AS t, regexp_split_to_array(c, {_PAIRS}) AS g FROM cl),
ea AS (SELECT *, t[i] AS token, CASE WHEN regexp_full_match(g[i], '\s*') AND i > 1 THEN upper(t[i - 1]) ELSE '' END AS w1, CASE WHEN i > 2 AND regexp_full_match(g[i - 1], '\s*') THEN upper(t[i - 2]) ELSE '' END AS w2 FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk)),
pt AS (SELECT *, lower(trim(string_split(token, '.')[1], '[] ')) AS first, CASE WHEN contains(token, '.') THEN lower(trim(string_split(token, '.')[2], '[] ')) END AS second FROM ea),
al AS (SELECT lower(name) AS kn, arg_min(space, (space, name)) AS space, arg_min(name, (space, name)) AS name, arg_min(type, (space, name)) AS type FROM o GROUP BY 1),
hit AS (SELECT pt.*, coalesce(e.space, a.space, f.space) AS space, coalesce(e.name, a.name, f.name) AS name, coalesce(e.type, a.type, f.type) AS type, second IS NOT NULL AND coalesce(e.name, a.name) IS NOT NULL AS pair
  FROM pt LEFT JOIN o e ON lower(e.space) = first AND lower(e.name) = second LEFT JOIN al a ON a.kn = coalesce(second, first) LEFT JOIN al f ON second IS NOT NULL AND f.kn = first),
rf AS (SELECT id, source_type, source_space, space, name, type, CASE WHEN type = 'StoredProcedure' AND w1 IN ('EXEC', 'EXECUTE') THEN 'CALL' WHEN w1 = 'UPDATE' OR w2 || ' ' || w1 IN ('INSERT INTO', 'DELETE FROM', 'MERGE INTO', 'TRUNCATE TABLE') THEN 'WRITE' WHEN w1 IN ('FROM', 'JOIN', 'APPLY') THEN 'READ' ELSE 'REFERENCE' END AS access, CASE WHEN pair THEN 'SCHEMA_QUALIFIED_NAME' ELSE 'UNQUALIFIED_EXACT_NAME' END AS confidence FROM hit WHERE name IS NOT NULL)
"""

ORACLE = {
    "catalog_objects": f"WITH {_CATALOG} SELECT space, name, type, sha256(coalesce(definition, '')) AS digest FROM o",
    "catalog_columns": f'WITH {_CATALOG} SELECT space, object, "column", ordinal, type, is_key FROM c',
    "catalog_parameters": f"WITH {_CATALOG} SELECT * FROM pa",
    "catalog_keys": f"WITH {_CATALOG} SELECT * FROM fk",
    "catalog_probe": f"WITH {_CATALOG} SELECT (count(*) = 3)::INTEGER AS all_there, 'three' AS asked FROM o WHERE name IN ('Obj1', 'Obj2', 'Obj3') UNION ALL SELECT 0, 'missing'",
    "released_menus": "SELECT o_orderkey + 8800 AS id, o_custkey AS parent, '/m/' || o_orderkey AS link FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 6 > 0 AND o_orderkey % 7 > 0 AND NOT starts_with((o_orderkey + 8800)::VARCHAR, '88') AND o_orderkey + 8800 NOT IN (9001, 9002)",
    "catalog_graph": f"""WITH {_CATALOG} SELECT 'node' AS part, 'Database' AS type, {_sid("database", "'db'")} AS src, '' AS dst
UNION ALL SELECT 'node', 'DatabaseObject', {_OBJ.format(s="space", n="name")}, type || ':' || length(coalesce(definition, '')) || ':' || left(sha256(coalesce(definition, '')), 8) FROM o
UNION ALL SELECT 'node', 'DatabaseColumn', {_sid("db-column", "'db'", "lower(space)", "lower(object)", 'lower("column")')}, ordinal || ':' || type || ':' || is_key FROM c
UNION ALL SELECT 'node', 'StoredProcedureParameter', {_sid("db-parameter", "'db'", "lower(space)", "lower(object)", "lower(parameter)")}, ordinal::VARCHAR FROM pa
UNION ALL SELECT 'edge', 'CONTAINS_OBJECT', {_sid("database", "'db'")}, {_OBJ.format(s="space", n="name")} FROM o
UNION ALL SELECT 'edge', 'HAS_COLUMN', {_OBJ.format(s="space", n="object")}, {_sid("db-column", "'db'", "lower(space)", "lower(object)", 'lower("column")')} FROM c
UNION ALL SELECT 'edge', 'HAS_PARAMETER', {_OBJ.format(s="space", n="object")}, {_sid("db-parameter", "'db'", "lower(space)", "lower(object)", "lower(parameter)")} FROM pa
UNION ALL SELECT 'edge', 'FOREIGN_KEY_TO', {_OBJ.format(s="space", n="object")}, {_OBJ.format(s="to_space", n="to_object")} FROM fk""",
    "sql_references": f"WITH {_CATALOG}, {_REFS} SELECT id, space, name, type, access, confidence, CASE type WHEN 'StoredProcedure' THEN 'REFERENCES_STORED_PROCEDURE' WHEN 'UDF' THEN 'REFERENCES_UDF' ELSE 'REFERENCES_DATABASE_OBJECT' END AS relation FROM rf",
    "catalog_dependencies": f"WITH {_CATALOG}, {_REFS} SELECT CASE WHEN source_type = 'StoredProcedure' AND type = 'StoredProcedure' THEN 'CALLS_STORED_PROCEDURE' WHEN source_type = 'StoredProcedure' AND type = 'UDF' THEN 'CALLS_UDF' WHEN access = 'WRITE' THEN 'WRITES' WHEN access = 'READ' THEN 'READS' ELSE 'REFERENCES_DATABASE_OBJECT' END AS type, source_space || '.' || id AS src, space || '.' || name AS dst, count(*) AS n FROM rf WHERE source_space || '.' || id <> space || '.' || name GROUP BY ALL",
    "procedure_calls": f"WITH {_CATALOG} SELECT name AS id, 's1.Obj' || (k * 13 % 10 + 1) AS procedure, 'KNOWN' AS status FROM o WHERE definition IS NOT NULL AND 'Obj' || (k * 13 % 10 + 1) IN (SELECT name FROM o WHERE type = 'StoredProcedure') UNION ALL SELECT name, 'dbo.getStuff', 'CODE_ONLY_OR_HISTORICAL' FROM o WHERE definition IS NOT NULL",
    "listed_objects": f"WITH {_CATALOG}, two AS (SELECT 'a' AS source, space, name, type FROM o UNION ALL SELECT 'b', space, name, type FROM o WHERE type <> 'View'), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY space, name, type) AS r FROM two WHERE contains(lower(name), 'bj1')), t AS (SELECT * FROM f WHERE r <= 6) SELECT source, space, name, type, (SELECT count(*) > 5 FROM t) AS truncated FROM t ORDER BY source, space, name, type LIMIT 5",
    "described_table": f"""WITH {_CATALOG}, r AS (SELECT lower("column") AS k, string_agg(DISTINCT to_space || '.' || to_object || '.' || to_column, ',' ORDER BY to_space || '.' || to_object || '.' || to_column) AS refers_to FROM fk WHERE space = 'S2' AND object = 'Obj5' GROUP BY 1) SELECT "column", ordinal, type, is_key, refers_to FROM c LEFT JOIN r ON lower("column") = r.k WHERE space = 'S2' AND object = 'Obj5' UNION ALL SELECT left(definition, 20) || '…', 0, type, false, NULL FROM o WHERE space = 'S1' AND name = 'Obj1'""",
    "appended_catalog": f"WITH {_CATALOG}, u AS (SELECT 'SqlServer' AS p, 'main' AS s FROM o UNION ALL SELECT 'Sqlite', 'lite' || space FROM o WHERE type = 'Table') SELECT p AS \"of\", count(*) AS n, 'Mixed' AS provider, (SELECT string_agg(DISTINCT s, ';' ORDER BY s) FROM u) AS sources FROM u GROUP BY p",
}
