"""Report, schedule, menu and code queries over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .graph_queries import table


def report_documents(spark, d):
    """EX18, JN6, SF11, WN8: documents of templates by their XML; every seventh template is broken."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    doc = lambda m: F.concat(F.lit('<ReportDocument DataSourceSerialID="S'), (k * m % 50).cast("string"), F.lit('"/>'))
    xml = F.concat(F.lit("<R><x/>"), doc(3), doc(7), F.when(k % 2 == 0, F.lit("<ReportDocument/>")).otherwise(F.lit("")), F.when(k % 7 == 0, F.lit("<")).otherwise(F.lit("</R>")))
    sources = table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source"))
    return reports.report_documents(p.select(k.cast("string").alias("template"), xml.alias("xml")), sources)


def schedule_procedures(spark, d):
    """EX17: procedures that task definitions execute, with counts of arguments."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    xml = F.concat(F.lit('<T Name="t"><Argument Value="x"/><Argument Value="AUTO=ExecStoredProcedure:[S].Proc'), (k % 4).cast("string"), F.lit(',a'), F.repeat(F.lit(", b"), (k % 3).cast("int")), F.lit('"/><Argument Value="AUTO=EXECSTOREDPROCEDURE:Other"/></T>'))
    parameters = table(spark, d, "nation").select(F.concat(F.lit("s.proc"), (F.col("n_nationkey") % 8).cast("string")).alias("procedure"))
    return reports.schedule_procedures(s.select(k.alias("task"), xml.alias("xml")), parameters)


def schedule_tasks(spark, d):
    """JN5: orders as tasks of customers, with definitions by priority."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("schedule"), F.col("o_orderkey").alias("task"), F.upper("o_orderpriority").alias("name"))
    definitions = table(spark, d, "orders").where("o_orderpriority like '1%' or o_orderpriority like '3%'").select(F.lower("o_orderpriority").alias("name")).distinct().select("name", F.concat(F.lit("def:"), "name").alias("definition"))
    return reports.schedule_tasks(table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("schedule")), o, definitions)


def category_constants(spark, d):
    """AG5, JN8: formats with the first constant of their category."""
    f = table(spark, d, "part").select(F.col("p_partkey").alias("format"), F.col("p_type").alias("category"))
    c = table(spark, d, "part").where("p_type <> 'PROMO'").select(F.col("p_type").alias("value"), F.col("p_brand").alias("constant"), (F.col("p_partkey") * 37 % 1009).alias("seq"))
    return reports.category_constants(f, c.join(c.groupBy("value").agg(F.min("seq").alias("least")), "value").where("seq >= least").drop("least"))


def menu_routes(spark, d):
    """EX19, JN10: where menus lead."""
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    k = F.col("s_suppkey")
    link = F.when(k % 4 == 0, F.concat(F.lit("/CustomReport/MenuIndex/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("/PluginReport/MenuIndex/"), F.base64(F.concat(F.lit("asm/N.Type"), (k % 5).cast("string")).cast("binary")))).when(k % 4 == 2, F.concat(F.lit("\\type"), (k % 3).cast("string"), F.lit("//go/"))).otherwise(F.concat(F.lit("Type"), (k % 5).cast("string")))
    types = p.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("type"), F.concat(F.lit("Type"), F.col("p_partkey").cast("string"), F.lit("Controller")).alias("name"), F.concat(F.lit("n.type"), F.col("p_partkey").cast("string")).alias("full_name"))
    methods = p.select(F.concat(F.lit("t"), (F.col("p_partkey") - F.col("p_partkey") % 12 + F.col("p_partkey") % 6).cast("string")).alias("type"), F.when(F.col("p_partkey") % 2 == 0, "Go").otherwise("index").alias("name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method"))
    return reports.menu_routes(s.select(k.alias("id"), link.alias("link")), s.where("s_suppkey % 8 = 0").select(k.cast("string").alias("template")), types, methods)


def entity_mappings(spark, d):
    """JN11: entity sets to objects and types."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    sets = c.select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("entity"), (F.col("c_nationkey")).alias("store"))
    mappings = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("store"), F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"), "r_name", "n_name").select("store", "seq", F.col("r_name").alias("space"), F.when(F.col("seq") == 1, F.col("n_name")).otherwise(F.lit("late")).alias("name"))
    objects = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 5 > 0").select(F.lower("r_name").alias("space"), F.lower("n_name").alias("name"), F.col("n_nationkey").alias("object"))
    types = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("type"))
    return reports.entity_mappings(sets, mappings, objects, types)


def header_mappings(spark, d):
    """JN12: types of files whose header names a table."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    files = s.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("// 來源資料表：Tbl"), (F.col("s_suppkey") % 4).cast("string"), F.lit("\n// 來源資料表類型：View"))).alias("text"))
    types = p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 12).cast("string")).alias("path"), F.col("p_partkey").alias("type"))
    return reports.header_mappings(files, types, s.select(F.concat(F.lit("[TBL"), (F.col("s_suppkey") * 2).cast("string"), F.lit("]")).alias("name")))


def parameter_bindings(spark, d):
    """JN14: bindings by space, object and name."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    bound = o.select(F.col("o_orderkey").alias("method"), F.lit("DBO").alias("space"), F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")).alias("object"), F.concat(F.lit("@A"), (F.col("o_orderkey") % 9).cast("string")).alias("name"))
    return reports.parameter_bindings(bound, c.select(F.lit("dbo").alias("space"), F.concat(F.lit("p"), (F.col("c_custkey") % 5).cast("string")).alias("object"), F.concat(F.lit("@a"), (F.col("c_custkey") % 8).cast("string")).alias("parameter")))


def returned_views(spark, d):
    """EX23, JN17, JN18: views that methods return, and what decides over the return."""
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    r = o.select(F.col("o_orderkey").alias("method"), F.concat(F.lit("c"), (F.col("o_orderkey") % 4).cast("string")).alias("controller"), F.concat(F.lit("V"), (F.col("o_orderkey") % 30).cast("string")).alias("view"))
    v = p.select(F.concat(F.lit("Views/"), F.when(F.col("p_partkey") % 5 == 0, F.lit("deep/down/")).otherwise(F.lit("")), F.lit("C"), (F.col("p_partkey") % 6).cast("string"), F.lit("/v"), (F.col("p_partkey") % 25).cast("string"), F.lit(".cshtml")).alias("path")).distinct()
    code = F.element_at(F.array(*map(F.lit, ("if (a) { return View();", "else return View();", "case 1: return View();", "x => View()", "return View();"))), (F.col("method") % 5 + 1).cast("int"))
    return reports.returned_views(r, v).withColumn("branch", reports.branch_kind(code))


def included_scripts(spark, d):
    """EX11, EX12, JN17: scripts that pages include, resolved to files."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.concat(F.lit("js/A"), (F.col("page_id") % 12).cast("string"), F.lit(".js")).alias("reference"))
    files = table(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("src/web/js/a")).when(F.col("p_partkey") % 3 == 1, F.lit("app/js/a")).otherwise(F.lit("otherjs/a")), (F.col("p_partkey") % 10).cast("string"), F.lit(".js")).alias("path")).distinct()
    return reports.included_scripts(pages, files)


def call_owners(spark, d):
    """JN1, JN13: calls with the innermost method whose lines hold them, else their file."""
    p, o = table(spark, d, "part"), table(spark, d, "orders")
    first = F.col("p_partkey") * 13 % 300
    methods = p.select(F.concat(F.lit("F"), (F.col("p_partkey") % 9).cast("string")).alias("path"), first.alias("first"), (first + F.col("p_size") * 2).alias("last"), F.col("p_partkey").cast("string").alias("method"))
    calls = o.select(F.concat(F.lit("f"), (F.col("o_orderkey") % 11).cast("string")).alias("path"), (F.col("o_custkey") % 400).alias("line")).distinct()
    return reports.method_at(calls, methods)


def code_index(spark, d):
    """JN1, EX10: sizes of the lookups of a code base."""
    p = table(spark, d, "part")
    types = p.select(F.col("p_partkey").alias("type"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("full_name"), F.col("p_brand").alias("path"))
    methods = p.select(F.col("p_partkey").alias("method"), F.col("p_partkey").alias("type"), F.upper("p_type").alias("name"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"))
    out = None
    for name, df in reports.code_index(methods, types).items():
        one = df.agg(F.lit(name).alias("lookup"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def code_chunks(spark, d):
    """EX9: texts cut, with the hash of the whole."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    return reports.chunks(docs, 500).select("id", "chunk", F.length("text").alias("length"), "hash", "cut")


def project_edges(spark, d):
    """EX1, EX24: projects with their references; branches of a remote listing as rows of their own."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    projects = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("solution"), F.col("n_name").alias("project"), F.concat(F.lit("P/"), F.upper("n_name")).alias("path"))
    refs = n.select(F.col("n_name").alias("project"), F.concat(F.lit("p/nation_"), (F.col("n_nationkey") * 3).cast("string")).alias("path"))
    lines = r.select(F.explode(F.array(F.concat(F.lit("ab\trefs/heads/"), "r_name"), F.concat(F.lit("cd\trefs/tags/"), "r_name"), F.lit("ef\trefs/heads/main"))).alias("line"))
    return reports.project_edges(projects, refs).unionByName(reports.remote_branches(lines).select(F.lit("BRANCH").alias("type"), F.col("branch").alias("src"), F.lit("").alias("dst")))


def connection_profiles(spark, d):
    """EX16: connections of configuration files to one database, and the projects that hold them."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    tag = lambda name, db: F.concat(F.lit(f'<add name="{name}'), k.cast("string"), F.lit('" connectionString="Server=x;'), db, F.lit('" providerName="p"/>'))
    text = F.concat(F.lit("<c>"), tag("a", F.when(k % 2 == 0, F.lit("Initial Catalog=Main")).otherwise(F.lit("Database = main;y=1"))), tag("b", F.lit("Initial Catalog=Other")), F.lit('<add key="z"/></c>'))
    configs = s.select(F.concat(F.lit("c:/src/p"), (k % 4).cast("string"), F.lit("/sub/"), k.cast("string"), F.lit(".config")).alias("path"), text.alias("text"))
    n = table(spark, d, "nation")
    projects = n.select(F.col("n_name").alias("project"), F.concat(F.lit("C:\\src\\P"), F.col("n_nationkey").cast("string")).alias("root")).union(n.where("n_nationkey = 3").select("n_name", F.lit("c:/src/p1/sub")))
    return reports.connections(configs, projects, "MAIN")


def command_calls(spark, d):
    """EX20, EX21, SF10: procedures and parameters in code."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    word = F.when(k % 3 == 0, F.concat(F.lit('"Proc'), (k % 7).cast("string"), F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("Const"), (k % 5).cast("string"))).otherwise(F.lit('"select x from y"'))
    text = F.concat(F.lit("var c = new SqlCommand( "), word, F.lit(', x); new SqlParameter("@p'), (k % 4).cast("string"), F.lit('", SqlDbType.Int);'), F.when(k % 2 == 0, F.lit(" c.CommandType = CommandType.StoredProcedure;")).otherwise(F.lit("")))
    methods = p.select(k.cast("string").alias("method"), F.col("p_brand").alias("file"), text.alias("text"))
    constants = p.where("p_partkey % 5 < 3").select(F.col("p_brand").alias("file"), F.concat(F.lit("CONST"), (k % 5).cast("string")).alias("name"), F.concat(F.lit("sp"), (k % 5).cast("string")).alias("value"))
    calls = reports.command_calls(methods, constants)
    return calls.unionByName(reports.code_parameters(methods).select("method", F.col("parameter").alias("procedure"), F.col("type").alias("how")))


QUERIES = {f.__name__: f for f in (connection_profiles, command_calls, report_documents, schedule_procedures, schedule_tasks, category_constants, menu_routes, entity_mappings, header_mappings, parameter_bindings, returned_views, included_scripts, call_owners, code_index, code_chunks, project_edges)}


def _sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}:' || upper(left(sha256({' || chr(31) || '.join(parts)}), 32))"


ORACLE = {
    "report_documents": f"""WITH t AS (SELECT p_partkey AS k, unnest(list_filter([{{'o': 1, 's': 'S' || (p_partkey * 3 % 50)}}, {{'o': 2, 's': 'S' || (p_partkey * 7 % 50)}}, CASE WHEN p_partkey % 2 = 0 THEN {{'o': 3, 's': NULL}} END], lambda x: x IS NOT NULL)) AS e FROM part WHERE p_partkey % 7 <> 0),
s AS (SELECT 's' || c_custkey AS source FROM customer)
SELECT k::VARCHAR AS template, e.o AS ordinal, {_sid("report-document", "k::VARCHAR", "e.o::VARCHAR", "coalesce(e.s, '')")} AS document, source FROM t LEFT JOIN s ON lower(e.s) = source""",
    "schedule_procedures": "WITH k AS (SELECT 's.proc' || n_nationkey % 8 AS procedure, count(*) AS n FROM nation GROUP BY 1), c AS (SELECT s_suppkey AS task, 's.proc' || s_suppkey % 4 AS procedure, (1 + s_suppkey % 3)::INTEGER AS arguments FROM supplier UNION ALL SELECT s_suppkey, 'dbo.other', 0 FROM supplier) SELECT task, procedure, arguments, coalesce(n, 0) AS expected, arguments <> coalesce(n, 0) AS mismatch FROM c LEFT JOIN k USING (procedure)",
    "schedule_tasks": "SELECT o_custkey AS schedule, o_orderkey AS task, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' THEN 'def:' || lower(o_orderpriority) END AS definition FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)",
    "category_constants": "WITH f AS (SELECT p_type, arg_min(p_brand, (p_partkey * 37 % 1009, p_brand)) AS constant FROM part WHERE p_type <> 'PROMO' GROUP BY p_type) SELECT p_partkey AS format, constant FROM part JOIN f USING (p_type)",
    "menu_routes": f"""WITH t AS (SELECT 't' || p_partkey AS type, p_partkey AS n FROM part), m AS (SELECT 't' || (p_partkey - p_partkey % 12 + p_partkey % 6) AS type, CASE WHEN p_partkey % 2 = 0 THEN 'go' ELSE 'index' END AS name, 'm' || p_partkey AS method FROM part),
mv AS (SELECT s_suppkey AS id, s_suppkey % 3 AS n, 'go' AS a FROM supplier WHERE s_suppkey % 4 = 2 UNION ALL SELECT s_suppkey, s_suppkey % 5, 'index' FROM supplier WHERE s_suppkey % 4 = 3)
SELECT s_suppkey AS menu, 'LINKS_TO_CUSTOM_REPORT' AS relation, s_suppkey::VARCHAR AS target FROM supplier WHERE s_suppkey % 8 = 0
UNION ALL SELECT s_suppkey, 'LINKS_TO_PLUGIN_REPORT', {_sid("plugin-report-target", "'asm'", "'N.Type' || s_suppkey % 5")} FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT s_suppkey, 'IMPLEMENTED_BY_TYPE', type FROM supplier JOIN t ON t.n = s_suppkey % 5 WHERE s_suppkey % 4 = 1
UNION ALL SELECT id, 'NAVIGATES_TO_CONTROLLER', type FROM mv JOIN t USING (n) UNION ALL SELECT id, 'NAVIGATES_TO_ACTION', method FROM mv JOIN t USING (n) JOIN m ON m.type = t.type AND m.name = mv.a""",
    "entity_mappings": "SELECT 'E' || c_custkey AS entity, CASE WHEN c_nationkey % 4 > 0 AND c_nationkey % 5 > 0 THEN c_nationkey END AS object, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS type FROM customer",
    "header_mappings": "SELECT p_partkey AS type, 'tbl' || s_suppkey % 4 AS object, CASE WHEN s_suppkey % 4 IN (SELECT s_suppkey * 2 FROM supplier) THEN 'MAPPED' ELSE 'CANDIDATE' END AS status FROM supplier JOIN part ON p_partkey % 12 = s_suppkey WHERE s_suppkey % 3 > 0",
    "parameter_bindings": "SELECT DISTINCT o_orderkey AS method, '@a' || o_orderkey % 9 AS parameter FROM orders WHERE (o_custkey % 7, o_orderkey % 9) IN (SELECT (c_custkey % 5, c_custkey % 8) FROM customer)",
    "returned_views": """WITH v AS (SELECT DISTINCT 'Views/' || CASE WHEN p_partkey % 5 = 0 THEN 'deep/down/' ELSE '' END || 'C' || p_partkey % 6 || '/v' || p_partkey % 25 || '.cshtml' AS path, p_partkey % 6 AS c, p_partkey % 25 AS s FROM part),
b AS (SELECT o_orderkey, arg_min(path, (CASE WHEN c = o_orderkey % 4 THEN 0 ELSE 1 END, length(path), path)) AS path FROM orders LEFT JOIN v ON s = o_orderkey % 30 GROUP BY o_orderkey)
SELECT o_orderkey AS method, coalesce(path, 'unresolved:V' || o_orderkey % 30) AS view, path IS NOT NULL AS resolved, (['if', 'else', 'switch', 'expression', 'unconditional'])[o_orderkey % 5 + 1] AS branch FROM b""",
    "included_scripts": "WITH f AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'src/web/js/a' WHEN 1 THEN 'app/js/a' ELSE 'otherjs/a' END || p_partkey % 10 || '.js' AS path FROM part), b AS (SELECT page_id, 'js/A' || page_id % 12 || '.js' AS r FROM pages) SELECT page_id AS page, coalesce((SELECT arg_min(path, (length(path), path)) FROM f WHERE path = lower(r) OR ends_with(path, '/' || lower(r))), r) AS script, EXISTS (SELECT * FROM f WHERE path = lower(r) OR ends_with(path, '/' || lower(r))) AS resolved FROM b",
    "call_owners": "WITH m AS (SELECT 'f' || p_partkey % 9 AS path, p_partkey * 13 % 300 AS first, p_partkey * 13 % 300 + p_size * 2 AS last, p_partkey::VARCHAR AS method FROM part), c AS (SELECT DISTINCT 'f' || o_orderkey % 11 AS path, o_custkey % 400 AS line FROM orders), b AS (SELECT c.path, c.line, arg_min(method, (last - first, method)) AS method FROM c LEFT JOIN m ON c.path = m.path AND c.line BETWEEN first AND last GROUP BY ALL) SELECT path, line, coalesce(method, path) AS owner, CASE WHEN method IS NULL THEN 'FILE' ELSE 'METHOD' END AS how FROM b",
    "code_index": "SELECT 'method_by_place' AS lookup, count(DISTINCT (lower(p_brand), p_size)) AS n FROM part UNION ALL SELECT 'type_by_name', count(DISTINCT lower(p_name)) FROM part UNION ALL SELECT 'type_by_full_name', count(DISTINCT lower(p_brand || '.' || p_name)) FROM part UNION ALL SELECT 'type_by_file', count(DISTINCT lower(p_brand)) FROM part UNION ALL SELECT 'method_by_type', count(DISTINCT (lower(p_name), lower(p_type))) FROM part",
    "code_chunks": f"SELECT doc_id::VARCHAR AS id, {_sid('chunk', 'doc_id::VARCHAR')} AS chunk, least(500, length(text))::INTEGER AS length, sha256(text) AS hash, length(text) > 500 AS cut FROM documents WHERE text IS NOT NULL",
    "project_edges": "SELECT 'CONTAINS_PROJECT' AS type, 'r' || n_regionkey AS src, n_name AS dst FROM nation UNION ALL SELECT 'REFERENCES_PROJECT', a.n_name, b.n_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey * 3 UNION ALL SELECT DISTINCT 'BRANCH', b, '' FROM (SELECT r_name AS b FROM region UNION ALL SELECT 'main')",
    "connection_profiles": f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS p FROM supplier) SELECT {_sid("connection-profile", "'C:/SRC/P' || p || '/SUB/' || k || '.CONFIG'", "'a' || k")} AS profile, 'a' || k AS name, 'p' AS provider, CASE p WHEN 0 THEN 'NATION_0' WHEN 1 THEN 'NATION_3' WHEN 2 THEN 'NATION_2' WHEN 3 THEN 'NATION_3' END AS project FROM s""",
    "command_calls": """WITH c AS (SELECT p_brand AS file, 'Const' || p_partkey % 5 AS name, 'sp' || p_partkey % 5 AS value FROM part WHERE p_partkey % 5 < 3 GROUP BY ALL)
SELECT p_partkey::VARCHAR AS method, CASE WHEN p_partkey % 3 = 0 THEN 'Proc' || p_partkey % 7 ELSE coalesce(value, 'Const' || p_partkey % 5) END AS procedure, CASE WHEN p_partkey % 3 = 0 THEN 'LITERAL' WHEN value IS NOT NULL THEN 'CONSTANT' ELSE 'DYNAMIC' END AS how
FROM part LEFT JOIN c ON file = p_brand AND name = 'Const' || p_partkey % 5 WHERE p_partkey % 2 = 0 AND p_partkey % 3 < 2 UNION ALL SELECT p_partkey::VARCHAR, '@p' || p_partkey % 4, 'Int' FROM part""",
}
