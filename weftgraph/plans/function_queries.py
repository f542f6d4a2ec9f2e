"""Queries of the scalar functions, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, search
from .graph_queries import GRAPH, derive, table


def path_forms(spark, d):
    """SF2: a page's address as a path, normalised, relative to a root, and its parts."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("C:\\Src\\"), F.replace("url", F.lit("/"), F.lit("\\")), F.lit(".Min.JS\\")).alias("p"), F.concat(F.lit("c:/src/"), "url", F.lit("/x."), (F.col("page_id") % 3).cast("string"), F.lit("TXT")).alias("f"))
    return p.select("page_id", paths.normalize_path(F.col("p")).alias("normal"), paths.relative_path(F.col("p"), F.lit("c:/SRC")).alias("below"), paths.file_name(F.col("f")).alias("file"), paths.stem(F.col("f")).alias("stem"), paths.extension(F.col("f")).alias("ext"))


def object_names(spark, d):
    """SF3: bracketed names of nations in their regions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    full = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("["), "n_name", F.lit("]"))).otherwise(F.concat(F.lit("["), "r_name", F.lit("] . ["), "n_name", F.lit("]")))
    parts = paths.split_object_name(full)
    return n.select("n_nationkey", paths.object_name(F.concat(F.lit("["), "n_name", F.lit("]"))).alias("plain"), parts["space"].alias("space"), parts["name"].alias("name"))


def reference_forms(spark, d):
    """SF13: links of pages as references."""
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"~/'), F.regexp_replace("url", "^https?://", ""), F.lit('?v=1#x"'))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("#top"))).otherwise(F.concat(F.lit(" \\"), F.regexp_replace("url", "^https?:/", "")))
    return table(spark, d, "pages").select("page_id", paths.normalize_reference(raw).alias("reference"))


def connection_parts(spark, d):
    """SF5: connection strings inside tags, taken apart."""
    tag = F.concat(F.lit('<add name="'), "s_name", F.lit('" connectionString="Data Source=h'), F.col("s_nationkey").cast("string"), F.lit(" ; Initial Catalog = db&amp;"), F.col("s_suppkey").cast("string"), F.lit(';x=1" NAME="second" providerName="p" />'))
    a = paths.tag_attributes(tag)
    got = table(spark, d, "supplier").select("s_suppkey", a["name"].alias("name"), a["connectionstring"].alias("c"), F.size(a).alias("n"))
    return got.select("s_suppkey", "name", "n", paths.connection_part(F.col("c"), "data source").alias("host"), paths.connection_part(F.col("c"), "initial catalog").alias("database"), paths.connection_part(F.col("c"), "missing").alias("missing"))


def plugin_targets(spark, d):
    """SF6: base64 targets, every fourth of them broken."""
    text = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), "p_name", F.lit("/x"))))
    t = paths.plugin_target(F.when(F.col("p_partkey") % 4 == 0, F.lit("%%%")).otherwise(F.base64(text.cast("binary"))))
    return table(spark, d, "part").select("p_partkey", t["assembly"].alias("assembly"), t["class_name"].alias("class_name"), (t["decoded"] == "").alias("broken"))


def text_forms(spark, d):
    """SF28, SF29, SF30, SF31: cut, single-line, escaped and cast texts; line counts from 1."""
    c = table(spark, d, "conversations").withColumn("t", F.concat("text", F.lit("\r\nit's a \\ ")))
    return c.select("conv_id", "turn", "role", F.sha2(paths.shortened(F.col("t"), 60), 256).alias("cut"), F.sha2(paths.single_line(F.col("t")), 256).alias("line"), F.sha2(paths.quoted_literal(F.col("t")), 256).alias("literal"), F.left(F.regexp_replace("text", "[^0-9]", ""), F.lit(4)).try_cast("int").alias("number"), (F.col("turn") + 1).alias("ordinal"))


def masked_settings(spark, d):
    """SF18: settings of an event with values behind secret names masked."""
    m = F.create_map(F.lit("apiKey"), F.col("props"), F.lit("Host"), F.col("event_type"), F.lit("db_PASSWORD"), F.when(F.col("event_id") % 2 == 0, F.col("props")))
    got = paths.mask_secrets(m)
    return table(spark, d, "events").select("event_id", got["apiKey"].alias("api_key"), got["Host"].alias("host"), got["db_PASSWORD"].alias("password"))


def asset_kinds(spark, d):
    """SC13, PF13, PF14: what a file is by its name, whether it is a library's, and whether it looks like an endpoint."""
    ends = F.element_at(F.array(*map(F.lit, ("/app.bundle.js", "/dist/a.ts", "/Page.ASPX", "/x.cs", "/vite.config.ts", "/lib/q.min.js", "/read.me"))), (F.col("page_id") % 7 + 1).cast("int"))
    p = F.concat(F.regexp_replace("url", "^https?://", ""), ends)
    return table(spark, d, "pages").select("page_id", paths.asset_kind(p).alias("kind"), paths.third_party(p).alias("library"), paths.looks_like_endpoint(p).alias("endpoint"))


def search_clauses(spark, d):
    """FT5, FT6, FT7: the search text of each benchmark item."""
    return table(spark, d, "benchmark").select("item_id", search.search_clauses(F.concat(F.col("text"), F.lit(" a/b:c x*y")), 12).alias("clauses"), search.normalize_query_text(F.col("text")).alias("normal"))


def _questions(spark, d):
    a = table(spark, d, "benchmark").select("item_id", F.col("text").alias("t"))
    return a.select("item_id", F.concat("t", F.lit(" BondTradeService"), (F.col("item_id") % 7).cast("string"), F.lit(" in menu "), (F.col("item_id") * 37 + 100).cast("string"), F.lit(" of user_Login.Controller")).alias("question"))


_ALIASES = (("login", "permission"), ("login", "role"), ("report", "custom report"), ("settle", "MENU"))


def query_plan(spark, d):
    """RT1, RT2, RT3: search texts of ten questions' worth of channels, best first."""
    aliases = spark.createDataFrame(list(_ALIASES), "term string, alias string")
    return search.query_plan(_questions(spark, d), "item_id", "question", aliases).select(F.col("id").alias("item_id"), "place", "query", "channel", "priority")


def split_words(spark, d):
    """RT2: words of technical names."""
    from ..functions.strings import split_identifier

    name = F.concat(F.lit("HTTPServer"), F.regexp_replace("p_brand", "#", ""), F.lit("_v"), F.col("p_size").cast("string"), F.lit(".getX"))
    return table(spark, d, "part").select("p_partkey", F.array_join(split_identifier(name), " ").alias("words"))


def name_boosts(spark, d):
    """RK1, RK2, RK3, RK5, RK6: boosts, roles and display names of the graph's nodes for one question."""
    nodes, _ = derive(spark, d)
    q = F.lit(" Large-Widget ")
    names = F.array("name", "id")
    shown = search.display_name(F.col("id"), F.when(F.col("kind") == "Method", F.lit(" ")).otherwise(F.col("name")))
    return nodes.select("id", search.exact_name_boost(names, q).alias("exact"), search.graph_name_boost(names, q).alias("graph"), search.intent_boost(F.lit("哪個方法的資料"), F.col("kind")).alias("intent"), search.infer_role(F.col("kind"), F.concat("name", F.when(F.col("kind") == "Type", "Controller").otherwise(""))).alias("role"), shown.alias("shown"))


def budget_plans(spark, d):
    """BG1, BG4: how characters are split, and the evidence lines of edges."""
    o = table(spark, d, "orders")
    plan = search.budget_plan(F.col("o_totalprice").cast("int"), F.col("o_orderstatus") == "F", 0.35, 0.55)
    line = search.evidence_line(F.lit("READS"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50), F.when(F.col("o_orderkey") % 5 == 0, F.lit("EXACT")))
    return o.select("o_orderkey", plan["structural"].alias("structural"), plan["evidence"].alias("evidence"), line.alias("line"))


def artifact_scores(spark, d):
    """AG14, SF27: quality and kind of artifacts made of parts."""
    files = F.array(F.concat(F.lit("README"), F.col("p_size").cast("string")), F.when(F.col("p_size") % 2 == 0, F.lit("my-Sample.txt")).otherwise(F.lit("x")), F.when(F.col("p_size") % 3 == 0, F.lit("License")).otherwise(F.lit("y")))
    k = search.artifact_kind(F.when(F.col("p_partkey") % 5 == 0, F.lit("Skill")).otherwise(F.lit("Unknown")), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " with MCP").when(F.col("p_partkey") % 3 == 0, " agent").otherwise("")))
    return table(spark, d, "part").select("p_partkey", search.artifact_score(F.col("p_partkey") % 4 > 0, F.slice(files, F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1), F.lit(3))).alias("score"), k["kind"].alias("kind"), k["confidence"].alias("confidence"))


QUERIES = {f.__name__: f for f in (path_forms, object_names, reference_forms, connection_parts, plugin_targets, text_forms, masked_settings, asset_kinds, search_clauses, query_plan, split_words, name_boosts, budget_plans, artifact_scores)}

_TOK = r"'[\p{L}\p{N}_./:-]{2,}'"
_CONTROL = r"""'([+!(){}\[\]^"~*?:/|&-])'"""
_FIRSTS = "list_filter({w}, lambda x, i: NOT list_contains(list_transform(list_slice({w}, 1, i - 1), lambda y: lower(y)), lower(x)))"
_QUESTION = "text || ' BondTradeService' || (item_id % 7) || ' in menu ' || (item_id * 37 + 100) || ' of user_Login.Controller'"

ORACLE = {
    "path_forms": r"""WITH p AS (SELECT page_id, 'C:\Src\' || replace(url, '/', '\') || '.Min.JS\' AS p, 'c:/src/' || url || '/x.' || (page_id % 3) || 'TXT' AS f, replace(url, '\', '/') AS u FROM pages)
SELECT page_id, upper('C:/Src/' || u || '.Min.JS') AS normal, u || '.Min.JS/' AS below, 'x.' || (page_id % 3) || 'TXT' AS file, 'x' AS stem, '.' || (page_id % 3) || 'txt' AS ext FROM p""",
    "object_names": "SELECT n_nationkey, lower(n_name) AS plain, CASE WHEN n_nationkey % 3 = 0 THEN 'dbo' ELSE r_name END AS space, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "reference_forms": r"SELECT page_id, CASE page_id % 3 WHEN 1 THEN regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', ''), '^[~/]+', '') ELSE regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '^[~/]+', '') END AS reference FROM pages",
    "connection_parts": "SELECT s_suppkey, s_name AS name, 3 AS n, 'h' || s_nationkey AS host, 'db&' || s_suppkey AS database, NULL AS missing FROM supplier",
    "plugin_targets": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS assembly, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 0 THEN '' ELSE p_name || '/x' END AS class_name, p_partkey % 4 = 0 AS broken FROM part",
    "text_forms": r"""WITH c AS (SELECT *, text || chr(13) || chr(10) || 'it''s a \ ' AS t FROM conversations)
SELECT conv_id, turn, role, sha256(CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END) AS cut, sha256(trim(regexp_replace(t, '[\r\n]+', ' ', 'g'))) AS line, sha256(replace(replace(t, '\', '\\'), '''', '\''')) AS literal, try_cast(left(regexp_replace(text, '[^0-9]', '', 'g'), 4) AS INTEGER) AS number, turn + 1 AS ordinal FROM c""",
    "masked_settings": "SELECT event_id, CASE WHEN props IS NOT NULL THEN 'REPLACE_WITH_YOUR_API_KEY' END AS api_key, event_type AS host, CASE WHEN event_id % 2 = 0 AND props IS NOT NULL THEN 'REPLACE_WITH_YOUR_API_KEY' END AS password FROM events",
    "asset_kinds": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') || (['/app.bundle.js', '/dist/a.ts', '/Page.ASPX', '/x.cs', '/vite.config.ts', '/lib/q.min.js', '/read.me'])[page_id % 7 + 1] AS p FROM pages)
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'bundle' WHEN 1 THEN 'bundle' WHEN 2 THEN 'page' WHEN 3 THEN 'source' WHEN 4 THEN 'config' WHEN 5 THEN 'bundle' END AS kind,
regexp_matches(lower(p), '(^|/)(node_modules|bower_components|vendor|packages|lib|libs)/') OR page_id % 7 = 5 AS library, regexp_matches(p, '(?i)^(/|~/|https?://)|(/|\\)(api|ajax|service|controller|data)(/|\\)|/([A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+$') AS endpoint FROM p""",
    "search_clauses": f"""WITH w AS (SELECT item_id, text, list_filter(regexp_extract_all(text || ' a/b:c x*y', {_TOK}), lambda x: length(x) <= 100) AS w0 FROM benchmark),
t AS (SELECT item_id, text, list_transform(list_slice({_FIRSTS.format(w="w0")}, 1, 12), lambda x: regexp_replace(x, {_CONTROL}, '\\\\\\1', 'g')) AS t FROM w),
n AS (SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, {_TOK}), lambda x: length(x) <= 100), ' ') AS n FROM benchmark)
SELECT item_id, array_to_string(list_concat(CASE WHEN len(t) > 1 THEN ['"' || array_to_string(t, ' ') || '"'] ELSE [] END, flatten(list_transform(t, lambda x: ['"' || x || '"', x || '*']))), ' OR ') AS clauses, CASE WHEN length(n) BETWEEN 2 AND 100 THEN n END AS normal FROM t JOIN n USING (item_id)""",
    "split_words": "SELECT p_partkey, 'HTTP Server Brand ' || CASE WHEN length(regexp_replace(p_brand, '[^0-9]', '', 'g')) >= 2 THEN regexp_replace(p_brand, '[^0-9]', '', 'g') || ' ' ELSE '' END || CASE WHEN p_size >= 10 AND NOT (regexp_replace(p_brand, '[^0-9]', '', 'g') = p_size::VARCHAR) THEN p_size || ' ' ELSE '' END || 'get' AS words FROM part",
    "budget_plans": "SELECT o_orderkey, greatest(p - e, 0)::INTEGER AS structural, greatest(e, 0)::INTEGER AS evidence, CASE WHEN o_orderkey % 3 > 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 50 > 0) OR o_orderkey % 5 = 0 THEN 'READS；' || coalesce(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 50 > 0 THEN coalesce(loc, 'source') || ':' || (o_orderkey % 50) ELSE loc END, 'extractor') || CASE WHEN o_orderkey % 5 = 0 THEN '；EXACT' ELSE '' END END AS line FROM (SELECT *, trunc(o_totalprice)::INTEGER AS p, trunc(trunc(o_totalprice)::INTEGER * CASE WHEN o_orderstatus = 'F' THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END)::INTEGER AS e, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS loc FROM orders)",
    "artifact_scores": "SELECT p_partkey, (CASE WHEN p_partkey % 4 > 0 THEN 50 ELSE 5 END + CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 15 END + 7.5 + CASE WHEN p_size % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 10 ELSE 4 END)::DOUBLE AS score, CASE WHEN p_partkey % 5 = 0 THEN 'Skill' WHEN p_partkey % 2 = 0 THEN 'McpServer' WHEN p_partkey % 3 = 0 THEN 'Skill' ELSE 'Unknown' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'Declared' WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'Inferred' ELSE 'Unknown' END AS confidence FROM part",
    "name_boosts": f"""WITH {GRAPH} SELECT id, CASE WHEN lower(name) = 'large-widget' THEN 400 WHEN regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') = 'largewidget' THEN 300 WHEN contains(lower(name), 'large-widget') THEN 100 ELSE 0 END AS exact,
CASE WHEN lower(name) = 'large-widget' THEN 1000 WHEN regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') = 'largewidget' THEN 900 WHEN contains(lower(name), 'large-widget') THEN 500 ELSE 0 END AS graph,
CASE kind WHEN 'MenuItem' THEN 10 WHEN 'Database' THEN 8 WHEN 'Method' THEN 8 ELSE 0 END AS intent, CASE kind WHEN 'MenuItem' THEN 'MenuFeature' WHEN 'ApiEndpoint' THEN 'WebRoute' WHEN 'Type' THEN 'Controller' ELSE '' END AS role, CASE WHEN kind = 'Method' OR trim(name) = '' THEN id ELSE name END AS shown FROM nodes""",
    "query_plan": f"""WITH q AS (SELECT item_id, {_QUESTION} AS text FROM benchmark),
tok AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT item_id, list_transform(regexp_extract_all(text, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z_][A-Za-z0-9_./:-]{{2,}})', 2), lambda x: x) AS t FROM q)),
num AS (SELECT item_id, unnest(t) AS number, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(text, '(^|[^0-9])([0-9]{{3,12}})', 2) AS t FROM q)),
wd AS (SELECT item_id, token, pos, list_filter(regexp_extract_all(regexp_replace(token, '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: length(x) >= 2) AS w FROM tok),
wd2 AS (SELECT item_id, token, pos, list_filter(w, lambda x, i: NOT list_contains(list_slice(w, 1, i - 1), x)) AS w FROM wd),
al AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _ALIASES)}) t(term, alias)),
ht AS (SELECT DISTINCT item_id, term FROM q, al WHERE contains(lower(text), lower(term)) OR contains(lower(text), lower(alias))),
seg AS (SELECT item_id, pos, unnest(s) AS query, generate_subscripts(s, 1) - 1 AS n FROM (SELECT item_id, pos, list_slice(list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({list(search.GENERIC)}, lower(x))), 1, 4) AS s FROM wd2 WHERE len(w) > 1)),
every AS (
  SELECT item_id, 'question' AS channel, 70 AS priority, 0 AS n, 0 AS pos, rtrim(left(array_to_string(list_filter(regexp_extract_all(text, {_TOK}), lambda x: length(x) <= 100), ' '), 100)) AS query FROM q
  UNION ALL SELECT item_id, 'identifier', 100, 1, pos, number FROM num UNION ALL SELECT item_id, 'token', 90, 2, pos, token FROM tok
  UNION ALL SELECT item_id, 'phrase', 85, 3, pos, array_to_string(w, ' ') FROM wd2 WHERE len(w) > 1 UNION ALL SELECT item_id, 'segment', 80, 4, pos * 4 + n, query FROM seg
  UNION ALL SELECT item_id, 'term', 60, 5, 0, term FROM ht UNION ALL SELECT item_id, 'alias', 50, 6, 0, alias FROM ht JOIN al USING (term)
), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(query) ORDER BY n, pos) AS k FROM every WHERE query <> '') WHERE k = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, lower(query)) AS r FROM one),
own AS (SELECT item_id, max(r) FILTER (channel = 'question') AS own FROM ranked GROUP BY item_id)
SELECT item_id, least(r, 10)::INTEGER AS place, query, channel, priority FROM ranked JOIN own USING (item_id) WHERE (r < 10) OR (r = 10 AND coalesce(own, 0) <= 10) OR (channel = 'question' AND r > 10)""",
}
