"""Issue queries: orders and conversations stand for issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import issues
from .graph_queries import GRAPH, derive, table


def _json():
    k, n = F.col("o_orderkey"), lambda m: F.col("o_orderkey") % m
    part = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"key":"HD-'), k.cast("string"), F.lit('","fields":{"summary":"s '), F.col("o_orderpriority"), F.lit('","status":{"name":"'), F.col("o_orderstatus"), F.lit('"},"project":{"key":"P","name":"n"},"components":[{"name":"c'), n(3).cast("string"), F.lit('"},{"name":""},{}],'),
        part(n(2) == 0, F.lit('"priority":null,"assignee":{"displayName":"a"},')), F.lit('"cf1":'), F.when(n(4) == 0, F.lit("true")).when(n(4) == 1, F.lit("12.5")).when(n(4) == 2, F.lit('[{"value":"x"},{"name":"y"},"z",""]')).otherwise(F.lit('{"name":"w"}')), F.lit(',"cf2":'), F.when(n(3) == 0, F.lit("null")).otherwise(F.lit('"te\\"xt"')),
        F.lit(',"issuelinks":[{"type":{"name":"Blocks"},"inwardIssue":{"key":"K'), n(5).cast("string"), F.lit('","fields":{"summary":"q"}}},{"type":{"name":"T"}},{"type":{"name":"R"},"outwardIssue":{"key":"O"}}],"attachment":[{"filename":"f.txt","size":3},{"filename":""}]}}'),
    )


def issue_records(spark, d):
    """SF14, SF15: issues from their JSON; every ninth is broken."""
    o = table(spark, d, "orders").select(F.lit("asked").alias("asked"), F.when(F.col("o_orderkey") % 9 == 0, F.lit('{"key":1')).otherwise(_json()).alias("json"))
    r = issues.records(o, "json", "asked", {"cf1": "first", "cf2": "second", "cf3": "third"})
    return r.select("key", "summary", "status", "type", "priority", "assignee", "project", "components", "links", "attachments", F.try_element_at("fields", F.lit("first")).alias("first"), F.try_element_at("fields", F.lit("second")).alias("second"), F.size("fields").alias("n"))


def wiki_to_markdown(spark, d):
    """SF16: conversations' texts with markup put around their words."""
    c = table(spark, d, "conversations")
    body = F.concat(F.lit("h2. Title "), "role", F.lit("\n* one\n** two _it_\n# num\n||a||b||\n|x|*y*|\n[x|http://y] and [http://z] !p.png|w! {{m}} -gone- +u+\n{quote}"), F.coalesce("text", F.lit("")), F.lit("\nmore{quote}\n{code:sql}\nselect 1\n{code}{color:red}red{color}\n{panel:title=T}in\nside{panel}\n{info}  tip {info}"))
    return c.select("conv_id", "turn", "role", markup.wiki_to_markdown(body).alias("body"))


def _texts(spark, d):
    o = table(spark, d, "orders")
    code = (F.col("o_orderkey") % 5000 + 900).cast("string")
    source = F.element_at(F.array(*map(F.lit, issues.SOURCES)), (F.col("o_orderkey") % len(issues.SOURCES) + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("the menu "), code, F.lit(" - Orders_"), F.col("o_orderstatus"), F.lit(" opens; far away from it all, feature 4711 too, and key ABC-5555"))).otherwise(F.concat(F.lit("報表 "), code, F.lit(" and then in a long way off we see version 7001 of "), F.lit("it on 2024-12-31 with "), code))
    return o.select((F.col("o_custkey") % 40).alias("issue"), "o_orderkey", source.alias("source"), text.alias("text"))


def issue_identifiers(spark, d):
    """SF19, SF20: codes and names in the texts of issues."""
    t = _texts(spark, d)
    return issues.identifiers(t, "o_orderkey", "text", "source").select(F.col("id").alias("o_orderkey"), "source", "at", "code", "name", F.round("confidence", 6).alias("confidence"), "evidence")


def _candidates(spark, d):
    o = table(spark, d, "orders")
    source = F.element_at(F.array(*map(F.lit, issues.SOURCES)), (F.col("o_orderkey") % len(issues.SOURCES) + 1).cast("int"))
    return o.select((F.col("o_custkey") % 30).alias("id"), (F.col("o_orderkey") % 4 + 1000).cast("string").alias("code"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Name-"), "o_orderstatus")).alias("name"), source.alias("source"), (0.5 + F.col("o_orderkey") % 5 * 0.05).alias("confidence"), F.concat(F.lit("Seen in "), "o_orderpriority").alias("evidence"), F.col("o_orderkey").alias("seq"))


def merged_identifiers(spark, d):
    """AG6: candidates of one code and name as one."""
    return issues.merge_identifiers(_candidates(spark, d), "seq")


def issue_searches(spark, d):
    """SF21: the search texts of issues from their summaries and identifiers."""
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" the Bug in -order- 報表 "), "c_name").alias("summary"))
    return issues.issue_queries(i, issues.merge_identifiers(_candidates(spark, d), "seq"))


def feature_searches(spark, d):
    """SF22, SF32, PF12: search texts of features, titles and keys."""
    c = table(spark, d, "customer")
    code, name = F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 4 > 0, F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_mktsegment")))
    key = F.concat(F.when(F.col("c_custkey") % 2 == 0, "HD-").otherwise("XX-"), F.when(F.col("c_custkey") % 7 == 0, "0").otherwise(""), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", F.array_join(issues.feature_queries(code, name), ";").alias("queries"), issues.conversation_title(key, F.concat("c_name", F.lit(" "), "c_mktsegment"), 40).alias("title"), issues.valid_key(key, "", ("HD", "NR")).alias("valid"))


def hit_statuses(spark, d):
    """SF23, SF24, PF13, JN24: nodes as hits: their status, order and tokens; those without an entry point's priority are marked."""
    n = derive(spark, d)[0].where("kind in ('ApiEndpoint', 'Type', 'Database', 'Namespace')")
    score = F.length("id") % 10 / 10.0
    return n.select("id", issues.hit_status(score, F.length("name") % 2 == 0, F.col("kind"), F.col("name"), F.lit("0000005"), F.lit("RED")).alias("status"), issues.entry_priority(F.col("kind")).alias("priority"), issues.hit_tokens(F.col("name"), F.col("id"), F.lit(None).cast("string")).alias("tokens"))


QUERIES = {f.__name__: f for f in (issue_records, wiki_to_markdown, issue_identifiers, merged_identifiers, issue_searches, feature_searches, hit_statuses)}

_SRC = "[" + ", ".join(f"'{s}'" for s in issues.SOURCES) + "]"
_MERGED = f"""cand AS (SELECT o_custkey % 30 AS id, (o_orderkey % 4 + 1000)::VARCHAR AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'Name-' || o_orderstatus END AS name, ({_SRC})[o_orderkey % {len(issues.SOURCES)} + 1] AS source, 0.5::DOUBLE + (o_orderkey % 5) * 0.05::DOUBLE AS confidence, 'Seen in ' || o_orderpriority AS evidence, o_orderkey AS seq FROM orders),
ky AS (SELECT *, lower(coalesce(code, '') || '|' || coalesce(name, '')) AS k FROM cand),
bs AS (SELECT id, k, count(*) AS n, arg_min({{'code': code, 'name': name, 'source': source, 'confidence': confidence}}, (-confidence, list_position({_SRC}, source), seq)) AS b FROM ky GROUP BY id, k),
ef AS (SELECT id, k, arg_min(evidence, seq) AS evidence, min(seq) AS o FROM ky GROUP BY id, k, lower(evidence)), e3 AS (SELECT id, k, string_agg(evidence, ' | ' ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY o, lower(evidence)) AS r FROM ef) WHERE r <= 3 GROUP BY id, k),
mi AS (SELECT id, b.code AS code, b.name AS name, b.source AS source, round(greatest(0.0::DOUBLE, least(0.99::DOUBLE, b.confidence + (n - 1) * 0.03::DOUBLE)), 6) AS confidence, n, evidence FROM bs JOIN e3 USING (id, k)),
mg AS (SELECT *, confidence >= 0.78 OR n >= 2 AS confirmed FROM mi)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in issues.STOP_WORDS) + "]"
_TOKENS = "list_filter(list_transform(string_split(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g'), ' '), lambda w: lower(regexp_replace(w, '^[-_]+|[-_]+$', '', 'g'))), lambda w: length(w) >= 2 AND NOT list_contains(" + _STOP + ", w))"
_ONCE = "list_filter({w}, lambda x, i: NOT list_contains(list_slice({w}, 1, i - 1), x))"
_CUT = "CASE WHEN length({t}) <= {n} THEN {t} WHEN instr(left({t}, {n}), ' ') > 1 THEN regexp_replace(left({t}, {n}), ' [^ ]*$', '') ELSE left({t}, {n}) END"

ORACLE = {
    "issue_records": """SELECT 'HD-' || o_orderkey AS key, 's ' || o_orderpriority AS summary, o_orderstatus AS status, '' AS type, NULL AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 'a' END AS assignee, 'P' AS project, 'c' || o_orderkey % 3 AS components, 'K' || o_orderkey % 5 || ' Blocks (inward), O R (outward)' AS links, 'f.txt' AS attachments,
CASE o_orderkey % 4 WHEN 0 THEN '是' WHEN 1 THEN '12.5' WHEN 2 THEN 'x, y, z' ELSE 'w' END AS first, CASE WHEN o_orderkey % 3 > 0 THEN 'te"xt' END AS second, CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderkey % 9 <> 0""",
    "merged_identifiers": f"WITH {_MERGED} SELECT * FROM mg",
    "issue_searches": f"""WITH {_MERGED}, iss AS (SELECT c_custkey AS id, c_mktsegment || ' the Bug in -order- 報表 ' || c_name AS summary FROM customer),
tp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, n DESC, coalesce(code, ''), coalesce(name, '')) AS r FROM mg WHERE confirmed OR confidence >= 0.72), t6 AS (SELECT * FROM tp WHERE r <= 6),
cd AS (SELECT id, list(code ORDER BY r) AS c, list(lower(name) ORDER BY r) FILTER (name IS NOT NULL) AS nm, flatten(list({_TOKENS.format(t="evidence")} ORDER BY r)) AS ev FROM t6 GROUP BY id),
cl AS (SELECT iss.id, summary, {_ONCE.format(w="coalesce(c, [])")} AS c, {_ONCE.format(w="coalesce(nm, [])")} AS nm, list_slice({_ONCE.format(w="coalesce(ev, [])")}, 1, 6) AS ev, {_TOKENS.format(t="summary")} AS sw FROM iss LEFT JOIN cd ON cd.id = iss.id),
dl AS (SELECT *, list_slice({_ONCE.format(w="sw")}, 1, 10) AS su FROM cl),
ln AS (SELECT id, array_to_string(list_filter([array_to_string(c, ' '), array_to_string(nm, ' '), array_to_string(su, ' '), array_to_string(ev, ' '), 'ControllerAction Handles RoutesTo'], lambda x: x <> ''), ' ') AS l, array_to_string(list_filter([array_to_string(su, ' '), array_to_string(list_slice(nm, 1, 4), ' '), 'impact root-cause dependency risk'], lambda x: x <> ''), ' ') AS g FROM dl)
SELECT id, {_CUT.format(t="l", n=220)} AS "local", {_CUT.format(t="g", n=180)} AS "global" FROM ln""",
    "feature_searches": """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::VARCHAR END AS code, CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE c_mktsegment END END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'HD-' ELSE 'XX-' END || CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE '' END || c_custkey AS key FROM customer),
t AS (SELECT *, '[JIRA] ' || key || ' ' || c_name || ' ' || c_mktsegment AS whole FROM c)
SELECT c_custkey, concat_ws(';', code || '-' || name, code || ' ' || name, code, CASE WHEN name = code THEN NULL ELSE name END, name || ' Controller') AS queries, CASE WHEN length(whole) <= 40 THEN whole ELSE '[JIRA] ' || key || ' ' || left(c_name || ' ' || c_mktsegment, greatest(0, 32 - length(key))) || '…' END AS title, c_custkey % 2 = 0 AND c_custkey % 7 > 0 AS valid FROM t""",
    "hit_statuses": f"WITH {GRAPH}, n AS (SELECT *, length(id) % 10 / 10.0 AS score FROM nodes WHERE kind IN ('ApiEndpoint', 'Type', 'Database', 'Namespace')) SELECT id, CASE WHEN score >= 0.5 AND (contains(lower(name), '0000005') OR contains(lower(name), 'red') OR (length(name) % 2 = 0 AND score >= 0.7 AND kind = 'ApiEndpoint')) THEN 'Confirmed' ELSE 'Candidate' END AS status, CASE kind WHEN 'ApiEndpoint' THEN 4 WHEN 'Type' THEN 3 WHEN 'Database' THEN 1 ELSE 2 END AS priority, ((length(name) + length(id) + 40) // 4)::INTEGER AS tokens FROM n",
}
