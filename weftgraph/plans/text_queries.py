"""Text search, ranking, budget and extraction queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import paths, strings
from ..operators import joins, merge, text
from ..storage import listing, scratch_dir
from .graph_queries import table

TERMS = ["the", "erhe", "de"]


_indexes: dict[tuple[str, str, str, str], text.TextIndex | text.TrigramIndex] = {}


def _indexed(spark, d, kind):
    """The application's index of the documents, built by its first query in the shared folder."""
    key = (spark.sparkContext.applicationId, d, kind.__name__, listing(spark, d))
    if key not in _indexes:
        _indexes[key] = kind(spark, f"{scratch_dir(spark)}/{key[0]}/{key[2]}-{uuid.uuid4().hex}").build(table(spark, d, "documents"), "doc_id", F.col("text"))
    return _indexes[key]


def bm25_search(spark, d):
    hits = _indexed(spark, d, text.TextIndex).search(TERMS)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def search_diversify(spark, d):
    docs = table(spark, d, "documents")
    hits = _indexed(spark, d, text.TextIndex).search(TERMS).withColumn("score", F.round("score", 6)).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    return text.diversify(hits, "lang", 100).select(F.col("id").alias("doc_id"), "lang", "turn")


def exact_name_boost(spark, d):
    low = F.lower("p_name")
    boost = F.when(low == "part 1", 400).when(F.regexp_replace(low, "[^a-z0-9]", "") == "part1", 300).when(F.contains(low, F.lit("part 1")), 100).otherwise(0)
    return table(spark, d, "part").select("p_partkey", boost.alias("boost"))


def query_plan_tokens(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))).alias("pos", "token")).where("length(token) <= 100")
    first = q.groupBy("item_id", F.lower("token").alias("term")).agg(F.min("pos").alias("pos"))
    return first.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy("pos"))).where("k <= 10").select("item_id", "k", "term")


def trigram_candidates(spark, d):
    return _indexed(spark, d, text.TrigramIndex).candidates("License, Version").select(F.col("path").alias("doc_id"))


def trigram_unindexed(spark, d):
    """FT12, FT13: as trigram_candidates, over an index that takes texts of 2,000 bytes at most; longer ones are candidates too."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/TrigramIndex-{uuid.uuid4().hex}"
    index = text.TrigramIndex(spark, path).build(table(spark, d, "documents"), "doc_id", F.col("text"), 2000)
    return index.candidates("License, Version").select(F.col("path").alias("doc_id"))


def text_line_search(spark, d):
    return text.search_lines(table(spark, d, "documents"), "doc_id", F.col("text"), "licensed under", 1001)


def budget_prefix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return text.budget_prefix(rows, ["source"], [F.col("doc_id")], F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)), 12000).select("doc_id", "source", "used")


def evidence_roundrobin(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    rows = text.first_group_rows(docs.join(docs.groupBy("source").agg(F.min("doc_id").alias("first")), "source"), "source", [F.col("doc_id")], 200)
    return merge.round_robin(rows, "source", [F.col("doc_id")], [F.col("first")]).limit(200).select("doc_id", "source", "turn")


def _host(c):
    return F.regexp_extract(c, r"^https?://([^/]+)", 1)


def longest_prefix_join(spark, d):
    """Each page with the longest of its own path prefixes that is a known root: prefixes explode, then an equi-join."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("path"))
    roots = pages.select(F.regexp_extract("path", r"^([^/]+)", 1).alias("root")).union(pages.select(F.regexp_extract("path", r"^([^/]+/[^/]+)", 1))).where("root <> ''").distinct()
    parts = F.split("path", "/")
    prefixes = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return prefixes.join(roots, "root").groupBy("page_id").agg(F.max_by("root", F.length("root")).alias("root"))


def suffix_lookup(spark, d):
    """Each page's last path segment with the shortest url that ends in it."""
    pages = table(spark, d, "pages").select("url", F.regexp_extract("url", r"([^/]+)/?$", 1).alias("last")).where("last <> ''")
    return pages.groupBy("last").agg(F.min(F.struct(F.length("url"), "url")).getField("url").alias("url"))


def cross_contains(spark, d):
    """JN16: words and the names that contain them, by their first characters: no pair is made that doesn't share these."""
    r = table(spark, d, "region").select("r_regionkey", F.left("r_name", F.lit(1)).alias("w")).unionByName(table(spark, d, "part").groupBy(F.substring_index("p_name", " ", -1).alias("w")).agg((-F.min("p_partkey")).cast("int").alias("r_regionkey")))
    return joins.containing(table(spark, d, "part"), "p_partkey", "p_name", r, "r_regionkey", "w")


def link_classify(spark, d):
    u = table(spark, d, "pages").select("page_id", "url").withColumn("link", F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", r"^https?:/", "")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/CustomReport/MenuIndex/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("->"), "url")).otherwise(F.col("url")))
    return u.select("page_id", strings.normalize_link(F.col("link")).alias("link"), strings.classify_link(F.col("link")).alias("kind"))


def script_tag_scan(spark, d):
    """SF12: the script tags of pages that have a source, and the normalised paths that they name."""
    page = F.concat("html", F.lit("<script src='/js/a"), F.col("page_id").cast("string"), F.lit(".js?v=2'></script><SCRIPT async src = \"http://x.org/b.ts\">"))
    tags = strings.script_tags(page)
    return table(spark, d, "pages").select("page_id", F.size(tags).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(tags, strings.script_paths)), paths.normalize_reference))), " ").alias("links"))


def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(strings.redact_secrets(F.col("text")), 256).alias("digest"))


def identifier_extract_merge(spark, d):
    codes = table(spark, d, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{4})\b"), F.lit(1))).alias("code"))
    best = codes.groupBy("code").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return best.select("code", "n", "first_doc", F.round(F.least(F.lit(0.99), 0.7 + 0.03 * (F.col("n") - 1)), 6).alias("confidence"), (F.col("n") >= 2).alias("confirmed"))


def category_classify(spark, d):
    text_ = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(strings.categories(F.concat(text_, F.when(F.col("p_partkey") % 3 == 0, " sql api test").when(F.col("p_partkey") % 3 == 1, " agent chat").otherwise(""))), ",").alias("categories"))


QUERIES = {f.__name__: f for f in (bm25_search, search_diversify, exact_name_boost, query_plan_tokens, trigram_candidates, trigram_unindexed, text_line_search, budget_prefix, evidence_roundrobin, longest_prefix_join, suffix_lookup, cross_contains, link_classify, script_tag_scan, redact_secrets, identifier_extract_merge, category_classify)}

_TOK = r"'[\p{L}\p{N}_./:-]{2,}'"
_BM25 = f"""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), {_TOK}) AS w FROM documents),
h AS (SELECT doc_id, lang, len(w) AS len, {", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(TERMS))} FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {", ".join(f"count(*) FILTER (t{i} > 0)::DOUBLE AS d{i}" for i in range(3))} FROM h),
hits AS (SELECT doc_id, lang, round({" + ".join(f"ln(1.0 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(3))}, 6) AS score FROM h, s WHERE {" OR ".join(f"t{i} > 0" for i in range(3))})
"""
_CATS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in strings.CATEGORIES) + "], lambda x: x IS NOT NULL)"

ORACLE = {
    "bm25_search": _BM25 + "SELECT doc_id, score FROM hits",
    "search_diversify": _BM25 + ", r AS (SELECT *, max(score) OVER (PARTITION BY lang) AS best, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS turn FROM hits) SELECT doc_id, lang, turn FROM r ORDER BY turn, best DESC, lang LIMIT 100",
    "exact_name_boost": "SELECT p_partkey, CASE WHEN lower(p_name) = 'part 1' THEN 400 WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = 'part1' THEN 300 WHEN contains(lower(p_name), 'part 1') THEN 100 ELSE 0 END AS boost FROM part",
    "query_plan_tokens": f"WITH q AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, {_TOK}) AS w FROM benchmark)), f AS (SELECT item_id, lower(token) AS term, min(pos) AS pos FROM q WHERE length(token) <= 100 GROUP BY ALL) SELECT item_id, k, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k FROM f) WHERE k <= 10",
    "trigram_candidates": "SELECT doc_id FROM documents WHERE " + " AND ".join(f"contains(upper(text), '{g}')" for g in sorted({"LICENSE, VERSION"[i : i + 3] for i in range(14)})) + " OR text IS NULL",
    "trigram_unindexed": "SELECT doc_id FROM documents WHERE text IS NULL OR strlen(text) > 2000 OR (" + " AND ".join(f"contains(upper(text), '{g}')" for g in sorted({"LICENSE, VERSION"[i : i + 3] for i in range(14)})) + ")",
    "text_line_search": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line, instr(upper(row), 'LICENSED UNDER') AS \"column\", left(row, 500) AS preview FROM l WHERE instr(upper(row), 'LICENSED UNDER') > 0 ORDER BY doc_id, line LIMIT 1001",
    "budget_prefix": "WITH r AS (SELECT doc_id, source, sum(greatest(1, n_chars // 4)) OVER w AS used, row_number() OVER w AS k FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT doc_id, source, used::BIGINT AS used FROM r WHERE used <= 12000 OR k = 1",
    "evidence_roundrobin": "WITH r AS (SELECT doc_id, coalesce(source, '') AS source, min(doc_id) OVER (PARTITION BY source) AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, f LIMIT 200",
    "longest_prefix_join": r"WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), r AS (SELECT DISTINCT root FROM (SELECT regexp_extract(path, '^([^/]+)', 1) AS root FROM p UNION ALL SELECT regexp_extract(path, '^([^/]+/[^/]+)', 1) FROM p) WHERE root <> '') SELECT page_id, arg_max(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id",
    "suffix_lookup": r"WITH p AS (SELECT url, regexp_extract(url, '([^/]+)/?$', 1) AS last FROM pages) SELECT last, arg_min(url, (length(url), url)) AS url FROM p WHERE last <> '' GROUP BY last",
    "cross_contains": "WITH w AS (SELECT r_regionkey, lower(left(r_name, 1)) AS w FROM region UNION ALL SELECT -min(p_partkey), lower(string_split(p_name, ' ')[-1]) FROM part GROUP BY string_split(p_name, ' ')[-1]) SELECT p_partkey, r_regionkey FROM part, w WHERE contains(lower(p_name), w)",
    "link_classify": r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?:/', '') WHEN 1 THEN '/CustomReport/MenuIndex/' || page_id WHEN 2 THEN '->' || url ELSE url END AS link FROM pages),
n AS (SELECT page_id, link, rtrim(regexp_replace(replace(trim(link), '\', '/'), '([^:/]|^)/{2,}', '\1/', 'g'), '/') AS s FROM u)
SELECT page_id, CASE WHEN starts_with(s, '/') OR starts_with(s, '->') THEN s ELSE '/' || s END AS link,
CASE WHEN starts_with(link, '->') THEN 'Redirect' WHEN starts_with(lower(link), '/pluginreport/menuindex/') THEN 'PluginReport' WHEN starts_with(lower(link), '/customreport/menuindex/') THEN 'CustomReport' WHEN starts_with(lower(link), 'http://') OR starts_with(lower(link), 'https://') THEN 'AbsoluteUrl' WHEN starts_with(lower(link), 'javascript:') THEN 'JavaScript' ELSE 'MVC' END AS kind FROM n""",
    "script_tag_scan": r"""WITH t AS (SELECT page_id, regexp_extract_all(html || '<script src=''/js/a' || page_id || '.js?v=2''></script><SCRIPT async src = "http://x.org/b.ts">', '(?i)<script\b[^>]*\bsrc\s*=[^>]*>') AS t FROM pages),
p AS (SELECT page_id, len(t) AS n, flatten(list_transform(t, lambda x: regexp_extract_all(x, '(?i)["''](https?://[^"'']+|[^"'']+\.(?:js|jsx|ts|tsx)(?:\?[^"'']*)?)["'']', 1))) AS l FROM t)
SELECT page_id, n::BIGINT AS n, array_to_string(list_sort(list_distinct(list_transform(l, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[?#].*$', ''), '(?i)^https?://[^/]+', ''), '^[~/]+', '')))), ' ') AS links FROM p""",
    "redact_secrets": f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{strings.BEARER}', '\\1[REDACTED]', 'g'), '{strings.JSON_SECRET}', '\\1[REDACTED]\\2', 'g'), '{strings.URL_CREDENTIAL}', '\\1[REDACTED]@', 'g')) AS digest FROM documents""",
    "identifier_extract_merge": r"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([0-9]{4})\b', 1)) AS code FROM documents), b AS (SELECT code, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY code) SELECT code, n, first_doc, round(least(0.99, 0.7 + 0.03 * (n - 1)), 6)::DOUBLE AS confidence, n >= 2 AS confirmed FROM b",
    "category_classify": f"WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' sql api test' WHEN 1 THEN ' agent chat' ELSE '' END) AS t FROM part), c AS (SELECT p_partkey, {_CATS} AS c FROM p) SELECT p_partkey, CASE WHEN len(c) = 0 THEN 'other' ELSE array_to_string(c[1:4], ',') END AS categories FROM c",
}
