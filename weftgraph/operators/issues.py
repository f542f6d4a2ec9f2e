"""Issues: records from their JSON, identifiers in their texts, queries from both, and what a search confirms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.search import first_of_each

SCHEMA = "key string, fields struct<summary:string,status:struct<name:string>,issuetype:struct<name:string>,priority:struct<name:string>,assignee:struct<displayName:string>,updated:string,project:struct<key:string,name:string>,description:string,components:array<struct<name:string>>,issuelinks:array<struct<type:struct<name:string>,inwardIssue:struct<key:string,fields:struct<summary:string>>,outwardIssue:struct<key:string,fields:struct<summary:string>>>>,attachment:array<struct<filename:string,mimeType:string,size:bigint>>>"


def flat_value(value: Column) -> Column:
    """A variant as text: booleans as 是 and 否, an object's value or name, an array's entries joined by commas, blanks left out."""
    kind, json = F.schema_of_variant(value), F.to_json(value)
    of = lambda j: F.coalesce(F.get_json_object(j, "$.value"), F.get_json_object(j, "$.name"), F.lit(""))
    items = F.transform(F.from_json(json, "array<string>"), lambda x: F.when(F.startswith(x, F.lit("{")), of(x)).otherwise(x))
    return (
        F.when(kind == "BOOLEAN", F.when(json == "true", "是").otherwise("否"))
        .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(F.filter(items, lambda x: F.trim(x) != ""), ", "))
        .when(F.startswith(kind, F.lit("OBJECT")), of(json))
        .when(kind == "STRING", F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>")[0])
        .when(kind != "VOID", json)
    )


def records(issues: DataFrame, json_col: str, key_col: str, fields: dict[str, str]) -> DataFrame:
    """(key, summary, status, type, priority, assignee, project, components, links, attachments, fields): a row for each JSON with fields; others go.

    Missing texts are empty, missing people and priorities null. components joins names, links key (kind direction),
    attachments file names; fields maps the named custom fields that aren't blank to their flattened values.
    """
    parsed = issues.withColumn("r", F.from_json(json_col, SCHEMA)).withColumn("v", F.try_parse_json(json_col)).where("r.fields is not null")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda a: F.array_join(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), ", ")
    links = F.transform(
        F.filter("r.fields.issuelinks", lambda x: x["inwardIssue"].isNotNull() | x["outwardIssue"].isNotNull()),
        lambda x: F.concat(F.coalesce(F.coalesce(x["inwardIssue"]["key"], x["outwardIssue"]["key"]), F.lit("")), F.lit(" "), F.coalesce(x["type"]["name"], F.lit("")), F.when(x["inwardIssue"].isNotNull(), " (inward)").otherwise(" (outward)")),
    )
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), flat_value(F.variant_get("v", f"$.fields.{c}", "variant")).alias("value")) for c, name in fields.items()])
    return parsed.select(
        F.coalesce("r.key", key_col).alias("key"), text("r.fields.summary").alias("summary"), text("r.fields.status.name").alias("status"), text("r.fields.issuetype.name").alias("type"), F.col("r.fields.priority.name").alias("priority"), F.col("r.fields.assignee.displayName").alias("assignee"), text("r.fields.project.key").alias("project"),
        joined(F.col("r.fields.components.name")).alias("components"), joined(links).alias("links"), joined(F.col("r.fields.attachment.filename")).alias("attachments"),
        F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(F.trim(p["value"]), F.lit("")) != "")).alias("fields"),
    )


# fixed values: patterns of identifiers, words around them, the weight of each source and its rank
CODE_NAME = r"(?<![A-Za-z0-9])(\d{4,6})\s*[-_－—]\s*([\x{4E00}-\x{9FFF}A-Za-z0-9()/_\-]{2,24})"
CODE_ONLY = r"(?<![A-Za-z0-9])(\d{4,6})(?![A-Za-z0-9])"
ISSUE_KEY = r"\b[A-Z][A-Z0-9]+-\d+\b"
DATE = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
FEATURE_WORDS = ("功能", "作業", "頁", "頁面", "交易", "流程", "維護", "查詢", "報表", "上傳", "下載", "放行", "核准", "申請", "覆核", "轉檔", "批次", "menu", "feature")
OTHER_WORDS = ("jira", "issue", "ticket", "版本", "version", "build", "hotfix", "需求單", "page id", "頁碼", "頁次", "release", "sprint")
SOURCES = {"summary": 0.95, "description": 0.85, "field": 0.72, "component": 0.70, "linked": 0.62, "comment": 0.55, "attachment": 0.40}
WINDOW = 28


def matches(text: Column, pattern: str) -> Column:
    """array of struct(at, value): where (from 0) and what the pattern matches, from the pieces between its matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.array().cast("array<struct<at:int,value:string>>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        return F.struct(F.array_append(s["out"], F.struct(at.cast("int").alias("at"), x["value"].alias("value"))).alias("out"), (at + F.length(x["value"])).cast("int").alias("at"))

    zipped = F.transform(found, lambda v, i: F.struct(F.get(gaps, i).alias("gap"), v.alias("value")))
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def _speaks(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w))
    return hit


def identifiers(texts: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, code, name, confidence, evidence): the feature codes of each text, with a name behind them or alone.

    A code is a number of 1000 to 999999 but no year (1900 to 2100), not in an issue key, and with no word around it
    that speaks of something else, nor a date. With a name it gains 0.15 on its source's weight; alone it
    loses 0.08 and needs a feature word around it. Codes inside a match with a name don't count again.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("t")).where("t is not null")
    rows = rows.withColumns({"keys": matches(F.col("t"), ISSUE_KEY), "pairs": matches(F.col("t"), CODE_NAME)})
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.col("source"))

    def kept(df: DataFrame) -> DataFrame:
        number = F.col("code").cast("int")
        inside = F.exists("keys", lambda k: (F.col("at") >= k["at"]) & (F.col("at") < k["at"] + F.length(k["value"])))
        around = df.withColumn("around", F.substring("t", F.greatest(F.col("at") - WINDOW, F.lit(0)) + 1, F.least(F.col("at"), F.lit(WINDOW)) + F.length("code") + WINDOW))
        return around.where(~number.between(1900, 2100) & number.between(1000, 999999) & ~inside & ~_speaks(F.col("around"), OTHER_WORDS) & ~F.lower("around").rlike(DATE))

    pair = rows.select("*", F.explode("pairs").alias("m")).select("*", F.col("m.at").alias("at"), F.regexp_extract("m.value", CODE_NAME, 1).alias("code"), F.left(F.regexp_replace(F.regexp_extract("m.value", CODE_NAME, 2), r"^[-_.,，。)(\[\]]+|[-_.,，。)(\[\]]+$", ""), F.lit(40)).alias("name"))
    named = kept(pair).where("name <> ''").select("id", "source", "at", "code", "name", F.least(F.lit(0.99), weight + 0.15).alias("confidence"), F.col("m.value").alias("evidence"))
    # only matches that were taken cover the codes inside them
    taken = kept(pair).where("name <> ''").groupBy("id", "source", "t").agg(F.collect_list("m").alias("covered"))
    single = rows.join(taken, ["id", "source", "t"], "left").select("*", F.explode(matches(F.col("t"), CODE_ONLY)).alias("m")).select("*", F.col("m.at").alias("at"), F.col("m.value").alias("code"))
    single = single.where(~F.coalesce(F.exists("covered", lambda k: (F.col("at") >= k["at"]) & (F.col("at") < k["at"] + F.length(k["value"]))), F.lit(False)))
    alone = kept(single).where(_speaks(F.col("around"), FEATURE_WORDS)).select("id", "source", "at", "code", F.lit(None).cast("string").alias("name"), F.greatest(F.lit(0.0), F.least(F.lit(0.85), weight - 0.08)).alias("confidence"), F.col("around").alias("evidence"))
    return named.unionByName(alone)


def merge_identifiers(found: DataFrame, order: str) -> DataFrame:
    """(id, code, name, source, confidence, n, evidence, confirmed): candidates of one code and name, whatever the case, as one.

    The best by confidence and then by source stands; each further one adds 0.03 (0.99 at most). Evidence is the first
    three different ones in order. Confirmed from 0.78 on, or when there are two.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)]), F.col("source"))
    key = F.lower(F.concat_ws("|", F.coalesce("code", F.lit("")), F.coalesce("name", F.lit(""))))
    rows = found.withColumn("_key", key)
    best = rows.groupBy("id", "_key").agg(F.count("*").alias("n"), F.min_by(F.struct("code", "name", "source", "confidence"), F.struct(-F.col("confidence"), rank, order)).alias("b"))
    firsts = rows.groupBy("id", "_key", F.lower("evidence").alias("_e")).agg(F.min_by("evidence", order).alias("evidence"), F.min(order).alias("_o"))
    three = firsts.withColumn("_n", F.row_number().over(W.partitionBy("id", "_key").orderBy("_o", "_e"))).where("_n <= 3")
    said = three.groupBy("id", "_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "evidence"))), lambda x: x["evidence"]), " | ").alias("evidence"))
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("b.confidence") + (F.col("n") - 1) * 0.03)), 6)
    return best.join(said, ["id", "_key"]).select("id", "b.code", "b.name", "b.source", sure.alias("confidence"), "n", "evidence", ((sure >= 0.78) | (F.col("n") >= 2)).alias("confirmed"))


# fixed values: words that say nothing in a query
STOP_WORDS = ("請", "協助", "修正", "問題", "異常", "無法", "發生", "造成", "與", "及", "和", "the", "and", "for", "bug", "jira")


def query_tokens(text: Column) -> Column:
    """Lower-cased words of two characters and more without dashes at their ends, stop words left out, each once."""
    words = F.transform(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_-]+", " "), " "), lambda w: F.lower(F.regexp_replace(w, r"^[-_]+|[-_]+$", "")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def cut_at_word(text: Column, most: int) -> Column:
    """At most `most` characters, cut at the last space within them."""
    cut = F.left(text, F.lit(most))
    return F.when(F.length(text) <= most, text).when(F.instr(cut, " ") > 1, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)


def issue_queries(issues: DataFrame, found: DataFrame) -> DataFrame:
    """(id, local, global): the two search texts of each issue(id, summary) from its merged identifiers.

    Six identifiers by confidence and count; their codes and names, ten words of the summary, six of the evidence.
    """
    sure = found.where(F.col("confirmed") | (F.col("confidence") >= 0.72))
    ranked = sure.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("confidence"), F.desc("n"), F.coalesce("code", F.lit("")), F.coalesce("name", F.lit(""))))).where("_n <= 6")
    best = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_n", "code", "name", "evidence"))).alias("a"))
    some = lambda c, f: first_of_each(F.filter(F.transform("a", lambda x: f(x[c])), lambda x: F.coalesce(x, F.lit("")) != ""))
    clean = lambda x: F.lower(F.regexp_replace(F.trim(x), r"^[-_]+|[-_]+$", ""))
    rows = issues.join(best, "id", "left")
    none = F.array().cast("array<string>")
    codes, names = F.coalesce(some("code", lambda x: x), none), F.coalesce(F.filter(some("name", clean), lambda x: F.length(x) >= 2), none)
    proof = F.coalesce(F.slice(F.array_distinct(F.flatten(F.transform("a", lambda x: query_tokens(F.coalesce(x["evidence"], F.lit("")))))), 1, 6), none)
    words = F.slice(query_tokens(F.coalesce("summary", F.lit(""))), 1, 10)
    line = lambda *parts: F.array_join(F.filter(F.array(*[F.array_join(p, " ") for p in parts[:-1]], F.lit(parts[-1])), lambda x: x != ""), " ")
    return rows.select("id", cut_at_word(line(codes, names, words, proof, "ControllerAction Handles RoutesTo"), 220).alias("local"), cut_at_word(line(words, F.slice(names, 1, 4), "impact root-cause dependency risk"), 180).alias("global"))


def feature_queries(code: Column, name: Column) -> Column:
    """The search texts of one feature: code and name joined, each alone, the name with its controller; blanks and repeats left out."""
    has_code, has_name = F.coalesce(F.trim(code), F.lit("")) != "", F.coalesce(F.trim(name), F.lit("")) != ""
    texts = F.array(F.when(has_code & has_name, F.concat(code, F.lit("-"), name)), F.when(has_code & has_name, F.concat(code, F.lit(" "), name)), F.when(has_code, code), F.when(has_name, name), F.when(has_name, F.concat(name, F.lit(" Controller"))))
    return first_of_each(F.array_compact(texts))


# fixed values: kinds that are entry points
ENTRY_KINDS = ("MenuItem", "ApiEndpoint", "WebFormPage", "View", "ScriptAsset", "Schedule", "ScheduleTaskDefinition")


def entry_priority(kind: Column) -> Column:
    """4 for entry points, 3 for code, 1 for data, 2 for the rest."""
    return F.when(kind.isin(*ENTRY_KINDS), 4).when(kind.isin("Type", "Method", "FrontendComponent", "FrontendFunction"), 3).when(kind.isin("Database", "DatabaseObject", "DatabaseColumn", "StoredProcedureParameter"), 1).otherwise(2)


def hit_status(score: Column, seed: Column, kind: Column, text: Column, code: Column, name: Column, least: float = 0.5, strong: float = 0.7) -> Column:
    """Confirmed if the node's text holds the feature's code or name, or it is a strong seed and an entry point; below `least` a candidate."""
    said = lambda c: F.coalesce(F.contains(F.lower(text), F.lower(c)), F.lit(False))
    sure = said(code) | said(name) | (seed & (score >= strong) & kind.isin(*ENTRY_KINDS))
    return F.when((score >= least) & sure, "Confirmed").otherwise("Candidate")


def hit_tokens(*texts: Column) -> Column:
    """A hit's tokens: a quarter of its characters and of 40 for its fixed fields, 1 at least."""
    total = F.lit(40)
    for t in texts:
        total = total + F.coalesce(F.length(t), F.lit(0))
    return F.greatest(F.lit(1), F.floor(total / 4).cast("int"))


def conversation_title(key: Column, summary: Column, most: int = 60) -> Column:
    """[JIRA] key summary, the summary cut and an ellipsis added where that is too long."""
    whole = F.concat(F.lit("[JIRA] "), key, F.lit(" "), summary)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.lit("[JIRA] "), key, F.lit(" "), F.substring(summary, F.lit(1), F.greatest(F.lit(0), F.lit(most - 8) - F.length(key))), F.lit("…")))


def valid_key(key: Column, prefix: str, projects: tuple[str, ...]) -> Column:
    """Whether a key is the prefix, one of the projects and a number that doesn't begin with 0."""
    return F.coalesce(key.rlike(rf"^{prefix}({'|'.join(projects)})-[1-9][0-9]*$"), F.lit(False))
