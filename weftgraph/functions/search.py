"""Search texts: terms, clauses, query plans, boosts, display names and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.text import TOKEN
from .strings import split_identifier

# fixed values: characters that a search text escapes, identifier patterns, and segments that name no feature
CONTROL = '+-!(){}[]^"~*?:/|&'
NUMBER_ID = r"(?<!\d)\d{3,12}(?!\d)"
TECHNICAL = r"(?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_./:-]{2,}"
GENERIC = ("async", "controller", "entity", "handler", "helper", "manager", "model", "repository", "service", "viewmodel")
# fixed values: the channels of a query plan and their priorities
PRIORITY = {"identifier": 100, "token": 90, "phrase": 85, "segment": 80, "question": 70, "term": 60, "alias": 50}


def first_of_each(words: Column) -> Column:
    """The array without what differs from an earlier entry in case alone."""
    return F.filter(words, lambda x, i: ~F.exists(F.slice(words, 1, i), lambda y: F.lower(y) == F.lower(x)))


def search_terms(text: Column, most: int = 12) -> Column:
    """Distinct tokens of 2 to 100 characters, in order, `most` of them (1 to 20)."""
    words = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) <= 100)
    return F.slice(first_of_each(words), 1, min(20, max(1, most)))


def escape_term(term: Column) -> Column:
    inside = "".join("\\" + c for c in CONTROL)
    return F.regexp_replace(term, f"([{inside}])", r"\\$1")


def search_clauses(text: Column, most: int = 12) -> Column:
    """The whole phrase, then each term as it is and as a beginning, joined by OR; empty without a term."""
    terms = F.transform(search_terms(text, most), escape_term)
    each = F.flatten(F.transform(terms, lambda t: F.array(F.concat(F.lit('"'), t, F.lit('"')), F.concat(t, F.lit("*")))))
    phrase = F.when(F.size(terms) > 1, F.array(F.concat(F.lit('"'), F.array_join(terms, " "), F.lit('"')))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(phrase, each), " OR ")


def normalize_query_text(text: Column) -> Column:
    """The tokens joined by spaces; null where that is not 2 to 100 characters long."""
    joined = F.array_join(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) <= 100), " ")
    return F.when(F.length(joined).between(2, 100), joined)


def query_plan(questions: DataFrame, id_col: str, text_col: str, aliases: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(id, place, query, channel, priority): the search texts of each question, best first, `most` of them (1 to 20).

    Channels: numbers, technical tokens, their words as a phrase and one by one (4 of a token), the question itself,
    and terms of aliases(term, alias) of which the question holds either side. The first of texts that differ in
    case alone stays; the question's own text takes the last place if it isn't among the first `most`.
    """
    most = min(20, max(1, most))
    q = questions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    whole = F.rtrim(F.left(F.array_join(F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) <= 100), " "), F.lit(100)))
    token = q.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(TECHNICAL), F.lit(0))).alias("at", "token")).withColumn("words", split_identifier(F.col("token"))).withColumn("many", F.size("words") > 1)
    row = lambda df, channel, at, text: df.select("id", F.lit(channel).alias("channel"), F.lit(PRIORITY[channel]).alias("priority"), at.cast("long").alias("at"), text.alias("query"))
    number = q.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER_ID), F.lit(0))).alias("at", "number"))
    named = F.slice(F.filter("words", lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*GENERIC)), 1, 4)
    segments = token.where("many").select("id", "at", F.posexplode(named).alias("n", "word"))
    parts = [
        row(q, "question", F.lit(0), whole),
        row(number, "identifier", F.col("at"), F.col("number")),
        row(token, "token", F.col("at"), F.col("token")),
        row(token.where("many"), "phrase", F.col("at"), F.array_join("words", " ")),
        row(segments, "segment", F.col("at") * 4 + F.col("n"), F.col("word")),
    ]
    if aliases is not None:
        # the aliases are a vocabulary of a known bound; the question's text is searched for each side
        low, a = F.lower("text"), F.broadcast(aliases.select("term", "alias"))
        hit = q.join(a, F.contains(low, F.lower("term")) | F.contains(low, F.lower("alias"))).select("id", "term").distinct().join(aliases, "term")
        parts += [row(hit.select("id", "term").distinct(), "term", F.lit(0), F.col("term")), row(hit, "alias", F.lit(0), F.col("alias"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # of equal texts the one added first: the question, then numbers, then tokens with what they are made of
    first = F.struct(F.element_at(F.create_map(*[F.lit(x) for c, n in (("question", 0), ("identifier", 1), ("token", 2), ("phrase", 3), ("segment", 4), ("term", 5), ("alias", 6)) for x in (c, n)]), F.col("channel")).alias("n"), F.col("at"))
    texts = every.where("query <> ''").groupBy("id", F.lower("query").alias("low")).agg(F.min_by(F.struct("query", "channel", "priority"), first).alias("x")).select("id", "low", "x.*")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("priority"), "low"))
    ranked = texts.withColumn("place", place)
    kept = ranked.where((F.col("place") < most) | (F.col("place") == most) | (F.col("channel") == "question"))
    own = kept.groupBy("id").agg(F.max(F.when(F.col("channel") == "question", F.col("place"))).alias("own"))
    kept = kept.join(own, "id").where((F.col("own").isNull()) | (F.col("own") <= most) | (F.col("place") != most))
    return kept.select("id", F.least("place", F.lit(most)).alias("place"), "query", "channel", "priority")


def comparable(name: Column) -> Column:
    """Letters and digits alone, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def exact_name_boost(names: Column, query: Column) -> Column:
    """400 if a name is the query, 300 if they agree in letters and digits (3 at least), 100 if one holds it (4 at least), else 0."""
    q = F.trim(query)
    low, bare = F.lower(q), comparable(q)
    some = lambda test: F.coalesce(F.exists(names, test), F.lit(False))
    return (
        F.when(some(lambda n: F.lower(n) == low), 400)
        .when((F.length(bare) >= 3) & some(lambda n: comparable(n) == bare), 300)
        .when((F.length(q) >= 4) & some(lambda n: F.contains(F.lower(n), low)), 100)
        .otherwise(0)
    )


def graph_name_boost(names: Column, query: Column) -> Column:
    """1000, 900 or 500 for the same name, the same letters and digits, or a name that holds the query; else 0."""
    low, bare = F.lower(F.trim(query)), comparable(query)
    some = lambda test: F.coalesce(F.exists(names, test), F.lit(False))
    return F.when(some(lambda n: F.lower(n) == low), 1000).when(some(lambda n: comparable(n) == bare), 900).when(some(lambda n: F.contains(F.lower(n), low)), 500).otherwise(0)


# fixed values: words of a question and the kinds that they ask for
INTENTS = (
    (("報表",), ("ReportTemplate", "ReportDataSource", "CustomParameterDataSource")),
    (("資料",), ("Database", "DatabaseObject", "DatabaseColumn", "StoredProcedureParameter")),
    (("呼叫", "方法"), ("Method",)),
)


def intent_boost(question: Column, kind: Column, intents: tuple = INTENTS) -> Column:
    """10 for a menu item, and 8 for each group of words that the question holds and whose kinds include this one."""
    low, total = F.lower(question), F.when(kind == "MenuItem", 10).otherwise(0)
    for words, kinds in intents:
        said = F.lit(False)
        for w in words:
            said = said | F.contains(low, F.lit(w.lower()))
        total = total + F.when(said & kind.isin(*kinds), 8).otherwise(0)
    return total


def infer_role(kind: Column, name: Column) -> Column:
    """The role of a node that states none, by its kind and name; empty if nothing tells."""
    low = F.lower(name)
    return (
        F.when(kind == "MenuItem", "MenuFeature")
        .when(kind == "ApiEndpoint", "WebRoute")
        .when(kind.isin("WebFormPage", "View", "ScriptAsset"), "FrontendPage")
        .when(kind.isin("Schedule", "ScheduleTaskDefinition"), "Schedule")
        .when((kind == "Type") & F.endswith(low, F.lit("controller")), "Controller")
        .when((kind == "Method") & F.contains(low, F.lit("controller")), "ControllerAction")
        .otherwise("")
    )


def display_name(key: Column, *names: Column) -> Column:
    """The first of the names that isn't blank, else the key."""
    return F.coalesce(*[F.when(F.trim(n) != "", n) for n in names], key)


def budget_plan(remaining: Column, exact: Column, ratio: float, ratio_exact: float) -> Column:
    """struct(structural, evidence) characters: the evidence's share cut to a whole number, neither below 0."""
    share = (remaining * F.when(exact, F.lit(ratio_exact)).otherwise(F.lit(ratio))).cast("int")
    return F.struct(F.greatest(remaining - share, F.lit(0)).cast("int").alias("structural"), F.greatest(share, F.lit(0)).alias("evidence"))


def evidence_line(type_: Column, location: Column, line: Column, reference: Column, fallback: str = "extractor") -> Column:
    """What a relationship rests on: its type, place and reference; null without a place and a reference."""
    place = F.when(line > 0, F.concat(F.coalesce(location, F.lit("source")), F.lit(":"), line.cast("string"))).otherwise(location)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(~(blank(place) & blank(reference)), F.concat(type_, F.lit("；"), F.coalesce(place, F.lit(fallback)), F.when(blank(reference), "").otherwise(F.concat(F.lit("；"), reference))))


def artifact_score(resolved: Column, files: Column) -> Column:
    """The quality of an artifact from its status and the names of its files: seven parts, 97.5 at most."""
    has = lambda test: F.exists(files, lambda f: test(F.lower(f)))
    readme, licence = has(lambda f: F.startswith(f, F.lit("readme"))), has(lambda f: F.startswith(f, F.lit("license")))
    example = has(lambda f: f.rlike("example|sample"))
    part = lambda c, yes, no: F.when(c, float(yes)).otherwise(float(no))
    return part(resolved, 20, 5) + part(readme, 15, 3) + part(resolved, 20, 0) + F.lit(7.5) + part(example, 10, 0) + part(resolved, 10, 0) + part(licence, 10, 4)


def artifact_kind(hint: Column, text: Column) -> Column:
    """struct(kind, confidence): what is declared, else what the text speaks of."""
    low = F.lower(text)
    kind = F.when(hint != "Unknown", hint).when(F.contains(low, F.lit("mcp")), "McpServer").when(low.rlike("skill|agent"), "Skill").otherwise("Unknown")
    return F.struct(kind.alias("kind"), F.when(hint != "Unknown", "Declared").when(kind == "Unknown", "Unknown").otherwise("Inferred").alias("confidence"))
