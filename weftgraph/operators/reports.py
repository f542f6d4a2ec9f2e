"""Reports, schedules, menus, mappings and views as joins: what XML, routes and comments point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.paths import object_name, plugin_target, split_object_name, stem
from ..functions.strings import classify_link, normalize_link


def xml_rows(rows: DataFrame, id_col: str, xml_col: str, element: str, attributes: list[str]) -> DataFrame:
    """(id, ordinal, the attributes): a row for each such element below the root of each XML text, numbered from 1; text that is no XML has none."""
    schema = f"`{element}` array<struct<{','.join(f'`_{a}`:string' for a in attributes)}>>"
    parsed = rows.select(F.col(id_col).alias("id"), F.from_xml(F.col(xml_col), schema, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})[element].alias("e"))
    each = parsed.select("id", F.posexplode("e").alias("at", "x"))
    return each.select("id", (F.col("at") + 1).alias("ordinal"), *[F.col(f"x._{a}").alias(a) for a in attributes])


def report_documents(templates: DataFrame, sources: DataFrame) -> DataFrame:
    """(template, ordinal, document, source): the documents of templates(template, xml) in order, with the source(source) that their serial id names, or null."""
    docs = xml_rows(templates, "template", "xml", "ReportDocument", ["DataSourceSerialID"])
    named = docs.withColumn("document", stable_id("report-document", F.col("id"), F.col("ordinal"), F.col("DataSourceSerialID")))
    return named.join(sources.select(F.lower("source").alias("_s"), "source"), F.lower("DataSourceSerialID") == F.col("_s"), "left").select(F.col("id").alias("template"), "ordinal", "document", "source")


def schedule_procedures(definitions: DataFrame, parameters: DataFrame) -> DataFrame:
    """(task, procedure, arguments, expected, mismatch): procedures that the arguments of task definitions (task, xml) execute, with the counts of arguments given and of parameters(procedure) known."""
    call = r"(?i)^AUTO=EXECSTOREDPROCEDURE:([^,\s]+)(.*)$"
    values = xml_rows(definitions, "task", "xml", "Argument", ["Value"]).where(F.col("Value").rlike(call))
    name = split_object_name(F.regexp_extract("Value", call, 1))
    given = F.size(F.filter(F.split(F.regexp_extract("Value", call, 2), ","), lambda x: F.trim(x) != ""))
    calls = values.select(F.col("id").alias("task"), F.concat_ws(".", F.lower(name["space"]), F.lower(name["name"])).alias("procedure"), given.alias("arguments"))
    known = parameters.groupBy(F.lower("procedure").alias("procedure")).agg(F.count("*").alias("expected"))
    return calls.join(known, "procedure", "left").select("task", "procedure", "arguments", F.coalesce("expected", F.lit(0)).alias("expected"), (F.col("arguments") != F.coalesce("expected", F.lit(0))).alias("mismatch"))


def schedule_tasks(schedules: DataFrame, tasks: DataFrame, definitions: DataFrame) -> DataFrame:
    """(schedule, task, definition): tasks(schedule, task, name) of known schedules(schedule), with the definition(name) of their name or null."""
    rows = tasks.join(schedules.select("schedule").distinct(), "schedule", "left_semi")
    by_name = definitions.groupBy(F.lower("name").alias("_n")).agg(F.max("definition").alias("definition"))
    return rows.join(by_name, F.lower("name") == F.col("_n"), "left").select("schedule", "task", "definition")


def category_constants(formats: DataFrame, constants: DataFrame) -> DataFrame:
    """(format, constant): the first constant(value, constant, seq) with the category's value of each format(format, category); the smallest of those of one seq."""
    first = constants.groupBy("value").agg(F.min_by("constant", F.struct("seq", "constant")).alias("constant"))
    return formats.join(first, F.col("category") == F.col("value")).select("format", "constant")


def menu_routes(menus: DataFrame, templates: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """(menu, relation, target): where menus(id, link) lead.

    Custom reports go to templates(template) by id, plugin reports to their decoded target and the type of its full
    name, all other local links by convention to types(type, name) called segment + Controller and to methods(type, name,
    method) called as the second segment, Index without one. Names match whatever their case.
    """
    m = menus.withColumn("l", normalize_link(F.col("link"))).withColumn("class", classify_link(F.col("l")))
    last = F.element_at(F.split("l", "/"), -1)
    custom = m.where("class = 'CustomReport'").join(templates.select("template"), last == F.col("template")).select("id", F.lit("LINKS_TO_CUSTOM_REPORT").alias("relation"), F.col("template").alias("target"))
    plug = m.where("class = 'PluginReport'").withColumn("p", plugin_target(last))
    target = stable_id("plugin-report-target", F.col("p.assembly"), F.col("p.class_name"))
    plugin = plug.select("id", F.lit("LINKS_TO_PLUGIN_REPORT").alias("relation"), target.alias("target"))
    implemented = plug.join(types, F.lower("p.class_name") == F.lower("full_name")).select("id", F.lit("IMPLEMENTED_BY_TYPE").alias("relation"), F.col("type").alias("target"))
    parts = F.filter(F.split("l", "/"), lambda x: x != "")
    mvc = m.where("class = 'MVC'").select("id", F.lower(F.concat(F.get(parts, 0), F.lit("Controller"))).alias("c"), F.lower(F.coalesce(F.get(parts, 1), F.lit("Index"))).alias("a")).where("c is not null")
    found = mvc.join(types.select("type", F.lower("name").alias("c")), "c")
    controller = found.select("id", F.lit("NAVIGATES_TO_CONTROLLER").alias("relation"), F.col("type").alias("target"))
    action = found.join(methods.select("type", F.lower("name").alias("a"), "method"), ["type", "a"]).select("id", F.lit("NAVIGATES_TO_ACTION").alias("relation"), F.col("method").alias("target"))
    out = custom.unionByName(plugin).unionByName(implemented).unionByName(controller).unionByName(action)
    return out.select(F.col("id").alias("menu"), "relation", "target")


def entity_mappings(sets: DataFrame, mappings: DataFrame, objects: DataFrame, types: DataFrame) -> DataFrame:
    """(entity, object, type): entity sets(entity, store) through the first mapping(store, space, name, seq) of their store to objects(space, name, object), and to the types(name, type) of the entity's name; null where there is none."""
    first = mappings.groupBy("store").agg(F.min_by(F.struct(F.lower("space").alias("space"), F.lower("name").alias("name")), "seq").alias("m"))
    o = objects.select(F.lower("space").alias("os"), F.lower("name").alias("on"), "object")
    t = types.groupBy(F.lower("name").alias("tn")).agg(F.min("type").alias("type"))
    rows = sets.join(first, "store", "left").join(o, (F.col("m.space") == F.col("os")) & (F.col("m.name") == F.col("on")), "left")
    return rows.join(t, F.lower("entity") == F.col("tn"), "left").select("entity", "object", "type")


# fixed values: what a header comment says of a class's table
HEADER_NAME, HEADER_TYPE = r"來源資料表：([A-Za-z0-9_]+)", r"(?i)來源資料表類型：(Table|View|UDF)"


def header_mappings(files: DataFrame, types: DataFrame, objects: DataFrame) -> DataFrame:
    """(type, object, status): all types(path, type) of each file(path, text) whose header names a table, with that object(name), MAPPED or CANDIDATE where it isn't known."""
    said = files.select("path", F.regexp_extract("text", HEADER_NAME, 1).alias("table")).where("table <> ''")
    known = objects.select(object_name(F.col("name")).alias("_n")).distinct().withColumn("known", F.lit(True))
    rows = said.join(types, "path").join(known, F.lower("table") == F.col("_n"), "left")
    return rows.select("type", F.lower("table").alias("object"), F.when(F.col("known"), "MAPPED").otherwise("CANDIDATE").alias("status"))


def parameter_bindings(bound: DataFrame, parameters: DataFrame) -> DataFrame:
    """(method, parameter): bindings(method, space, object, name) to parameters(space, object, parameter) by all three, whatever their case.

    Parameters and bindings that say the same count once before they meet.
    """
    low = lambda *c: [F.lower(x).alias(f"_{i}") for i, x in enumerate(c)]
    known = parameters.select(*low("space", "object", "parameter"), "parameter").distinct()
    return bound.select("method", *low("space", "object", "name")).distinct().join(known, ["_0", "_1", "_2"]).select("method", "parameter").distinct()


def returned_views(returns: DataFrame, views: DataFrame) -> DataFrame:
    """(method, view, resolved): the view of each return(method, controller, view): of views(path) of that stem the one in the controller's folder first, then the shortest; else the name as an unresolved view."""
    v = views.select("path", F.lower(stem(F.col("path"))).alias("_v"), F.lower(F.element_at(F.split("path", "/"), -2)).alias("folder"))
    rows = returns.withColumn("_id", F.concat_ws("|", "method", "view")).join(v, F.lower("view") == F.col("_v"), "left")
    place = F.struct(F.when(F.col("folder") == F.lower("controller"), 0).otherwise(1), F.length("path"), F.col("path"))
    best = rows.groupBy("method", "view").agg(F.min_by("path", F.when(F.col("path").isNotNull(), place)).alias("path"))
    return best.select("method", F.coalesce("path", F.concat(F.lit("unresolved:"), "view")).alias("view"), F.col("path").isNotNull().alias("resolved"))


def branch_kind(code: Column) -> Column:
    """What decides over a return by the words before it: if, else, switch, expression or unconditional."""
    return F.when(code.rlike(r"\belse\s*\{?\s*return\b"), "else").when(code.rlike(r"\bif\s*\([^)]*\)\s*\{?\s*return\b"), "if").when(code.rlike(r"\bcase\b[^:]*:\s*return\b"), "switch").when(code.rlike("=>"), "expression").otherwise("unconditional")


def included_scripts(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(page, script, resolved): the references of pages(page, reference) to files(path): the same path, else the shortest that ends in it; else as it stands.

    A file's path is taken apart into its suffixes, so that both are equi-joins.
    """
    parts = F.split("path", "/")
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.lower(F.array_join(F.slice(parts, n, F.size(parts)), "/")))).alias("s"))
    best = suffixes.groupBy("s").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))
    return pages.join(best, F.lower("reference") == F.col("s"), "left").select("page", F.coalesce("path", "reference").alias("script"), F.col("path").isNotNull().alias("resolved"))


def code_index(methods: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """The lookups of a code base: methods by place, types by name, full name and file, methods by type; each key lower-cased, first of a key by id."""
    first = lambda df, keys, value: df.groupBy(*[F.lower(k).alias(k) for k in keys]).agg(F.min(value).alias(value), F.count("*").alias("n"))
    return {
        "method_by_place": methods.groupBy(F.lower("path").alias("path"), "line").agg(F.min("method").alias("method")),
        "type_by_name": first(types, ["name"], "type"),
        "type_by_full_name": first(types, ["full_name"], "type"),
        "type_by_file": first(types, ["path"], "type"),
        "method_by_type": first(methods.join(types.select("type", F.col("name").alias("type_name")), "type"), ["type_name", "name"], "method"),
    }


def method_at(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(path, line, owner, how): each call(path, line) with the method(path, first, last, method) whose lines hold it, the innermost; else its file.

    Methods are spread over blocks of 64 lines, so that the range is an equi-join on path and block. Of methods with the
    same lines only the first can be an owner. The join may not be a broadcast: Spark takes the spread side for as small
    as the columns that it comes from.
    """
    one = methods.groupBy(F.lower("path").alias("_p"), "first", "last").agg(F.min("method").alias("method"))
    spread = one.select("_p", "first", "last", "method", F.explode(F.sequence(F.floor(F.col("first") / 64), F.floor(F.col("last") / 64))).alias("_b"))
    rows = calls.join(spread.hint("merge"), (F.lower("path") == F.col("_p")) & (F.floor(F.col("line") / 64) == F.col("_b")) & F.col("line").between(F.col("first"), F.col("last")), "left")
    best = rows.groupBy("path", "line").agg(F.min_by("method", F.when(F.col("method").isNotNull(), F.struct(F.col("last") - F.col("first"), "method"))).alias("method"))
    return best.select("path", "line", F.coalesce("method", "path").alias("owner"), F.when(F.col("method").isNull(), "FILE").otherwise("METHOD").alias("how"))


def chunks(methods: DataFrame, most: int = 50_000) -> DataFrame:
    """(id, chunk, text, hash, cut): the text of each method(id, text), cut to `most` characters beside the hash of the whole."""
    return methods.select("id", stable_id("chunk", F.col("id")).alias("chunk"), F.left("text", F.lit(most)).alias("text"), F.sha2("text", 256).alias("hash"), (F.length("text") > most).alias("cut"))


def project_edges(projects: DataFrame, references: DataFrame) -> DataFrame:
    """(type, src, dst): the solution's projects(solution, project, path), and references(project, path) to those that are known."""
    own = projects.select(F.lit("CONTAINS_PROJECT").alias("type"), F.col("solution").alias("src"), F.col("project").alias("dst"))
    known = projects.select(F.lower("path").alias("_p"), F.col("project").alias("dst"))
    refs = references.join(known, F.lower("path") == F.col("_p")).select(F.lit("REFERENCES_PROJECT").alias("type"), F.col("project").alias("src"), "dst")
    return own.unionByName(refs)


def remote_branches(lines: DataFrame, prefix: str = "refs/heads/") -> DataFrame:
    """(branch): distinct names behind the prefix in lines of hash, tab and reference, in order."""
    ref = F.element_at(F.split("line", "\t"), -1)
    return lines.where(F.startswith(ref, F.lit(prefix))).select(F.substring(ref, F.lit(len(prefix) + 1), F.length(ref)).alias("branch")).distinct().orderBy("branch")


# fixed values: a connection's tag, and a command or parameter made in code
ADD_TAG = r"(?i)<add\b[^>]*>"
COMMAND = r'(?i)new\s+SqlCommand\s*\(\s*(?:(?:"([^"]+)")|([A-Za-z_]\w*))'
PARAMETER = r'(?i)new\s+SqlParameter\s*\(\s*"(@[^"]+)"\s*,\s*SqlDbType\.([A-Za-z_]\w*)'


def connections(configs: DataFrame, projects: DataFrame, database: str) -> DataFrame:
    """(profile, name, provider, project): connections of configs(path, text) to the database, and the project(project, root) whose root is the longest prefix of the file's path."""
    from ..functions.paths import connection_part, normalize_path, tag_attributes

    tags = configs.select("path", F.explode_outer(F.regexp_extract_all("text", F.lit(ADD_TAG), F.lit(0))).alias("tag")).where("tag is not null")
    a = tags.withColumn("a", tag_attributes(F.col("tag"))).withColumn("c", F.try_element_at("a", F.lit("connectionstring")))
    target = F.coalesce(connection_part(F.col("c"), "initial catalog"), connection_part(F.col("c"), "database"))
    mine = a.where(F.lower(target) == database.lower()).select("path", F.try_element_at("a", F.lit("name")).alias("name"), F.try_element_at("a", F.lit("providername")).alias("provider"))
    rows = mine.withColumn("_p", normalize_path(F.col("path"))).withColumn("profile", stable_id("connection-profile", F.col("_p"), F.col("name")))
    parts = F.split("_p", "/")
    roots = projects.select("project", normalize_path(F.col("root")).alias("_r"))
    above = rows.select("profile", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_r")).join(roots, "_r")
    own = above.groupBy("profile").agg(F.max_by("project", F.struct(F.length("_r"), "project")).alias("project"))
    return rows.join(own, "profile", "left").select("profile", "name", "provider", "project")


def command_calls(methods: DataFrame, constants: DataFrame) -> DataFrame:
    """(method, procedure, how): procedures that methods(method, file, text) run by commands of the stored kind: LITERAL, CONSTANT of its file's constants(file, name, value), or DYNAMIC where the name isn't known."""
    stored = methods.where(F.contains(F.lower("text"), F.lit("commandtype.storedprocedure")))
    each = stored.select("method", "file", F.explode_outer(F.regexp_extract_all("text", F.lit(COMMAND), F.lit(0))).alias("c")).where("c is not null")
    each = each.select("method", "file", F.nullif(F.regexp_extract("c", COMMAND, 1), F.lit("")).alias("literal"), F.nullif(F.regexp_extract("c", COMMAND, 2), F.lit("")).alias("word"))
    first = constants.groupBy("file", F.lower("name").alias("_n")).agg(F.min("value").alias("value"))
    rows = each.join(first.withColumnRenamed("file", "_f"), (F.col("file") == F.col("_f")) & (F.lower("word") == F.col("_n")), "left")
    name = F.coalesce("literal", "value", "word")
    rows = rows.where(~F.contains(name, F.lit(" ")))
    return rows.select("method", name.alias("procedure"), F.when(F.col("literal").isNotNull(), "LITERAL").when(F.col("value").isNotNull(), "CONSTANT").otherwise("DYNAMIC").alias("how")).distinct()


def code_parameters(methods: DataFrame) -> DataFrame:
    """(method, parameter, type) of the parameters that methods(method, text) make."""
    each = methods.select("method", F.explode_outer(F.regexp_extract_all("text", F.lit(PARAMETER), F.lit(0))).alias("p")).where("p is not null")
    return each.select("method", F.regexp_extract("p", PARAMETER, 1).alias("parameter"), F.regexp_extract("p", PARAMETER, 2).alias("type")).distinct()
