"""Database catalogs as tables: objects, columns, parameters and keys, the graph they make, and what SQL texts refer to.

A catalog is objects(space, name, type, definition), columns(space, object, column, ordinal, type, is_key),
parameters(space, object, parameter, ordinal) and keys(name, space, object, column, to_space, to_object, to_column, ordinal).
Names match whatever their case and without brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.paths import object_name, shortened

# fixed values: type codes of a system catalog
TYPE_CODES = {"U": "Table", "V": "View", "P": "StoredProcedure", "PC": "StoredProcedure", "FN": "UDF", "IF": "UDF", "TF": "UDF", "FS": "UDF", "FT": "UDF"}


def has_tables(present: DataFrame, wanted: list[str]) -> DataFrame:
    """One row: 1 if every wanted table is among present(name), whatever the case, else 0."""
    low = sorted({w.lower() for w in wanted})
    return present.where(F.lower("name").isin(low)).agg((F.count_distinct(F.lower("name")) == len(low)).cast("int").alias("all_there"))


def load_objects(objects: DataFrame, spaces: DataFrame, modules: DataFrame) -> DataFrame:
    """objects(object_id, space_id, name, code), spaces(space_id, space), modules(object_id, definition) as catalog objects; other codes go."""
    code = F.trim("code")
    type_ = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv]), code)
    rows = objects.where(code.isin(*TYPE_CODES)).join(spaces, "space_id").join(modules, "object_id", "left")
    return rows.select("object_id", "space", "name", type_.alias("type"), "definition")


def load_columns(columns: DataFrame, objects: DataFrame, key_columns: DataFrame) -> DataFrame:
    """columns(object_id, column, ordinal, type) of known objects; is_key where key_columns(space, object, column) has it, whatever the case."""
    low = lambda *names: F.concat_ws(".", *[F.lower(n) for n in names])
    keys = key_columns.select(low("space", "object", "column").alias("_k")).distinct().withColumn("is_key", F.lit(True))
    rows = columns.join(objects.select("object_id", "space", F.col("name").alias("object")), "object_id").withColumn("_k", low("space", "object", "column"))
    return rows.join(keys, "_k", "left").select("space", "object", "column", "ordinal", "type", F.coalesce("is_key", F.lit(False)).alias("is_key"))


def load_parameters(parameters: DataFrame, objects: DataFrame) -> DataFrame:
    """parameters(object_id, parameter, ordinal) of known objects; ordinal 0 is a return value and goes."""
    return parameters.where("ordinal > 0").join(objects.select("object_id", "space", F.col("name").alias("object")), "object_id").select("space", "object", "parameter", "ordinal")


def load_keys(keys: DataFrame, key_columns: DataFrame, objects: DataFrame, columns: DataFrame) -> DataFrame:
    """keys(key_id, name), key_columns(key_id, ordinal, object_id, column_id, to_object_id, to_column_id) with the names of both ends."""
    o = objects.select("object_id", "space", F.col("name").alias("object"))
    c = columns.select("object_id", F.col("ordinal").alias("column_id"), "column")
    to_o = o.select(F.col("object_id").alias("to_object_id"), F.col("space").alias("to_space"), F.col("object").alias("to_object"))
    to_c = c.select(F.col("object_id").alias("to_object_id"), F.col("column_id").alias("to_column_id"), F.col("column").alias("to_column"))
    rows = key_columns.join(keys, "key_id").join(o, "object_id").join(c, ["object_id", "column_id"]).join(to_o, "to_object_id").join(to_c, ["to_object_id", "to_column_id"])
    return rows.select("name", "space", "object", "column", "to_space", "to_object", "to_column", "ordinal")


def load_menus(menus: DataFrame, left_out: list[int], hidden: str = "88") -> DataFrame:
    """Released menus (id, parent, name, released, link) with a link; ids that begin with `hidden` or are left out go."""
    return menus.where(F.col("released") & (F.coalesce("link", F.lit("")) != "") & ~F.startswith(F.col("id").cast("string"), F.lit(hidden)) & ~F.col("id").isin(left_out))


def _object_id(db: str, space: str = "space", name: str = "name") -> Column:
    return stable_id("db-object", F.lit(db), object_name(F.col(space)), object_name(F.col(name)))


def catalog_nodes(db: str, objects: DataFrame, columns: DataFrame, parameters: DataFrame) -> DataFrame:
    """(id, kind, name, detail): the database, its objects (length and hash of the definition), columns and parameters."""
    spark = objects.sparkSession
    own = spark.range(1).select(stable_id("database", F.lit(db)).alias("id"), F.lit("Database").alias("kind"), F.lit(db).alias("name"), F.lit(None).cast("string").alias("detail"))
    text = F.coalesce("definition", F.lit(""))
    obj = objects.select(_object_id(db).alias("id"), F.lit("DatabaseObject").alias("kind"), F.concat_ws(".", "space", "name").alias("name"), F.concat_ws(":", "type", F.length(text).cast("string"), F.left(F.sha2(text, 256), F.lit(8))).alias("detail"))
    kept = lambda df: df.join(objects.select(F.lower("space").alias("_s"), F.lower("name").alias("_n")).distinct(), (F.lower(df.space) == F.col("_s")) & (F.lower(df.object) == F.col("_n")), "left_semi")
    col = kept(columns).select(stable_id("db-column", F.lit(db), F.lower("space"), F.lower("object"), F.lower("column")).alias("id"), F.lit("DatabaseColumn").alias("kind"), F.col("column").alias("name"), F.concat_ws(":", F.col("ordinal").cast("string"), "type", F.col("is_key").cast("string")).alias("detail"))
    par = kept(parameters).select(stable_id("db-parameter", F.lit(db), F.lower("space"), F.lower("object"), F.lower("parameter")).alias("id"), F.lit("StoredProcedureParameter").alias("kind"), F.col("parameter").alias("name"), F.col("ordinal").cast("string").alias("detail"))
    return own.unionByName(obj).unionByName(col).unionByName(par)


def catalog_edges(db: str, objects: DataFrame, columns: DataFrame, parameters: DataFrame, keys: DataFrame) -> DataFrame:
    """(type, src, dst): what contains what, and foreign keys between known objects; what has no known object goes."""
    known = objects.select(F.lower("space").alias("_s"), F.lower("name").alias("_n"), _object_id(db).alias("_id")).distinct()
    at = lambda df, space, obj, out: df.join(known.select(F.col("_s").alias(f"{out}_s"), F.col("_n").alias(f"{out}_n"), F.col("_id").alias(out)), (F.lower(df[space]) == F.col(f"{out}_s")) & (F.lower(df[obj]) == F.col(f"{out}_n")))
    own = objects.select(F.lit("CONTAINS_OBJECT").alias("type"), stable_id("database", F.lit(db)).alias("src"), _object_id(db).alias("dst"))
    col = at(columns, "space", "object", "o").select(F.lit("HAS_COLUMN").alias("type"), F.col("o").alias("src"), stable_id("db-column", F.lit(db), F.lower("space"), F.lower("object"), F.lower("column")).alias("dst"))
    par = at(parameters, "space", "object", "o").select(F.lit("HAS_PARAMETER").alias("type"), F.col("o").alias("src"), stable_id("db-parameter", F.lit(db), F.lower("space"), F.lower("object"), F.lower("parameter")).alias("dst"))
    fk = at(at(keys, "space", "object", "o"), "to_space", "to_object", "t").select(F.lit("FOREIGN_KEY_TO").alias("type"), F.col("o").alias("src"), F.col("t").alias("dst"))
    return own.unionByName(col).unionByName(par).unionByName(fk)


# --- what SQL texts refer to ----------------------------------------------------------------------

# fixed values: an identifier, and a name in its space
IDENTIFIER = r"\[?[A-Za-z_]\w*\]?"
PAIR = rf"{IDENTIFIER}(?:\s*\.\s*{IDENTIFIER})?"


def references(texts: DataFrame, id_col: str, text_col: str, objects: DataFrame) -> DataFrame:
    """(id, space, name, type, access, confidence): a row for each mention of a known object outside comments.

    A name in its space counts as a whole, found there or else by the name alone (the first space in order); where the
    pair names nothing, its first part counts as a name of its own. Access is what the words before it say: CALL of a
    procedure behind EXEC, WRITE behind INSERT INTO, UPDATE, DELETE FROM, MERGE INTO or TRUNCATE TABLE, READ behind
    FROM, JOIN or APPLY, else REFERENCE; the words must stand within 180 characters.
    """
    clean = F.regexp_replace(F.col(text_col), r"/\*[\s\S]*?\*/|--[^\r\n]*", " ")
    rows = texts.select(F.col(id_col).alias("id"), clean.alias("c")).where("c is not null")
    parts = rows.select("id", F.regexp_extract_all("c", F.lit(PAIR), F.lit(0)).alias("t"), F.split("c", PAIR, -1).alias("g"))
    near = lambda i: F.get("g", i).rlike(r"^\s*$") & (F.length(F.get("g", i)) <= 170)
    each = parts.select("id", "t", "g", F.posexplode("t").alias("i", "token"))
    last = F.when(near(F.col("i")), F.upper(F.get("t", F.col("i") - 1)))
    before = F.when(near(F.col("i") - 1), F.upper(F.get("t", F.col("i") - 2)))
    bare = lambda c: object_name(c)
    pair = F.split(F.regexp_replace("token", r"\s*\.\s*", "."), r"\.")
    each = each.select("id", "i", bare(F.element_at(pair, 1)).alias("first"), bare(F.try_element_at(pair, F.lit(2))).alias("second"), F.coalesce(last, F.lit("")).alias("w1"), F.coalesce(before, F.lit("")).alias("w2"))
    known = objects.select("space", "name", "type", F.lower("space").alias("ks"), F.lower("name").alias("kn"))
    exact = known.groupBy("ks", "kn").agg(F.min(F.struct("space", "name", "type")).alias("exact"))
    alone = known.groupBy("kn").agg(F.min(F.struct("space", "name", "type")).alias("alone"))
    # a pair by its space, by its name, by its first part; a single name by itself
    hit = each.join(exact, (F.col("first") == F.col("ks")) & (F.col("second") == F.col("kn")), "left").drop("ks", "kn")
    hit = hit.join(alone, F.coalesce("second", "first") == F.col("kn"), "left").drop("kn")
    hit = hit.join(alone.select(F.col("kn").alias("fn"), F.col("alone").alias("part")), F.col("second").isNotNull() & (F.col("first") == F.col("fn")), "left")
    whole = F.coalesce("exact", "alone")
    target = F.coalesce(whole, F.col("part"))
    out = hit.where(target.isNotNull()).withColumn("o", target)
    access = (
        F.when((F.col("o.type") == "StoredProcedure") & F.col("w1").isin("EXEC", "EXECUTE"), "CALL")
        .when((F.col("w1") == "UPDATE") | F.concat_ws(" ", "w2", "w1").isin("INSERT INTO", "DELETE FROM", "MERGE INTO", "TRUNCATE TABLE"), "WRITE")
        .when(F.col("w1").isin("FROM", "JOIN", "APPLY"), "READ")
        .otherwise("REFERENCE")
    )
    sure = F.when(F.col("second").isNotNull() & F.coalesce("exact", "alone").isNotNull(), "SCHEMA_QUALIFIED_NAME").otherwise("UNQUALIFIED_EXACT_NAME")
    return out.select("id", "o.space", "o.name", "o.type", access.alias("access"), sure.alias("confidence"))


def relation(source_type: Column, target_type: Column, access: Column) -> Column:
    """The edge type of a reference from one object of the catalog to another."""
    procedure = source_type == "StoredProcedure"
    return (
        F.when(procedure & (target_type == "StoredProcedure"), "CALLS_STORED_PROCEDURE")
        .when(procedure & (target_type == "UDF"), "CALLS_UDF")
        .when(access == "WRITE", "WRITES")
        .when(access == "READ", "READS")
        .otherwise("REFERENCES_DATABASE_OBJECT")
    )


def code_relation(target_type: Column) -> Column:
    """The edge type of a reference from code or a report."""
    return F.when(target_type == "StoredProcedure", "REFERENCES_STORED_PROCEDURE").when(target_type == "UDF", "REFERENCES_UDF").otherwise("REFERENCES_DATABASE_OBJECT")


def dependencies(objects: DataFrame) -> DataFrame:
    """(type, src, dst, n): edges between objects (space.name) by their definitions; an object's mentions of itself go."""
    own = objects.where("definition is not null").select(F.concat_ws(".", "space", "name").alias("id"), F.col("type").alias("source_type"), "definition")
    found = references(own, "id", "definition", objects).join(own.select("id", "source_type"), "id").withColumn("dst", F.concat_ws(".", "space", "name"))
    edges = found.where("id <> dst").select(relation(F.col("source_type"), F.col("type"), F.col("access")).alias("type"), F.col("id").alias("src"), "dst")
    return edges.groupBy("type", "src", "dst").agg(F.count("*").alias("n"))


def list_objects(catalogs: DataFrame, name: str | None, kind: str | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first objects by source, space, name and type; one row `truncated`) of objects with a source column.

    name: a part of the name, whatever its case; kind: a type, an unknown one filters nothing. Of each source limit + 1
    objects are looked at.
    """
    from ..operators.text import first_group_rows

    rows = catalogs.where(F.contains(F.lower("name"), F.lit(name.lower()))) if name else catalogs
    rows = rows.where(F.col("type") == kind) if kind in set(TYPE_CODES.values()) else rows
    order = [F.col(c) for c in ("source", "space", "name", "type")]
    top = first_group_rows(rows, "source", order, limit + 1)
    return top.orderBy(*order).limit(limit), top.agg((F.count("*") > limit).alias("truncated"))


def describe_table(columns: DataFrame, keys: DataFrame, space: str, table: str) -> DataFrame:
    """(column, ordinal, type, is_key, refers_to) of one table in order of its columns."""
    at = lambda df: df.where((F.lower("space") == space.lower()) & (F.lower("object") == table.lower()))
    fk = at(keys).groupBy(F.lower("column").alias("_c")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "to_space", "to_object", "to_column"))), ",").alias("refers_to"))
    own = at(columns)
    return own.join(fk, F.lower(own["column"]) == F.col("_c"), "left").orderBy("ordinal", "column").select("column", "ordinal", "type", "is_key", "refers_to")


def definition(objects: DataFrame, space: str, name: str, most: int = 8000) -> DataFrame:
    """The definition of one object, cut to `most` characters."""
    return objects.where((F.lower("space") == space.lower()) & (F.lower("name") == name.lower())).select("type", shortened(F.col("definition"), most).alias("definition"))


def append_catalog(objects: DataFrame, other: DataFrame, provider: str, other_provider: str) -> tuple[DataFrame, DataFrame]:
    """(objects of both with their provider, one row of the document: provider and names) for a second catalog appended to a first."""
    both = objects.withColumn("provider", F.lit(provider)).unionByName(other.withColumn("provider", F.lit(other_provider)))
    kind = F.when(F.count_distinct("provider") > 1, "Mixed").otherwise(F.first("provider"))
    return both, both.agg(kind.alias("provider"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))


# fixed value: a procedure call in a text
EXEC = r"(?i)\bEXEC(?:UTE)?\s+(?:(?:\[([A-Za-z_]\w*)\]|([A-Za-z_]\w*))\s*\.\s*)?(?:\[([A-Za-z_]\w*)\]|([A-Za-z_]\w*))"


def procedure_calls(texts: DataFrame, id_col: str, text_col: str, objects: DataFrame, likely: tuple[str, ...] = ("get",)) -> DataFrame:
    """(id, procedure, status): procedures that texts execute, KNOWN or CODE_ONLY_OR_HISTORICAL.

    System procedures go, and names that are neither known nor begin like a procedure's (`likely`).
    """
    each = texts.select(F.col(id_col).alias("id"), F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(EXEC), F.lit(0))).alias("call")).where("call is not null")
    group = lambda n: F.nullif(F.regexp_extract("call", EXEC, n), F.lit(""))
    named = each.select("id", F.lower(F.coalesce(group(1), group(2), F.lit("dbo"))).alias("s"), F.coalesce(group(3), group(4)).alias("n")).where("s <> 'sys'")
    known = objects.where("type = 'StoredProcedure'").select(F.lower("name").alias("k")).distinct()
    found = named.join(known, F.lower("n") == F.col("k"), "left")
    like = F.lit(False)
    for p in likely:
        like = like | F.startswith(F.lower("n"), F.lit(p))
    return found.where(F.col("k").isNotNull() | like).select("id", F.concat_ws(".", "s", "n").alias("procedure"), F.when(F.col("k").isNull(), "CODE_ONLY_OR_HISTORICAL").otherwise("KNOWN").alias("status")).distinct()
