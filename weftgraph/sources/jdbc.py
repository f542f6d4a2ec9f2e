"""Live database catalogs through JDBC: the system tables of a server become the tables of operators.catalog.

A dialect is the queries that give a server's objects, spaces, definitions, columns, parameters and keys under the
names that the operators take. Each query is one read; a large one is split over tasks by predicates on a column's
hash or ranges, so no task reads a whole catalog.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog


@dataclass(frozen=True)
class Dialect:
    """Queries by what they give, and the JDBC driver. Columns: see catalog.load_objects and the functions after it."""

    driver: str
    objects: str
    spaces: str
    modules: str
    columns: str
    parameters: str
    key_columns: str
    keys: str
    name: str
    options: dict[str, str] = field(default_factory=dict)


# The system catalog of SQL Server
SQL_SERVER = Dialect(
    driver="com.microsoft.sqlserver.jdbc.SQLServerDriver",
    objects="SELECT object_id, schema_id AS space_id, name, type AS code FROM sys.objects WHERE is_ms_shipped = 0",
    spaces="SELECT schema_id AS space_id, name AS space_name FROM sys.schemas",
    modules="SELECT object_id, definition FROM sys.sql_modules",
    columns="SELECT c.object_id, c.name AS column_name, c.column_id AS ordinal, t.name AS type FROM sys.columns c JOIN sys.types t ON t.user_type_id = c.user_type_id",
    parameters="SELECT object_id, name AS parameter_name, parameter_id AS ordinal FROM sys.parameters",
    key_columns="SELECT i.object_id, c.column_id AS ordinal FROM sys.indexes i JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id WHERE i.is_primary_key = 1",
    keys="SELECT f.name AS key_name, k.constraint_column_id AS ordinal, k.parent_object_id AS object_id, k.parent_column_id AS column_id, k.referenced_object_id AS to_object_id, k.referenced_column_id AS to_column_id FROM sys.foreign_key_columns k JOIN sys.foreign_keys f ON f.object_id = k.constraint_object_id",
    name="SELECT DB_NAME() AS database_name",
)

# The system catalog of Derby, whose keys name their columns by places in an index's description
_DERBY_KEY = "SELECT {what}, c.TABLEID AS object_id, CAST(g.DESCRIPTOR AS VARCHAR(1000)) AS places FROM SYS.SYSCONSTRAINTS c JOIN {through} k ON k.CONSTRAINTID = c.CONSTRAINTID JOIN SYS.SYSCONGLOMERATES g ON g.CONGLOMERATEID = k.CONGLOMERATEID"
DERBY = Dialect(
    driver="org.apache.derby.iapi.jdbc.AutoloadedDriver",
    objects="SELECT TABLEID AS object_id, SCHEMAID AS space_id, TABLENAME AS name, CASE TABLETYPE WHEN 'T' THEN 'U' ELSE TABLETYPE END AS code FROM SYS.SYSTABLES WHERE TABLETYPE IN ('T', 'V') UNION ALL SELECT ALIASID AS object_id, SCHEMAID AS space_id, ALIAS AS name, CASE ALIASTYPE WHEN 'P' THEN 'P' ELSE 'FN' END AS code FROM SYS.SYSALIASES WHERE SYSTEMALIAS = FALSE AND ALIASTYPE IN ('P', 'F')",
    spaces="SELECT SCHEMAID AS space_id, SCHEMANAME AS space_name FROM SYS.SYSSCHEMAS",
    modules="SELECT TABLEID AS object_id, VIEWDEFINITION AS definition FROM SYS.SYSVIEWS",
    columns="SELECT REFERENCEID AS object_id, COLUMNNAME AS column_name, COLUMNNUMBER AS ordinal, CAST(COLUMNDATATYPE AS VARCHAR(200)) AS type FROM SYS.SYSCOLUMNS",
    parameters="SELECT ALIASID AS object_id, CAST(ALIASINFO AS VARCHAR(2000)) AS signature FROM SYS.SYSALIASES WHERE SYSTEMALIAS = FALSE AND ALIASTYPE IN ('P', 'F')",
    key_columns=_DERBY_KEY.format(what="c.CONSTRAINTNAME AS key_name", through="SYS.SYSKEYS") + " WHERE c.TYPE = 'P'",
    keys=_DERBY_KEY.format(what="c.CONSTRAINTNAME AS key_name, c.CONSTRAINTID AS key_id, k.KEYCONSTRAINTID AS to_key_id", through="SYS.SYSFOREIGNKEYS"),
    name="SELECT CURRENT SCHEMA AS database_name FROM SYSIBM.SYSDUMMY1",
    options={"to_keys": _DERBY_KEY.format(what="c.CONSTRAINTID AS to_key_id", through="SYS.SYSKEYS")},
)


def read_query(spark: SparkSession, url: str, driver: str, query: str, predicates: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A query's rows, column names in lower case; with predicates one task reads the rows of each, and they must part all rows."""
    props = {"driver": driver} | (options or {})
    if predicates:
        rows = spark.read.jdbc(url, f"({query}) q", predicates=predicates, properties=props)
    else:
        rows = spark.read.format("jdbc").options(url=url, query=query, **props).load()
    return rows.toDF(*[c.lower() for c in rows.columns])


def ranges(column: str, cuts: list[str]) -> list[str]:
    """Predicates that part all rows, nulls included, by where a column lies among sorted cuts (SQL literals)."""
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


class LiveCatalog:
    """A server's catalog as DataFrames: objects, columns with key flags, parameters, keys, and whether it has some tables."""

    def __init__(self, spark: SparkSession, url: str, dialect: Dialect, cuts: list[str] | None = None):
        self.spark, self.url, self.dialect = spark, url, dialect
        #: of names, where reads are split
        self.cuts = cuts or []

    def _rows(self, what: str, split: str | None = None) -> DataFrame:
        query = getattr(self.dialect, what, None) or self.dialect.options[what]
        return read_query(self.spark, self.url, self.dialect.driver, query, ranges(split, self.cuts) if split and self.cuts else None)

    def database(self) -> str:
        return self._rows("name").first()[0]

    def objects(self) -> DataFrame:
        """(object_id, space, name, type, definition)."""
        return catalog.load_objects(self._rows("objects", "name"), self._rows("spaces").withColumnRenamed("space_name", "space"), self._rows("modules"))

    def _columns(self) -> DataFrame:
        return self._rows("columns", "column_name").withColumnRenamed("column_name", "column")

    def _places(self, what: str) -> DataFrame:
        """The rows of a Derby key query with a row for each column: ordinal (from 1) in the key, column_id in the table."""
        place = F.split(F.regexp_extract("places", r"\(([^)]*)\)", 1), r"\s*,\s*")
        return self._rows(what).select("*", F.posexplode(place).alias("n", "place")).select("*", (F.col("n") + 1).alias("ordinal"), F.regexp_extract("place", r"\d+", 0).cast("int").alias("column_id")).drop("places", "n", "place")

    def columns(self) -> DataFrame:
        """(space, object, column, ordinal, type, is_key)."""
        objects, columns = self.objects(), self._columns()
        key = self._places("key_columns").select("object_id", F.col("column_id").alias("ordinal")) if self.dialect is DERBY else self._rows("key_columns").select("object_id", "ordinal")
        named = columns.join(key.distinct(), ["object_id", "ordinal"]).join(objects.select("object_id", "space", F.col("name").alias("object")), "object_id")
        return catalog.load_columns(columns, objects, named.select("space", "object", "column"))

    def parameters(self) -> DataFrame:
        """(space, object, parameter, ordinal)."""
        if self.dialect is DERBY:
            # name(IN "A" INTEGER, OUT "B" VARCHAR(9)) ..., without IN for functions
            inside = F.regexp_extract_all(F.regexp_replace("signature", r"^[^(]*\(", ""), F.lit(r'(?:^|IN |OUT |, ?)"([^"]+)" '), F.lit(1))
            rows = self._rows("parameters").select("object_id", F.posexplode(inside).alias("n", "parameter")).select("object_id", "parameter", (F.col("n") + 1).alias("ordinal"))
        else:
            rows = self._rows("parameters").withColumnRenamed("parameter_name", "parameter")
        return catalog.load_parameters(rows, self.objects())

    def keys(self) -> DataFrame:
        """(name, space, object, column, to_space, to_object, to_column, ordinal) of the foreign keys."""
        if self.dialect is DERBY:
            own, to = self._places("keys"), self._places("to_keys").select("to_key_id", F.col("object_id").alias("to_object_id"), "ordinal", F.col("column_id").alias("to_column_id"))
            rows = own.join(to, ["to_key_id", "ordinal"])
        else:
            rows = self._rows("keys")
        rows = rows.withColumn("key_id", F.concat_ws(".", F.col("object_id").cast("string"), "key_name"))
        return catalog.load_keys(rows.select("key_id", F.col("key_name").alias("name")).distinct(), rows.select("key_id", "ordinal", "object_id", "column_id", "to_object_id", "to_column_id"), self.objects(), self._columns())

    def has_tables(self, wanted: list[str]) -> bool:
        """Whether the server has all of these tables, whatever their case; what is loaded only then can be left out."""
        present = self._rows("objects", "name").where(F.trim("code") == "U").select("name")
        return bool(catalog.has_tables(present, wanted).first()[0])
