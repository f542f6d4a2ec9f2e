"""A real catalog: an embedded database in memory, read through JDBC into the catalog's tables and graph."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import catalog
from weftgraph.sources import jdbc

URL = "jdbc:derby:memory:weft"
DDL = (
    "CREATE SCHEMA shop",
    "CREATE TABLE shop.customer (id INT NOT NULL PRIMARY KEY, name VARCHAR(40))",
    "CREATE TABLE shop.line (ord INT NOT NULL, pos INT NOT NULL, what VARCHAR(9), PRIMARY KEY (ord, pos))",
    "CREATE TABLE shop.note (line_pos INT, line_ord INT, who INT CONSTRAINT note_who REFERENCES shop.customer, CONSTRAINT note_line FOREIGN KEY (line_ord, line_pos) REFERENCES shop.line (ord, pos))",
    "CREATE VIEW shop.names AS SELECT name FROM shop.customer",
    "CREATE PROCEDURE shop.refresh (IN much INTEGER, OUT done VARCHAR(9)) LANGUAGE JAVA PARAMETER STYLE JAVA EXTERNAL NAME 'a.B.c'",
    "CREATE FUNCTION shop.twice (x INTEGER) RETURNS INTEGER LANGUAGE JAVA PARAMETER STYLE JAVA EXTERNAL NAME 'a.B.d'",
)


@pytest.fixture(scope="module")
def live(spark):
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{URL};create=true")
    statement = connection.createStatement()
    for ddl in DDL:
        statement.execute(ddl)
    yield jdbc.LiveCatalog(spark, URL, jdbc.DERBY, ["'L'", "'S'"])
    connection.close()


def own(df):
    return df.where("space = 'SHOP'")


def test_objects(live):
    got = {(r["name"], r["type"], r["definition"] is not None) for r in own(live.objects()).collect()}
    assert got == {("CUSTOMER", "Table", False), ("LINE", "Table", False), ("NOTE", "Table", False), ("NAMES", "View", True), ("REFRESH", "StoredProcedure", False), ("TWICE", "UDF", False)}
    assert live.database() and live.objects().rdd.getNumPartitions() >= 1


def test_columns_and_parameters(live):
    got = {(r["object"], r["column"], r["ordinal"], r["is_key"]) for r in own(live.columns()).collect()}
    assert got == {("CUSTOMER", "ID", 1, True), ("CUSTOMER", "NAME", 2, False), ("LINE", "ORD", 1, True), ("LINE", "POS", 2, True), ("LINE", "WHAT", 3, False), ("NOTE", "LINE_POS", 1, False), ("NOTE", "LINE_ORD", 2, False), ("NOTE", "WHO", 3, False), ("NAMES", "NAME", 1, False)}
    assert {(r["object"], r["parameter"], r["ordinal"]) for r in own(live.parameters()).collect()} == {("REFRESH", "MUCH", 1), ("REFRESH", "DONE", 2), ("TWICE", "X", 1)}


def test_keys(live):
    got = {(r["name"], r["object"], r["column"], r["to_object"], r["to_column"], r["ordinal"]) for r in own(live.keys()).collect()}
    assert got == {("NOTE_WHO", "NOTE", "WHO", "CUSTOMER", "ID", 1), ("NOTE_LINE", "NOTE", "LINE_ORD", "LINE", "ORD", 1), ("NOTE_LINE", "NOTE", "LINE_POS", "LINE", "POS", 2)}


def test_probe_and_graph(live):
    assert live.has_tables(["Customer", "note"]) and not live.has_tables(["customer", "missing"]) and not live.has_tables(["names"])
    parts = own(live.objects()), own(live.columns()), own(live.parameters())
    nodes, edges = catalog.catalog_nodes("db", *parts), catalog.catalog_edges("db", *parts, own(live.keys()))
    assert {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}.items() >= {"DatabaseObject": 6, "DatabaseColumn": 9, "StoredProcedureParameter": 3}.items()
    assert edges.where("type = 'FOREIGN_KEY_TO'").count() >= 2


def test_ranges_part_all_rows(spark):
    rows = spark.createDataFrame([(c,) for c in ["A", "L", "M", "S", "Z", None]], "c string")
    rows.createOrReplaceTempView("r")
    assert sorted(r["n"] for p in jdbc.ranges("c", ["'L'", "'S'"]) for r in spark.sql(f"SELECT count(*) AS n FROM r WHERE {p}").collect()) == [2, 2, 2]
    assert jdbc.ranges("c", []) == ["1 = 1"]
