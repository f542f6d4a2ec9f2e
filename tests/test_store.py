"""The graph store: properties that come back as they were, and writers that meet."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.operators import graph
from weftgraph.storage import Conflict, GraphStore, property_of

NODES, EDGES = "id string, kind string, name string", "type string, src string, dst string, occurrence_count long, edge_id string"


def simple(spark):
    return spark.createDataFrame([("a", "Type", "A"), ("b", "Type", "B")], NODES), spark.createDataFrame([("CALLS", "a", "b", 1, "e1")], EDGES)


def test_properties(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    nodes, edges = simple(spark)
    kinds = {"json": F.lit('{"filePath": "x.cs", "deep": {"k": [1, 2]}, "n": 3}'), "map": F.create_map(F.lit("filePath"), F.lit("x.cs")), "struct": F.struct(F.lit("x.cs").alias("filePath"), F.lit(3).alias("n"))}
    for version, props in enumerate(kinds.values(), 1):
        store.stage("p", version, nodes.withColumn("properties", F.when(F.col("id") == "a", props)), edges.withColumn("properties", props))
        n, e = store.snapshot("p", version, properties=True)
        assert {r["id"]: r["f"] for r in n.select("id", property_of("filePath").alias("f")).collect()} == {"a": "x.cs", "b": None}
        assert {(r["project_id"], r["graph_version"]) for r in n.collect()} == {("p", version)}
        assert e.select(property_of("filePath").alias("f"), property_of("n", "int").alias("n")).first()[:] == ("x.cs", None if version == 2 else 3)
    n, _ = store.snapshot("p", 1, properties=True)
    assert n.where("id = 'a'").select(F.to_json("properties").alias("j")).first()["j"] == '{"deep":{"k":[1,2]},"filePath":"x.cs","n":3}'
    assert store.snapshot("p", 1)[0].columns == ["id", "kind", "name"]
    assert store.diagnostics("p") == {"versions": 3, "active": 0, "inactive": 6}


def test_second_writer_takes_the_next_number(spark, tmp_path):
    one, two = GraphStore(spark, f"file://{tmp_path}"), GraphStore(spark, f"file://{tmp_path}")
    one.stage("p", 1, *simple(spark))
    assert not two._put(1, {"project_id": "p", "graph_version": 9, "action": "staged", "path": None})
    two.stage("p", 2, *simple(spark))
    assert [r["seq"] for r in one.log().orderBy("seq").collect()] == [1, 2]
    with pytest.raises(Conflict):
        two.stage("p", 1, *simple(spark))
    one.promote("p", 1)
    one.promote("p", 2, instead_of=1)
    with pytest.raises(Conflict):
        two.promote("p", 2, instead_of=1)
    with pytest.raises(Conflict):
        two.promote("p", 7)


def test_of_two_writers_one_loses(spark, tmp_path):
    stores = [GraphStore(spark, f"file://{tmp_path}") for _ in range(4)]
    for v in range(1, 6):
        stores[0].stage("p", v, *simple(spark))
    stores[0].promote("p", 1)
    lost, meet = [], threading.Barrier(4)

    def promote(store, version):
        # all have seen version 1 as the current one before any of them goes on
        real, first = store._put, [True]

        def put(seq, entry):
            if first.pop() if first else False:
                meet.wait()
            return real(seq, entry)

        store._put = put
        try:
            store.promote("p", version, instead_of=1)
        except Conflict:
            lost.append(version)

    threads = [threading.Thread(target=promote, args=(s, v)) for v, s in enumerate(stores, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(lost) == 3 and stores[0].current("p") not in [1, *lost]


def test_same_file(spark):
    nodes = spark.createDataFrame([("a", "Type", "A", "f1"), ("b", "Type", "B", "f1"), ("c", "Type", "C", "f2"), ("d", "Type", "D", None), ("e", "Type", "E", " ")], f"{NODES}, path string")
    edges = spark.createDataFrame([("CALLS", "a", "b", 1, "1"), ("CALLS", "b", "c", 1, "2"), ("CALLS", "b", "b", 1, "3")], EDGES)
    shown, among, counts = graph.same_file(nodes, edges, ["a", "d"], 10)
    assert [(r["id"], r["degree"], r["center"]) for r in shown.orderBy(F.desc("center"), F.desc("degree"), "id").collect()] == [("a", 1, True), ("d", 0, True), ("b", 3, False)]
    assert {r["edge_id"] for r in among.collect()} == {"1", "3"}
    assert counts.first()[:] == (5, 3, 2, False)
    assert graph.same_file(nodes, edges, ["a", "d"], 2)[2].first()[:] == (5, 2, 0, True)
    assert graph.same_file(nodes, edges, ["e"], 5)[2].first()[:] == (5, 1, 0, False)


def test_edge_ids_are_made_on_reading(spark, tmp_path):
    """Ids that follow the rule aren't written; all others, empty and null ones too, stay as they are."""
    store = GraphStore(spark, f"file://{tmp_path}")
    nodes = spark.createDataFrame([(x, "File", x) for x in "abc"], "id string, kind string, name string")
    rule = ids.edge_id(F.col("type"), F.col("src"), F.col("dst"))
    bare = spark.createDataFrame([("CALLS", "a", "b", 1), ("READS", "a", "c", 1)], "type string, src string, dst string, occurrence_count int")
    want = {tuple(r) for r in bare.select("type", "dst", rule).collect()}
    store.stage("p", 1, nodes, bare)
    store.stage("p", 2, nodes, bare.withColumn("edge_id", rule))
    for v in (1, 2):
        assert {tuple(r) for r in store.snapshot("p", v)[1].select("type", "dst", "edge_id").collect()} == want
        assert spark.read.parquet(store.versions("p")[v] + "/edges").where("edge_id is not null").count() == 0
    own = spark.createDataFrame([("CALLS", "a", "b", 1, "e"), ("CALLS", "b", "b", 1, ""), ("CALLS", "c", "b", 1, None)], "type string, src string, dst string, occurrence_count int, edge_id string")
    store.stage("p", 3, nodes, own)
    assert {tuple(r) for r in store.snapshot("p", 3)[1].select("src", "edge_id").collect()} == {("a", "e"), ("b", ""), ("c", None)}


def test_validate_counts(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    rows = [("T", "a", "b", "1"), ("T", "a", "x", "2"), ("T", "y", "z", "3"), ("U", None, "b", "4")]
    edges = spark.createDataFrame(rows, "type string, src string, dst string, edge_id string")
    assert graph.validate(nodes, edges).first().asDict() == {"nodes": 4, "repeated_nodes": 2, "edges": 4, "types": "T,U", "dangling_edges": 3}
    assert graph.validate(nodes, edges.where("edge_id = '1'")).first().asDict() == {"nodes": 4, "repeated_nodes": 2, "edges": 1, "types": "T", "dangling_edges": 0}


def test_neighbors_without_ids(spark):
    """Edges between the same two nodes, ties at the limit among them, come as with their ids."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["CALLS", "READS", "HAS_CHUNK"]), f"n{rnd.randrange(6)}", f"n{rnd.randrange(6)}") for _ in range(80)]
    bare = spark.createDataFrame(sorted(set(rows)), "type string, src string, dst string")
    full = bare.withColumn("edge_id", ids.edge_id(F.col("type"), F.col("src"), F.col("dst")))
    for k in (1, 3, 7):
        a, b = ({tuple(r) for r in graph.neighbors(e, None, k).select("center", "neighbor", "direction", "type", "edge_id", "rank").collect()} for e in (bare, full))
        assert a == b and a


def test_seeds_leave_edges_where_they_are(spark, monkeypatch):
    """A walk from a few seeds joins them to the edges without dealing out the edges."""
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, name))
    edges = spark.range(100).selectExpr("'CALLS' as type", "concat('n', id) as src", "concat('n', id + 1) as dst", "cast(id as string) as edge_id")
    assert {r["id"] for r in graph.breadth_first(edges, ["n5"], 1).collect()} == {"n4", "n5", "n6"}
    graph.visual_neighbors(edges, edges, ["n5"], 1, 10)
    assert len(plans) == 2 and all("BroadcastHashJoin" in p for p in plans)
