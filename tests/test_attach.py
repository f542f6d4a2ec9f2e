"""Sources, loosely typed values and best-first expansion against small fixtures."""

from pyspark.sql import functions as F

from weftgraph.functions import values
from weftgraph.operators import graph
from weftgraph.sources import files


def test_source_files(spark, tmp_path):
    for name, text in {"a/x.cs": "one\ntwo\n", "a/bin/y.cs": "no", "b/Z.MD": "---\nname: q\nname: r\nempty:\n---\nbody", "c.exe": "no", "d/e.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.source_files(spark, f"file://{tmp_path}")
    assert {(r["path"], r["line_count"]) for r in got.collect()} == {("a/x.cs", 2), ("b/Z.MD", 6)}
    assert [tuple(r) for r in files.file_range(got.where("path = 'a/x.cs'"), 1, 1).collect()] == [("a/x.cs", 1, "one", True)]
    matter = {r["path"]: r["m"] for r in got.select("path", files.front_matter(F.col("text")).alias("m")).collect()}
    assert matter == {"a/x.cs": None, "b/Z.MD": {"name": "q"}}


def test_json_records(spark, tmp_path):
    (tmp_path / "k1.json").write_text('{"a": 1}')
    (tmp_path / "k2.json").write_text("broken")
    assert {tuple(r) for r in files.json_records(spark, f"file://{tmp_path}", "a long").collect()} == {("k1", 1), ("k2", None)}


def test_values(spark):
    rows = [("1.10", ">=1.2 <2", True), ("1.2.3", "=1.2", True), ("1.3", "=1.2", False), ("2", ">=2.0.0", True), (None, ">1", False), ("x", ">1", False), ("1", None, True), ("1", "odd", False)]
    df = spark.createDataFrame(rows, "v string, c string, ok boolean")
    assert df.where(values.satisfies(F.col("v"), F.col("c")) != F.col("ok")).count() == 0
    one = spark.range(1)
    assert one.select(values.string_map(F.lit('{"a": 1, "b": true, "c": null, "d": " ", "e": [1, 2]}'))).first()[0] == {"a": "1", "b": "true", "e": "[1,2]"}
    fence = "```json\n{\"queries\": [\"x\", \" x\", \"\", \"y\"]}\n```"
    assert one.select(values.rewrite_queries(F.lit(fence)), values.rewrite_queries(F.lit("no"))).first()[:] == (["x", "y"], [])


def test_expand(spark):
    e = spark.createDataFrame([("CALLS", "a", "b", "1"), ("CALLS", "b", "c", "2"), ("HAS_CHUNK", "a", "d", "3"), ("CALLS", "z", "y", "4")], "type string, src string, dst string, edge_id string")
    seeds = spark.createDataFrame([("a", 1.0), ("a", 0.5)], "id string, score double")
    got = {r["id"]: (r["depth"], round(r["score"], 4)) for r in graph.expand(e, seeds).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.85), "d": (1, 0.85), "c": (2, 0.7225)}
    assert {r["id"] for r in graph.expand(e, seeds, budget=2).collect()} == {"a", "b"}
    assert {r["id"] for r in graph.expand(e, seeds, types=["CALLS"]).collect()} == {"a", "b", "c"}
    assert graph.expand(e, seeds.limit(0)).count() == 0
