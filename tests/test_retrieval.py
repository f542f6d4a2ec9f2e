"""Searches over nodes: what meets the nodes, and that they stay where they are."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import retrieval, text


def shuffled(spark) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)])
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_first_hits_meet_the_nodes(spark):
    """As all hits joined with the nodes, in order; also if the first hits are no nodes, a node stands there twice or a hit has no id."""
    rnd = random.Random(4)
    hits = [(f"n{i}", float(rnd.randrange(5))) for i in range(60)] + [(None, 9.0)]
    h = spark.createDataFrame(hits, "id string, score double")
    for there in (range(60), range(0, 60, 3), range(100, 110), [7, 7, *range(60)]):
        rows = [(f"n{i}", "Type", f"name {i}") for i in there]
        nodes = spark.createDataFrame(rows, "id string, kind string, name string")
        for most in (1, 5, 200):
            want = sorted(((s, i) for i, s in hits for r in rows if r[0] == i), key=lambda x: (-x[0], x[1]))[:most]
            got = retrieval.best_nodes(h, nodes, most).collect()
            assert [(r["score"], r["id"]) for r in got] == want and all(r["kind"] == "Type" for r in got)


def test_planned_search_leaves_nodes_where_they_are(spark, tmp_path):
    """The nodes are far larger than what a search finds; they aren't dealt out."""
    noise = F.sha2(F.col("id").cast("string"), 512)
    name = F.when(F.col("id") % 997 == 0, F.concat(F.lit("large widget "), noise)).otherwise(noise)
    spark.range(20000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("Type").alias("kind"), name.alias("name")).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"file://{tmp_path}/nodes")
    index = text.TextIndex(spark, f"file://{tmp_path}/index").build(nodes, "id", F.col("name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # the nodes have over 2 MB
    try:
        before = shuffled(spark)
        got = retrieval.search_plan(index, nodes, "large widget", ["large widget"], 12).collect()
        assert [r["id"] for r in got] == sorted((f"n{i}" for i in range(0, 20000, 997)))[:12]
        assert shuffled(spark) - before < 200_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_planned_search_ranks_all_hits(spark, tmp_path):
    """Names that hold a query, and kinds that the question asks for, come first however low their score is."""
    rows = [(f"a{i:03}", "Type", "widget widget widget") for i in range(300)]  # short, and the term over and over
    rows += [(f"n{i}", "Type", "one large widget " + "among so many other words " * (3 + i)) for i in range(3)] + [(f"m{i}", "MenuItem", "a widget " + "at the end of a long menu " * (4 + i)) for i in range(4)]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string")
    index = text.TextIndex(spark, f"file://{tmp_path}/index").build(nodes, "id", F.col("name"))
    score = {r["id"]: r["score"] for r in index.search(["large", "widget"]).withColumn("score", F.round("score", 6)).collect()}
    boosts = {"a": (0, 0), "n": (100, 0), "m": (0, 10)}
    want = sorted(score, key=lambda i: (-boosts[i[0]][0], -boosts[i[0]][1], -score[i], i))
    for limit in (1, 2, 5, 8, 400):
        got = retrieval.search_plan(index, nodes, "large widget", ["large widget"], limit).collect()
        assert [(r["id"], r["score"], r["exact"], r["intent"]) for r in got] == [(i, score[i], *boosts[i[0]]) for i in want[:limit]]


def test_agent_search_leaves_nodes_where_they_are(spark, tmp_path):
    """Exact names first among the first hits; the nodes, far larger than the hits, aren't dealt out."""
    noise = F.sha2(F.col("id").cast("string"), 512)
    spark.range(20000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("Type").alias("kind"), F.when(F.col("id") == 7, "large widget").otherwise(noise).alias("name")).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"file://{tmp_path}/nodes")
    spark.range(0, 20000, 7).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(1.0).alias("score")).write.parquet(f"{tmp_path}/hits")
    hits = spark.read.parquet(f"file://{tmp_path}/hits").withColumn("score", F.when(F.col("id") == "n7", 2.0).otherwise(F.col("score")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # neither side is small
    try:
        before = shuffled(spark)
        got = [(r["id"], r["boost"]) for r in retrieval.agent_search(hits, nodes, "large widget", 5).collect()]
        rest = sorted(f"n{i}" for i in range(0, 20000, 7) if i != 7)[:4]
        assert got == [("n7", 1000), *((i, 0) for i in rest)] and shuffled(spark) - before < 200_000
        few = nodes.where("id in ('n0', 'n21')")
        touched = spark.createDataFrame([("CALLS", "n21", "x")], "type string, src string, dst string")
        shown, more = retrieval.visual_search(hits, few, touched, 5, ["Type"], ["CALLS"])
        assert [r["id"] for r in shown.collect()] == ["n21"] and not more.first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
