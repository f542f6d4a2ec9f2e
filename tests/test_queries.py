"""Every registered query with SQL, against DuckDB on the smallest tables; operators against small models."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.operators import graph, merge, text
from weftgraph.plans import registry
from weftgraph.storage import GraphStore

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLE[name]).df())


def test_vocabularies():
    assert (len(schema.NODE_KINDS), len(schema.EDGE_TYPES)) == (38, 65)
    assert set(schema.BACKBONE + schema.STRUCTURAL) <= set(schema.EDGE_TYPES)


def test_communities_triangle_and_isolate(spark):
    e = spark.createDataFrame([("a", "b", 4.0), ("b", "c", 2.0), ("c", "a", 1.0), ("x", "y", 1.0)], "a string, b string, w double")
    got = {r["id"]: r["community"] for r in graph.communities(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_self_loop_counts_once(spark):
    e = spark.createDataFrame([("CALLS", "a", "a", "1"), ("CALLS", "a", "b", "2")], "type string, src string, dst string, edge_id string")
    assert graph.incident(e).count() == 3


def test_merge_edges_locations(spark):
    df = spark.createDataFrame([("T", "a", "b", i, None if i == 1 else f"v{i}", f"f{i % 25}") for i in range(1, 40)], "type string, src string, dst string, seq int, p string, loc string")
    got = merge.merge_edges(df, "seq", ["p"], "loc").first()
    assert (got["occurrence_count"], got["p"], len(got["locations"]), got["locations"][0]) == (39, "v2", 20, "f1")


def test_budget_keeps_rows_that_cost_nothing(spark):
    rnd = random.Random(2)
    rows = [(g, i, 0 if g == "free" else rnd.choice([0, 0, 1, 2, 7])) for g in ("free", "x", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, c int")
    for budget in (0, 1, 10, 2_000_000):
        want = set()
        for g in ("free", "x", None):
            used = 0
            for k, (_, i, c) in enumerate(r for r in rows if r[0] == g):
                used += c
                if used <= budget or k == 0:
                    want.add((g, i, used))
        assert {tuple(r) for r in text.budget_prefix(df, ["g"], [F.col("i")], F.col("c"), budget).select("g", "i", "used").collect()} == want


def test_budget_keeps_first_row(spark):
    df = spark.createDataFrame([(1, 50), (2, 1)], "k int, c int")
    assert [r["k"] for r in text.budget_prefix(df, [], [F.col("k")], F.col("c"), 10).collect()] == [1]


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    nodes = spark.createDataFrame([("a", "File", "x")], "id string, kind string, name string")
    edges = spark.createDataFrame([("CALLS", "a", "a", 1, "e")], "type string, src string, dst string, occurrence_count int, edge_id string")
    assert store.current("p") is None
    with pytest.raises(ValueError):
        store.promote("p", 1)
    for v in (1, 2, 3):
        store.stage("p", v, nodes, edges, (1, 1))
        store.promote("p", v)
    with pytest.raises(ValueError):
        store.stage("p", 3, nodes, edges)
    assert store.current("p") == 3 and store.snapshot("p")[1].first()["edge_id"] == "e"
    with pytest.raises(ValueError):
        store.stage("p", 4, nodes, edges.selectExpr("type", "src", "'zz' as dst", "occurrence_count", "edge_id"))
    with pytest.raises(ValueError):
        store.stage("p", 4, nodes, edges, (2, 1))
    assert store.rollback("p") == 2 and store.current("p") == 2
    with pytest.raises(ValueError):
        store.delete("p", 2)
    assert store.prune("p") == [1] and sorted(store.versions("p")) == [2, 3]
    assert len(list((tmp_path / "data").iterdir())) == 2
    store.delete_project("p")
    assert store.versions("p") == {} and store.current("p") is None


def test_communities_are_split_and_bounded(spark):
    """Two dense groups with one weak link stay apart; a star's leaves end with their centre."""
    import itertools

    dense = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i, j in itertools.combinations(range(5), 2)]
    star = [("s0", f"s{i}", 1.0) for i in range(1, 6)]
    e = spark.createDataFrame([*dense, ("x0", "y0", 1.0), *star], "a string, b string, w double")
    got = {r["id"]: r["community"] for r in graph.communities(e).collect()}
    assert {got[f"x{i}"] for i in range(5)} == {"x0"} and {got[f"y{i}"] for i in range(5)} == {"y0"}
    assert {got[f"s{i}"] for i in range(6)} == {"s0"}


def test_edge_core_is_greedy(spark):
    """As a scan in order of priority that takes both ends of an edge or none."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    rows = [("T", f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}", f"{i:04d}", rnd.randrange(3)) for i in range(200)]
    e = spark.createDataFrame(rows, "type string, src string, dst string, edge_id string, p int")
    for wanted in (1, 7, 20, 59, 100):
        taken: set = set()
        for r in sorted(rows, key=lambda r: (r[4], r[3])):
            new = {r[1], r[2]} - taken
            if len(taken) + len(new) <= wanted:
                taken |= new
            if len(taken) == wanted:
                break
        assert {r["id"] for r in graph.edge_core(e, F.col("p"), wanted).collect()} == taken


def test_community_rounds_deal_out_numbers(spark):
    """Long names are dealt out a few times in all, not in each round; more passes than a number has bits change nothing once nothing moves."""
    import random

    def shuffled() -> int:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)])
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rnd = random.Random(5)
    name = lambda i: f"{i:03d}" + "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400))
    rows = [(name(rnd.randrange(150)), name(150 + rnd.randrange(100)), 1.0) for _ in range(600)]
    e = spark.createDataFrame(rows, "a string, b string, w double")
    before = shuffled()
    got = {r["id"]: r["community"] for r in graph.communities(e, 4).collect()}
    assert set(got) == {x for r in rows for x in r[:2]} and set(got.values()) <= set(got)
    assert shuffled() - before < 15 * 600 * 400
    small = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "a string, b string, w double")
    assert {tuple(r) for r in graph.communities(small, 70).collect()} == {tuple(r) for r in graph.communities(small, 10).collect()}


def test_communities_as_plain_rounds(spark):
    """As the same rounds in plain Python; edges are dealt out packed, so few rows are, however many rounds there are."""
    import random

    rnd = random.Random(8)
    rows = [(f"o{rnd.randrange(900):03d}", f"p{rnd.randrange(300):03d}", float(rnd.randrange(1, 4))) for _ in range(4000)] + [("o001", "o001", 2.0), ("z", "z", 1.0), ("y", None, 1.0)]
    e = spark.createDataFrame(rows, "a string, b string, w double")
    passes, near, degree = 6, {}, {}
    for a, b, w in rows[:-1]:
        for x, y in {(a, b), (b, a)}:
            degree[x] = degree.get(x, 0.0) + w
            near.setdefault(x, {})[y] = near.setdefault(x, {}).get(y, 0.0) + w
    total = sum(w for *_, w in rows[:-1])
    bits = F.array(*[F.pmod(F.xxhash64(F.lit(p), "name"), F.lit(2)) for p in range(passes)])
    half = {r["name"]: r["h"] for r in spark.createDataFrame([(x,) for x in degree], "name string").select("name", bits.alias("h")).collect()}
    at = {x: x for x in degree}
    for step in range(2 * passes):
        moves, size, new = (moves if step % 2 else 0), {}, dict(at)
        for x, c in at.items():
            size[c] = size.get(c, 0.0) + degree[x]
        for x in degree:
            if half[x][step // 2] != step % 2:
                continue
            to = {at[x]: 0.0}
            for y, w in near[x].items():
                if y != x:
                    to[at[y]] = to.get(at[y], 0.0) + w
            gain = {c: w - degree[x] * (size[c] - (degree[x] if c == at[x] else 0.0)) / (2 * total) for c, w in to.items()}
            first, best = min((-round(g, 11), c) for c, g in gain.items())[1], max(gain.values())
            if best > gain[at[x]] + 1e-12 or (best >= gain[at[x]] - 1e-12 and first < at[x]):
                new[x] = first
        moves += sum(new[x] != at[x] for x in at)
        at = new
        if step % 2 and not moves:
            break
    label = {x: x for x in at}
    changed = True
    while changed:  # the parts that hang together, by their smallest names
        changed = False
        for x in at:
            low = min([label[x], *(label[y] for y in near[x] if at[y] == at[x])])
            changed, label[x] = changed or low < label[x], low

    def dealt() -> int:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)])
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = dealt()
    got = {r["id"]: r["community"] for r in graph.communities(e, passes).collect()}
    assert got == label and dealt() - before < 15 * len(rows)


def test_central_nodes_of_the_first_kinds(spark, tmp_path):
    """As all nodes ranked, whatever the limit; nodes of kinds that can't come first aren't dealt out."""
    rnd = random.Random(6)
    kinds = ["Method", "MenuItem", "Type", "File", None]
    rows = [(f"n{i:04d}" + "x" * (i % 3), rnd.choice(kinds), "n") for i in range(300)]
    links = [("CALLS", rnd.choice(rows)[0], rnd.choice(rows)[0], str(i)) for i in range(500)]
    n, e = spark.createDataFrame(rows, "id string, kind string, name string"), spark.createDataFrame(links, "type string, src string, dst string, edge_id string")
    degree = {r[0]: sum(r[0] in x[1:3] for x in links) for r in rows}
    place = lambda k: schema.CENTRAL.index(k) if k in schema.CENTRAL else len(schema.CENTRAL)
    want = sorted(((place(r[1]), -degree[r[0]], r[0]) for r in rows))
    for limit in (1, 60, 130, 1000):
        assert [(r["priority"], -r["degree"], r["id"]) for r in graph.central_nodes(n, e, limit).collect()] == want[:limit]

    def shuffled() -> int:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)])
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.range(20000).select(F.sha2(F.col("id").cast("string"), 512).alias("id"), F.when(F.col("id") < 50, "MenuItem").otherwise("File").alias("kind"), F.lit("n").alias("name")).write.parquet(f"{tmp_path}/nodes")
    before = shuffled()
    assert graph.central_nodes(spark.read.parquet(f"file://{tmp_path}/nodes"), e, 30).count() == 30
    assert shuffled() - before < 300_000
