"""Graph operators over nodes(id, kind, name) and edges(type, src, dst, occurrence_count, edge_id)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ids import edge_id
from ..schema import CENTRAL, central_priority, edge_weight
from ..storage import materialize


def incident(edges: DataFrame) -> DataFrame:
    """(center, neighbor, direction, type, edge_id): each edge from both ends, a self loop once."""
    out = edges.select(F.col("src").alias("center"), F.col("dst").alias("neighbor"), F.lit("outgoing").alias("direction"), "type", "edge_id")
    back = edges.where("src <> dst").select(F.col("dst").alias("center"), F.col("src").alias("neighbor"), F.lit("incoming").alias("direction"), "type", "edge_id")
    return out.unionByName(back)


def neighbors(edges: DataFrame, centers: DataFrame | None, per_node: int, types: list[str] | None = None) -> DataFrame:
    """The per_node strongest neighbours of each center: heavy edge classes first, then neighbour and edge id.

    Edges without a column edge_id have the id of functions.ids; it is made after they have been dealt out and most of them have gone.
    """
    bare = "edge_id" not in edges.columns
    near = incident(edges.withColumn("edge_id", F.lit(None).cast("string")) if bare else edges)
    if types:
        near = near.where(F.col("type").isin(types))
    if centers is not None:
        near = near.join(centers.select(F.col("id").alias("center")).distinct(), "center", "left_semi")
    order = [F.desc(edge_weight(F.col("type"))), "neighbor"]
    if bare:
        out = F.col("direction") == "outgoing"
        near = near.withColumn("_r", F.rank().over(W.partitionBy("center").orderBy(*order))).where(F.col("_r") <= per_node).drop("_r")  # ties stay
        near = near.withColumn("edge_id", edge_id(F.col("type"), F.when(out, F.col("center")).otherwise(F.col("neighbor")), F.when(out, F.col("neighbor")).otherwise(F.col("center"))))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("center").orderBy(*order, "edge_id"))).where(F.col("rank") <= per_node)


def directed_neighbors(edges: DataFrame, node: str, outgoing: bool, limit: int) -> DataFrame:
    here, there = ("src", "dst") if outgoing else ("dst", "src")
    return edges.where(F.col(here) == node).select(F.col(there).alias("neighbor"), "type", "edge_id").orderBy("type", "neighbor", "edge_id").limit(limit)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with their degree; a self loop counts once."""
    ends = incident(edges).groupBy(F.col("center").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def central_nodes(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` nodes by their kind's priority, then the degree and the id.

    Nodes are counted by priority first: those that come after `limit` others whatever their degree take no part.
    """
    first, last = 0, len(CENTRAL)
    for r in nodes.groupBy(central_priority(F.col("kind")).alias("priority")).count().orderBy("priority").collect():  # a row a priority
        first += r["count"]
        if first >= limit:
            last = r["priority"]
            break
    near = nodes.where(central_priority(F.col("kind")) <= last)
    return degrees(near, edges).withColumn("priority", central_priority(F.col("kind"))).orderBy("priority", F.desc("degree"), "id").limit(limit)


def breadth_first(edges: DataFrame, seeds: Iterable[str], depth: int) -> DataFrame:
    """(id, depth, parent, path): each node within `depth` undirected steps once, at its least depth.

    The path is the ids from the seed; among equals the smallest parent. Each layer is one join with
    the edges and an anti-join with what was seen, written to the shared folder; nothing comes to the driver.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0, None, s) for s in sorted(set(seeds))], "id string, depth int, parent string, path string")
    layer, near = F.broadcast(seen), incident(edges).select("center", "neighbor")  # the seeds are a list, so the edges stay where they are
    for step in range(1, depth + 1):
        reached = layer.select(F.col("id").alias("center"), F.col("path").alias("up")).join(near, "center")
        first = F.min(F.struct("center", "up"))
        layer = reached.groupBy(F.col("neighbor").alias("id")).agg(first.alias("m")).join(seen.select("id"), "id", "left_anti")
        layer = materialize(layer.select("id", F.lit(step).alias("depth"), F.col("m.center").alias("parent"), F.concat_ws(">", "m.up", "id").alias("path")), "layer")
        seen = seen.unionByName(layer)
    return seen


def trails(edges: DataFrame, longest: int) -> DataFrame:
    """(start, end, length, path): directed paths of 1 to `longest` edges, none used twice."""
    step = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("edge_id").alias("e"))
    path = edges.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("edge_id").alias("used"), F.concat_ws(">", "src", "dst").alias("path"))
    out = path
    for _ in range(longest - 1):
        path = path.join(step, path.end == step.s).where(~F.array_contains("used", F.col("e"))).select("start", F.col("d").alias("end"), F.array_append("used", F.col("e")).alias("used"), F.concat_ws(">", "path", "d").alias("path"))
        out = out.unionByName(path)
    return out.select("start", "end", F.size("used").alias("length"), "path")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among ids(id)."""
    i = ids.select("id").distinct()
    return edges.join(i.select(F.col("id").alias("src")), "src", "left_semi").join(i.select(F.col("id").alias("dst")), "dst", "left_semi")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, distinct types, repeated node ids and edges without an end.

    Nodes and the ends of edges are grouped by id once; edges are dealt out only if some end is no node's.
    """
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).select("id", F.lit(0).alias("n"))
    ids = nodes.select("id", F.lit(1).alias("n")).union(ends).where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    found = ids.agg(F.count_if(F.col("n") > 0).alias("distinct"), F.count_if(F.col("n") == 0).alias("missing")).first()
    n = nodes.agg(F.count("*").alias("nodes"), (F.count("*") - F.lit(found["distinct"])).alias("repeated_nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("open"))
    e = materialize(e, "counts")
    if found["missing"] or e.first()["open"]:
        known = nodes.select("id").distinct()
        lost = lambda end: edges.join(known, edges[end] == known.id, "left_anti").select("edge_id")
        dangling = lost("src").union(lost("dst")).distinct().agg(F.count("*").alias("dangling_edges"))
        return n.crossJoin(e.drop("open")).crossJoin(dangling)  # one row each
    return n.crossJoin(e.drop("open")).withColumn("dangling_edges", F.lit(0).cast("long"))  # one row each


def same_file(nodes: DataFrame, edges: DataFrame, centers: list[str], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of what lies in the files of the centers: nodes(id, kind, name, path) where the path may be null.

    The centers come first, with a path or without one, then the largest degree, then the id, `limit` in all; edges are
    those among them, 4 limit (20,000 at most) by id. counts has one row: all nodes, shown nodes, shown edges, and
    whether more would belong there.
    """
    own = F.col("id").isin(centers)
    paths = nodes.where(own & (F.trim("path") != "")).select("path").distinct()
    wanted = nodes.where(own).unionByName(nodes.where(~own).join(paths, "path", "left_semi").select(nodes.columns))
    near = incident(edges).join(wanted.select(F.col("id").alias("center")), "center", "left_semi").groupBy(F.col("center").alias("id")).agg(F.count("*").alias("degree"))
    eligible = wanted.join(near, "id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)).cast("long"), "center": own})
    shown = materialize(eligible.orderBy(F.desc("center"), F.desc("degree"), "id").limit(limit), "same-file")
    among = materialize(induced(edges, shown).orderBy("edge_id").limit(min(4 * limit, 20000)), "same-file")
    counts = nodes.agg(F.count("*").alias("total")).crossJoin(wanted.agg(F.count("*").alias("n"))).crossJoin(shown.agg(F.count("*").alias("nodes"))).crossJoin(among.agg(F.count("*").alias("edges")))  # one row each
    return shown, among, counts.select("total", "nodes", "edges", (F.col("n") > F.col("nodes")).alias("truncated"))


def edge_core(edges: DataFrame, priority: Column, nodes_wanted: int, sample: int = 20000) -> DataFrame:
    """Ids of the first edges' ends by priority until nodes_wanted: both ends of an edge or none.

    Over the first `sample` edges (the operator's own bound). Each end counts once, at its first edge, and an edge adds
    two at most; so the first edge that doesn't fit finds room for one end alone, and what can still be taken is
    the new end of the first later edge that brings just one.
    """
    first = edges.withColumn("_p", priority).orderBy("_p", "edge_id").limit(sample)
    placed = materialize(first.withColumn("at", F.row_number().over(W.orderBy("_p", "edge_id"))).select("at", "src", "dst"), "core")
    new = placed.select("at", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.min("at").alias("at"))
    steps = new.groupBy("at").agg(F.count("*").alias("n")).withColumn("sum", F.sum("n").over(W.orderBy("at")))
    over = steps.where(F.col("sum") > nodes_wanted).agg(F.min("at").alias("at")).first()["at"]
    if over is None:
        return new.select("id")
    taken = materialize(new.where(F.col("at") < over).select("id"), "core")
    if taken.count() == nodes_wanted:
        return taken
    ends = placed.where(F.col("at") >= over).select("at", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).join(F.broadcast(taken), "id", "left_anti")
    single = ends.groupBy("at").agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1")
    return taken.unionByName(single.orderBy("at").limit(1).select("id"))


def communities(edges: DataFrame, passes: int = 10) -> DataFrame:
    """(id, community) over weighted undirected edges (a, b, w); nodes without an edge have none.

    Modularity moves in passes: one half of the nodes, then the other (by hash), move to the neighbouring community of the best
    gain w(node, C) - degree * total(C) / 2m, the node itself taken out of its own; gains within 1e-12 go to the smaller
    name. It ends after a pass without a move, or after `passes`. Moves within a half are made at once rather than
    one after the other in the order of names, so results may differ from a sequential pass. Communities that the
    moves have left disconnected are split; each bears the name of its smallest member.

    Names are numbered in their order once, and the numbers dealt into parts of about a million edges. Edges lie packed by the
    parts of their ends, where one end is known. In a round each part asks for the totals of its communities, tells them along
    its edges to the nodes whose turn it is, packed by their parts, and these move; the round's table is written to the shared folder.
    """
    from .components import components

    spark = edges.sparkSession
    ends = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    e = materialize(ends.groupBy("a", "b").agg(F.sum("w").alias("w")), "weights")
    count, total = e.agg(F.count("*"), F.coalesce(F.nullif(F.sum("w"), F.lit(0.0)), F.lit(1.0))).first()
    # the halves that a node belongs to, dealt anew each pass, so that no two keep changing places: a bit a pass
    halves = [sum((F.shiftleft(F.pmod(F.xxhash64(F.lit(p), "name"), F.lit(2)), p - at) for p in range(at, min(passes, at + 62))), F.lit(0).cast("long")).alias(f"half{at // 62}") for at in range(0, passes, 62)]
    turns = [f"half{at // 62}" for at in range(0, passes, 62)]
    names = e.select(F.col("a").alias("name")).union(e.select("b")).distinct().orderBy("name")
    names = materialize(names.select(F.monotonically_increasing_id().alias("n"), "name", *halves), "names")  # numbers rise with the names
    # without gaps they take less room: those of a task start where the last one's end
    sizes = {r["at"]: r["count"] for r in names.groupBy(F.shiftright("n", 33).cast("int").alias("at")).count().collect()}
    starts = [sum(sizes.get(i, 0) for i in range(at)) for at in range(max(sizes, default=0) + 1)]
    names = names.withColumn("n", F.get(F.lit(starts).cast("array<bigint>"), F.shiftright("n", 33).cast("int")) + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    end = lambda x: names.select(F.col("name").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(h).alias(f"{x}_{h}") for h in turns])
    of = lambda o, n: [F.col(f"{o}_n").alias("o"), F.col(f"{n}_n").alias("n"), "w", *[F.col(f"{n}_{h}").alias(h) for h in turns]]
    e = materialize(e.join(end("a"), "a").join(end("b"), "b").drop("a", "b"), "weights")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + count // 1_000_000)
    pack, start, shares, sums, tell, move, unpack = community_steps(parts, 2 * total)
    place = lambda x: F.pmod(F.col(x), F.lit(parts))
    both = e.select(*of("a", "b")).union(e.where("a_n <> b_n").select(*of("b", "a")))
    degree = both.groupBy(F.col("o").alias("n")).agg(F.sum("w").alias("deg")).withColumn("k", place("n")).repartition(parts, "k")
    table = "k long, n binary, deg binary, c binary, moved long"
    state = materialize(degree.groupBy("k").applyInArrow(start, table), "moves")
    packed = both.where("o <> n").repartition(parts, place("o")).mapInArrow(pack, f"k long, t long, o binary, n binary, w binary, {', '.join(f'{h} binary' for h in turns)}")
    dealt = packed.repartition(parts, "k").sortWithinPartitions("k").persist(StorageLevel.DISK_ONLY)
    moves, none = 0, F.lit(None).cast("binary")
    for step in range(2 * passes):
        asked = state.mapInArrow(shares, "u long, k long, c binary, tot binary").repartition(parts, "u")
        totals = asked.groupBy("u").applyInArrow(sums, "k long, c binary, tot binary").select("k", none.alias("n"), none.alias("deg"), "c", "tot")
        known = state.select("k", "n", "deg", "c", none.alias("tot")).unionByName(totals).repartition(parts, "k")
        turn = dealt.select("k", "t", "o", "n", "w", F.col(turns[step // 2 // 62]).alias("half"), F.lit(step // 2 % 62).alias("bit"), F.lit(step % 2).alias("side"))
        told = turn.groupBy("k").cogroup(known.groupBy("k")).applyInArrow(tell, "t long, own boolean, n binary, c binary, tot binary, w binary").repartition(parts, "t")
        state = materialize(told.groupBy("t").applyInArrow(move, table), "moves")
        moves = (moves if step % 2 else 0) + (state.agg(F.sum("moved")).first()[0] or 0)
        if step % 2 and not moves:
            break
    each = state.mapInArrow(unpack, "n long, c long")
    told = e.where("a_n <> b_n").select("a_n", "b_n").join(each.select(F.col("n").alias("a_n"), F.col("c").alias("ca")), "a_n").join(each.select(F.col("n").alias("b_n"), F.col("c").alias("cb")), "b_n")
    inside = materialize(told.where("ca = cb").select(F.col("a_n").alias("a"), F.col("b_n").alias("b")), "inside")
    dealt.unpersist()
    label = components(inside)
    named = names.select("n", "name")
    found = named.join(label, named.n == label.node, "left").select("name", F.coalesce("label", "n").alias("n"))
    return found.join(named.select("n", F.col("name").alias("community")), "n").select(F.col("name").alias("id"), "community")


def community_steps(parts: int, double: float, block: int = 1 << 20) -> tuple[Callable, ...]:
    """The steps of a round of communities() over packed columns; nodes and communities lie in part number % parts.

    double: twice the weight of all edges. A part of the state is one row (k, n ascending, deg, c); about a million edges
    meet in a part, and `block` edges are packed at a time.
    """
    kinds = {**dict.fromkeys(("n", "c", "o", "half"), "i"), **dict.fromkeys(("w", "deg", "tot"), "f")}

    def short(x: np.ndarray) -> bytes:
        """The numbers in 4 bytes each where that loses nothing, else in 8; the last byte tells."""
        with np.errstate(all="ignore"):
            half = x.astype(f"{x.dtype.kind}4")
        x = half if (half == x).all() else x
        return x.tobytes() + bytes([x.itemsize])

    def rows(names: str, values: list[list]) -> pa.Table:
        """A table of rows; arrays are packed."""
        types = {"own": pa.bool_(), **{x: pa.int64() for x in ("k", "t", "u", "moved")}}
        columns = {c: [short(r[i]) if isinstance(r[i], np.ndarray) else r[i] for r in values] for i, c in enumerate(names.split())}
        return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in columns.items()})

    def lists(t: pa.Table | pa.RecordBatch, name: str) -> list[np.ndarray]:
        return [np.frombuffer(x, f"{kinds[name]}{x[-1]}", (len(x) - 1) // x[-1]).astype(f"{kinds[name]}8") for x in t.column(name).to_pylist()]

    def flat(t: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, f"{kinds[name]}8"), *lists(t, name)])

    def cuts(*keys: np.ndarray) -> np.ndarray:
        """Where a key differs from the one before it."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(new)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (o, n, w, halves) to rows by the parts of both ends."""

        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)]
            order = np.lexsort((cols[0], cols[0] % parts * parts + cols[1] % parts))  # known ends in order, as they are looked up
            cols = [x[order] for x in cols]
            k, t = cols[0] % parts, cols[1] % parts
            first = cuts(k, t)
            names = ["k", "t", *held[0].schema.names]
            out = [[int(k[a]), int(t[a]), *[x[a:z] for x in cols]] for a, z in zip(first, [*first[1:], len(k)], strict=True)]
            yield from rows(" ".join(names), out).to_batches(1000)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= block:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def start(t: pa.Table) -> pa.Table:
        """Nodes (n, deg, k) of a part to its first state, each node a community of its own."""
        n, deg = t.column("n").to_numpy(), t.column("deg").to_numpy()
        order = np.argsort(n)
        return rows("k n deg c moved", [[t.column("k")[0].as_py(), n[order], deg[order], n[order], 0]])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each part adds to the totals of its communities, by the communities' parts u."""
        for b in batches:
            for k, c, deg in zip(b.column("k").to_pylist(), lists(b, "c"), lists(b, "deg"), strict=True):
                own, at = np.unique(c, return_inverse=True)
                tot = np.bincount(at, deg)
                order = np.argsort(own % parts, kind="stable")
                own, tot = own[order], tot[order]
                first = cuts(own % parts)
                yield from rows("u k c tot", [[int(own[a] % parts), k, own[a:z], tot[a:z]] for a, z in zip(first, [*first[1:], len(own)], strict=True)]).to_batches()

    def sums(t: pa.Table) -> pa.Table:
        """The totals of a part's communities, for each part that asked."""
        asked = lists(t, "c")
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        tot = np.bincount(at, flat(t, "tot"))[at]
        ends = np.cumsum([len(c) for c in asked])
        return rows("k c tot", [[k, c, tot[z - len(c) : z]] for k, c, z in zip(t.column("k").to_pylist(), asked, ends, strict=True)])

    def tell(edges: pa.Table, known: pa.Table) -> pa.Table:
        """A part's edges, state and totals to what the nodes whose turn it is are told, by their part t, and the part's own nodes."""
        is_state = known.column("n").is_valid()
        mine, totals = known.filter(is_state), known.filter(known.column("n").is_null())
        n, c, deg, all_c, all_tot = flat(mine, "n"), flat(mine, "c"), flat(mine, "deg"), flat(totals, "c"), flat(totals, "tot")
        order = np.argsort(all_c)
        tot = all_tot[order][np.searchsorted(all_c[order], c)]
        out = [[mine.column("k")[0].as_py(), True, n, c, tot, deg]]
        for i, t in enumerate(edges.column("t").to_pylist()):
            row = edges.slice(i, 1)
            on = (flat(row, "half") >> row.column("bit")[0].as_py()) & 1 == row.column("side")[0].as_py()
            if on.any():
                at = np.searchsorted(n, flat(row, "o")[on])
                out.append([t, False, flat(row, "n")[on], c[at], tot[at], flat(row, "w")[on]])
        return rows("t own n c tot w", out)

    def move(told: pa.Table) -> pa.Table:
        """A part's nodes to their new communities: of the best gain, gains within 1e-12 to the smaller number."""
        own = told.filter(told.column("own"))
        node, c, tot, deg = (flat(own, x) for x in ("n", "c", "tot", "w"))
        told = told.filter(pa.array([not x for x in told.column("own").to_pylist()], pa.bool_()))
        n, near, total, w = (flat(told, x) for x in ("n", "c", "tot", "w"))
        new = c.copy()
        if len(n):
            at, (far, by) = np.searchsorted(node, n), np.unique(near, return_inverse=True)
            order = np.argsort(at * len(far) + by)
            at, near, total, w = (x[order] for x in (at, near, total, w))
            first = cuts(at, near)
            at, near, total, to = at[first], near[first], np.maximum.reduceat(total, first), np.add.reduceat(w, first)
            here = near == c[at]
            gain = to - deg[at] * (total - np.where(here, deg[at], 0.0)) / double
            stay = 0.0 - deg * (tot - deg) / double
            stay[at[here]] = gain[here]
            first = cuts(at)
            each = np.repeat(np.arange(len(first)), np.diff([*first, len(at)]))
            at = at[first]
            gains, stays = np.round(gain, 11), np.round(stay[at], 11)
            top = np.maximum.reduceat(gains, first)
            to_c = np.minimum.reduceat(np.where(gains == top[each], near, np.iinfo(np.int64).max), first)
            to_c = np.where(top > stays, to_c, np.where(top < stays, c[at], np.minimum(to_c, c[at])))
            best = np.maximum(np.maximum.reduceat(gain, first), stay[at])
            go = (best > stay[at] + 1e-12) | ((best >= stay[at] - 1e-12) & (to_c < c[at]))
            new[at[go]] = to_c[go]
        return rows("k n deg c moved", [[own.column("t")[0].as_py(), node, deg, new, int((new != c).sum())]])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state's parts as rows (n, c)."""
        for b in batches:
            for n, c in zip(lists(b, "n"), lists(b, "c"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c)], names=["n", "c"])

    return pack, start, shares, sums, tell, move, unpack


def community_reports(members: DataFrame, nodes: DataFrame, entry_kinds: list[str], table_kinds: list[str], most: int = 20) -> DataFrame:
    """(community, community_id, members, kinds, title, tables, entries): a row for each community of (id, community).

    kinds: its kinds with their counts, most frequent first; title: the first name by member that isn't blank; tables
    and entries: the first `most` names of such kinds.
    """
    m = members.join(nodes, "id").select("community", "id", "kind", "name")
    by_kind = m.groupBy("community", "kind").agg(F.count("*").alias("n")).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind", "n"))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",").alias("kinds"))
    whole = m.groupBy("community").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("members"), F.min_by("name", F.when(F.trim("name") != "", F.col("id"))).alias("title"))

    def some(kinds: list[str], name: str) -> DataFrame:
        ranked = m.where(F.col("kind").isin(kinds)).withColumn("k", F.row_number().over(W.partitionBy("community").orderBy("name", "id"))).where(F.col("k") <= most)
        return ranked.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ",").alias(name))

    from ..functions.ids import community_id

    out = whole.join(by_kind, "community").join(some(table_kinds, "tables"), "community", "left").join(some(entry_kinds, "entries"), "community", "left")
    return out.select("community", community_id(F.col("ids")).alias("community_id"), "members", "kinds", "title", F.coalesce("tables", F.lit("")).alias("tables"), F.coalesce("entries", F.lit("")).alias("entries"))


def expansion(edges: DataFrame, seeds: DataFrame, depth: int = 3, budget: int = 80, per_node: int = 20, decay: float = 0.85, types: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes (id, depth, score), edges (edge_id, type) seen, truncated) around scored seeds (id, score), best first, at most `budget` nodes.

    Layer by layer, each node offers its per_node strongest neighbours its own score times decay. New nodes are
    taken by the best center's score, then that center's id and the neighbour's rank, while the budget lasts. A
    seed keeps its score. With types given, only such edges are walked (the backbone chase). The edges seen are those
    of all offers, whether or not their other ends are taken; truncated tells that the budget is used up. A layer's
    offers, budget times per_node at most, are written once for both.
    """
    best = seeds.where("id is not null").groupBy("id").agg(F.max("score").cast("double").alias("score"))
    seen = materialize(best.orderBy(F.desc("score"), "id").limit(budget).select("id", F.lit(0).alias("depth"), "score"), "expand")
    layer, count, walked = seen, seen.count(), edges.select("edge_id", "type").limit(0)
    for step in range(1, depth + 1):
        if count >= budget:
            break
        scores = F.broadcast(layer.select(F.col("id").alias("center"), "score"))  # `budget` rows at most
        offers = materialize(neighbors(edges, F.broadcast(layer), per_node, types).join(scores, "center").select("center", "neighbor", "rank", "score", "edge_id", "type"), "offers")
        place = F.struct((-F.col("score")).alias("low"), F.col("center"), F.col("rank"))
        new = offers.groupBy(F.col("neighbor").alias("id")).agg(F.min(place).alias("at")).join(F.broadcast(seen.select("id")), "id", "left_anti")
        layer = materialize(new.orderBy("at", "id").limit(budget - count).select("id", F.lit(step).alias("depth"), (-F.col("at.low") * decay).alias("score")), "expand")
        seen, walked = seen.unionByName(layer), walked.unionByName(offers.select("edge_id", "type"))
        more = layer.count()
        count += more
        if not more:
            break
    return seen, walked.distinct(), count >= budget


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 3, budget: int = 80, per_node: int = 20, decay: float = 0.85, types: list[str] | None = None) -> DataFrame:
    """(id, depth, score): the nodes of expansion()."""
    return expansion(edges, seeds, depth, budget, per_node, decay, types)[0]


def visual_neighbors(nodes: DataFrame, edges: DataFrame, seeds: Iterable[str], depth: int, limit: int, mode: str = "all", kinds: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(id, depth): what lies within 1 to 4 steps of the seeds, `limit` nodes at most, nearest first and then by id.

    mode: all, in, out, callers (in, CALLS alone) or callees (out, CALLS alone). kinds and types restrict the nodes
    that are reached and the edges that are walked.
    """
    e = edges.where(F.col("type").isin(types)) if types else edges
    if mode in ("callers", "callees"):
        e = e.where("type = 'CALLS'")
    near = incident(e)
    if mode != "all":
        near = near.where(F.col("direction") == ("incoming" if mode in ("in", "callers") else "outgoing"))
    if kinds:
        near = near.join(nodes.where(F.col("kind").isin(kinds)).select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in sorted(set(seeds))], "id string, depth int")
    layer, near = F.broadcast(seen), near.select("center", "neighbor")  # the seeds are a list
    for step in range(1, min(4, max(1, depth)) + 1):
        reached = near.join(layer.select(F.col("id").alias("center")), "center").select(F.col("neighbor").alias("id")).distinct()
        layer = materialize(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)), "visual")
        seen = seen.unionByName(layer)
        if seen.limit(limit + 1).count() > limit:
            break
    return seen.orderBy("depth", "id").limit(limit)


def visual_graph(nodes: DataFrame, edges: DataFrame, limit: int, priority: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a bounded view: the ends of the first edges by priority, filled up by degree, and the edges among them."""
    core = edge_core(edges, priority, limit, min(4 * limit, 20000))
    ranked = degrees(nodes, edges).join(core.withColumn("core", F.lit(0)), "id", "left")
    shown = materialize(ranked.orderBy(F.coalesce("core", F.lit(1)), F.desc("degree"), "id").limit(limit).select("id", "kind", "name", "degree"), "view")
    return shown, induced(edges, shown).orderBy("edge_id").limit(4 * limit)


def complete_endpoints(shown: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """ids of shown(id), and the missing ends of edges(src, dst) in order of id until there are `limit` in all."""
    missing = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(shown.select("id"), "id", "left_anti")
    return shown.select("id", F.lit(0).alias("_o")).unionByName(missing.select("id", F.lit(1).alias("_o"))).orderBy("_o", "id").limit(limit).select("id")


def highlight(edges: DataFrame, node: str) -> DataFrame:
    """The node and its neighbours."""
    return incident(edges.where((F.col("src") == node) | (F.col("dst") == node))).where(F.col("center") == node).select(F.col("neighbor").alias("id")).union(edges.sparkSession.createDataFrame([(node,)], "id string")).distinct()


def touching(edges: DataFrame, ids: DataFrame, types: list[str]) -> DataFrame:
    """Both ends, distinct, of the edges of the given types that touch any of ids(id)."""
    i = ids.select("id").distinct()
    e = edges.where(F.col("type").isin(types))
    hit = e.join(i.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").union(e.join(i.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return hit.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def node_by_id(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The node with its degree; only edges that touch it are read."""
    return degrees(nodes.where(F.col("id") == node), edges.where((F.col("src") == node) | (F.col("dst") == node)))


def edge_between(edges: DataFrame, src: str, dst: str, type_: str) -> DataFrame:
    return edges.where((F.col("type") == type_) & (F.col("src") == src) & (F.col("dst") == dst))


def one_hop(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The node's edges in both directions; the node alone, without a neighbour, where it has none."""
    near = incident(edges.where((F.col("src") == node) | (F.col("dst") == node))).where(F.col("center") == node)
    return nodes.where(F.col("id") == node).select(F.col("id").alias("center")).join(near, "center", "left")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges there are."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def trace_paths(edges: DataFrame, node: str, depth: int, per_node: int = 40, most: int = 80, types: list[str] | None = None) -> DataFrame:
    """(id, depth, place, path): the path by which each node around the given one is first found, `most` of them.

    Layer by layer (8 at most) along each node's per_node strongest edges, nodes of a layer in order of their finding.
    A step of a path names the edge's type and direction. Nodes beyond `most` aren't walked on from.
    """
    spark = edges.sparkSession
    seen = layer = spark.createDataFrame([(node, 0, 0, node)], "id string, depth int, place int, path string")
    left = most
    for step in range(1, min(8, max(1, depth)) + 1):
        at = F.broadcast(layer.select(F.col("id").alias("center"), F.col("place").alias("up"), "path"))  # `most` rows at most
        near = neighbors(edges, F.broadcast(layer), per_node, types).join(at, "center")
        said = F.concat("path", F.lit(" -["), "type", F.lit(" "), "direction", F.lit("]-> "), "neighbor")
        first = near.groupBy(F.col("neighbor").alias("id")).agg(F.min(F.struct("up", "rank", said.alias("path"))).alias("m")).join(F.broadcast(seen.select("id")), "id", "left_anti")
        top = first.orderBy("m.up", "m.rank", "id").limit(left)
        order = W.orderBy("m.up", "m.rank", "id")  # of the few that are left
        layer = materialize(top.select("id", F.lit(step).alias("depth"), F.row_number().over(order).alias("place"), F.col("m.path").alias("path")), "trace")
        seen = seen.unionByName(layer)
        left -= layer.count()
        if left <= 0:
            break
    return seen.where("depth > 0")
