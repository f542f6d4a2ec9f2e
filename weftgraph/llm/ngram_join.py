"""N-gram Jaccard join with parity sketches.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence as one). Every shingle
toggles one bit of a wide bit sketch, so two sketches differ in at most as many bits as the sets have
elements apart. At Jaccard 0.8 the sets of sizes a and b are at most D = (a + b) / 9 elements apart.
Sizes are banded; in a band whose largest size is h, D = 2h / 9 and the sketch is cut into P > D parts, so at
least P - D parts of a linking pair agree (pigeonhole). A part is stored as the XOR of its toggled positions.

* Equal sets collapse to one class first, so exact copies never meet each other.
* A class drops its q = P - D - 1 least selective parts (fewest toggled bits, then by hash). The order is the
  same for everyone, so of the P - D agreeing parts the best one stays on both sides: no link is lost.
* Part keys travel as packed blocks, a few bytes a key; a reducer names, for each key, its smallest class as
  the leader. A linking pair therefore meets under at least one common leader. A key that HOT_RUN classes of one
  block share goes to its reducer once for the block, as its smallest class; the block's classes learn the leader
  from that class afterwards, so a key of a third of all classes is no reducer's load.
* The followers of a leader are compared in blocks of bounded size, with the leader in each. A first pass has only
  dense parity sketches and drops the followers whose Hamming distance to every other is above D; the second has the
  sets and takes the exact intersection of pairs that are not connected yet. What leaves a block is a spanning set of
  links, never all pairs.
* Where a leader has more than one block, only the followers outside its largest connected part go on: they are
  compared with each other and with that part, block by block. A group of near copies that all reach the leader ends
  after the first round, in proportion to its size; g followers of which u are left make about 2 u g / BLOCK rows more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, materialize, mix, shingles, small_side

BAND = 1.35
SLACK = 0.12
BLOCK = 1024
KEYS_PER_BUCKET = 1_000_000
KEYS_HELD = 1_500_000
HOT_RUN = 128
SLAB = 1024
LEAST_BITS, MOST_BITS = 512, 1 << 16


def band_edges(largest: int) -> np.ndarray:
    """Lower edges of the size bands, up to past the largest size."""
    edges = [1]
    while edges[-1] <= largest * 2:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * BAND))))
    return np.array(edges)


def _scheme(edges: np.ndarray, band: int) -> tuple[int, int]:
    """(parts, how many of them a class may drop) in a band."""
    apart = 2 * (int(edges[band + 1]) - 1) // 9
    drop = int(SLACK * apart)
    return apart + 1 + drop, drop


def part_keys(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The uint64 keys under which a set can meet every set that links with it (none if only equal sets can)."""
    n, out = len(h), []
    own = int(np.searchsorted(edges, n, "right")) - 1
    for band in (own, own + 1):
        if band > own and n * 5 // 4 < edges[band]:
            break
        parts, drop = _scheme(edges, band)
        if parts <= 1:
            continue
        place = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place.astype(np.int64), minlength=parts)
        full = np.flatnonzero(counts)
        value = np.zeros(parts, np.uint64)
        value[full] = np.bitwise_xor.reduceat(mix(h[order] + np.uint64(1)), np.cumsum(counts)[full] - counts[full])
        key = mix(mix(value ^ (np.arange(parts, dtype=np.uint64) << np.uint64(20))) + np.uint64(band))
        keep = np.lexsort((key, counts))[drop:]
        out.append(key[keep])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def dense_sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles in each of about 4 bits a shingle, packed; its halves XOR to the sketch of half as many bits."""
    bits = LEAST_BITS
    while bits < min(4 * len(h), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((h >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def close_pairs(size: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, Hamming distance), x < y, of all pairs whose sizes and sketches allow a link."""
    width = np.array([len(s) for s in sketches])
    xs, ys, ds = [], [], []
    for w in np.unique(width):
        at = np.flatnonzero((width == w) | (width == 2 * w))
        raw = [np.frombuffer(sketches[k], np.uint8) for k in at]
        packed = np.stack([r if len(r) == w else r[:w] ^ r[w:] for r in raw])
        ones, both = np.zeros(len(at), np.float32), np.zeros((len(at), len(at)), np.float32)
        for k in range(0, w, SLAB):  # wide sketches by slabs, so that the unpacked bits stay small
            bits = np.unpackbits(packed[:, k : k + SLAB], axis=1).astype(np.float32)
            ones += bits.sum(1)
            both += bits @ bits.T
        far = ones[:, None] + ones[None, :] - 2 * both
        n, own = size[at], width[at] == w
        near = (far <= (n[:, None] + n[None, :]) // 9) & (5 * np.minimum(n[:, None], n[None, :]) >= 4 * np.maximum(n[:, None], n[None, :])) & (own[:, None] | own[None, :])
        x, y = np.nonzero(np.triu(near, 1))
        xs.append(at[x])
        ys.append(at[y])
        ds.append(far[x, y])
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ds)


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            names = [_digest(s) if len(s) else None for s in sets]
            yield {"doc_id": b.column("doc_id"), "n_shingles": [len(s) for s in sets], "cls": names, "m": [None if x is None else _short(x) for x in names], "sketch": [dense_sketch(s) if len(s) else None for s in sets]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_shingles long, cls binary, m long, sketch binary")


def _blocks(docs: DataFrame, text_col: str, buckets: int, largest: int) -> DataFrame:
    """Packed part keys by bucket: classes, for each key its 40 bits and its class, and the places of shared runs' smallest classes.

    Buckets below 0 hold the runs: the classes of a block that share a key; low has the key, high their smallest.
    """
    edges = band_edges(largest)
    columns = ["bucket", "ids", "low", "high", "local", "heads"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[int, int] = {}
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            names = np.fromiter(ids, np.int64, len(ids))
            key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            whole = ((key % np.uint64(buckets)) << np.uint64(40)) | ((key // np.uint64(buckets)) & np.uint64((1 << 40) - 1))
            order = np.argsort(whole)
            whole, owner = whole[order], owner[order]
            start = np.concatenate(([0], np.flatnonzero(whole[1:] != whole[:-1]) + 1))
            stop = np.append(start[1:], len(whole))
            keep, head, rows = np.ones(len(whole), bool), np.zeros(len(whole), bool), []
            for s, e in zip(start[stop - start >= HOT_RUN].tolist(), stop[stop - start >= HOT_RUN].tolist(), strict=True):
                members = names[owner[s:e]]
                least, keep[s:e] = s + int(members.argmin()), False
                keep[least] = head[least] = True
                rows.append((-1 - int((int(whole[s]) ^ int(members.min())) % (1 << 30)), members.tobytes(), whole[s : s + 1].tobytes(), members.min().tobytes(), None, None))
            whole, owner, head = whole[keep], owner[keep], head[keep]
            cut = np.searchsorted(whole >> np.uint64(40), np.arange(buckets + 1))
            for k in range(buckets):
                if cut[k] < cut[k + 1]:
                    at = slice(cut[k], cut[k + 1])
                    used, local = np.unique(owner[at], return_inverse=True)
                    low, high = (whole[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((whole[at] >> np.uint64(32)) & np.uint64(255)).astype(np.uint8)
                    rows.append((k, names[used].tobytes(), low.tobytes(), high.tobytes(), local.astype(np.uint16).tobytes(), np.flatnonzero(head[at]).astype(np.uint32).tobytes()))
            return pd.DataFrame(rows, columns=columns)

        for b in batches:
            for t in b["text"]:
                h = shingles(t)
                if len(h) < 4:
                    continue
                name = _short(_digest(h))
                if name in ids:
                    continue
                k = part_keys(h, edges)
                if not len(k):
                    continue
                ids[name] = len(ids)
                keys.append(k)
                held += len(k)
                if held > KEYS_HELD or len(ids) >= 60_000:
                    yield flush()
                    ids, keys, held = {}, [], 0
        if keys:
            yield flush()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "bucket int, ids binary, low binary, high binary, local binary, heads binary")


def _leaders(g: pd.DataFrame) -> pd.DataFrame:
    """(m, r, run, kind) of one bucket: each class with the smallest class that shares a key with it (kind 0).

    Of a run: its classes with their smallest (kind 1), and that one with the key's leader (kind 2).
    """
    out = []
    if g["bucket"].iloc[0] < 0:
        out = [pd.DataFrame({"m": np.frombuffer(i, np.int64), "r": np.frombuffer(h, np.int64)[0], "run": np.frombuffer(k, np.int64)[0], "kind": 1}) for i, k, h in zip(g["ids"], g["low"], g["high"], strict=True)]
    else:
        name = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(x, np.uint16)] for i, x in zip(g["ids"], g["local"], strict=True)])
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in g["low"]]).astype(np.uint64) | (np.concatenate([np.frombuffer(x, np.uint8) for x in g["high"]]).astype(np.uint64) << np.uint64(32))
        sizes = np.array([len(x) // 4 for x in g["low"]])
        heads = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + at for x, at in zip(g["heads"], np.cumsum(sizes) - sizes, strict=True)])
        is_head = np.zeros(len(key), bool)
        is_head[heads] = True
        order = np.lexsort((name, key))
        key, name, is_head = key[order], name[order], is_head[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        leader = name[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        apart = leader != name
        out.append(pd.DataFrame({"m": name[apart], "r": leader[apart], "run": 0, "kind": 0}).drop_duplicates())
        run = key[is_head].astype(np.int64) | (np.int64(g["bucket"].iloc[0]) << np.int64(40))
        out.append(pd.DataFrame({"m": name[is_head], "r": leader[is_head], "run": run, "kind": 2}).drop_duplicates())
    return pd.concat(out)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def spanning_links(names: list, sets: list[np.ndarray], side: np.ndarray, cross: bool) -> list[tuple]:
    """A spanning set of the links among the sets (cross: only between the two sides)."""
    n = len(names)
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    size = np.array([len(s) for s in sets], np.int64)
    x, y, far = close_pairs(size, [dense_sketch(s) for s in sets])
    order = np.argsort(far, kind="stable")
    pairs = zip(x[order].tolist(), y[order].tolist(), strict=True)
    out = []
    for x, y in pairs:
        if cross and side[x] == side[y]:
            continue
        a, b = root(x), root(y)
        if a != b and names[x] != names[y] and _linked(sets[x], sets[y]):
            up[max(a, b)] = min(a, b)
            out.append((names[x], names[y]))
    return out


def _by_group(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (r, i, j); a group may go on in the next batch."""
    held: pd.DataFrame | None = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if b.empty:
            continue
        key = b[["r", "i", "j"]].to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        cuts = [0, *change.tolist()]
        out = [x for s, e in zip(cuts, cuts[1:], strict=False) for x in work(b.iloc[s:e])]
        held = b.iloc[cuts[-1] :]
        yield pd.DataFrame(out, columns=columns)
    if held is not None:
        yield pd.DataFrame(work(held), columns=columns)


def _sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The followers that some other follower of the group may link with, by their sketches."""

    def work(g: pd.DataFrame) -> list[tuple]:
        side, cross = g["blk"].to_numpy(), g["i"].iloc[0] != g["j"].iloc[0]
        x, y, _ = close_pairs(g["n"].to_numpy(), list(g["sketch"]))
        if cross:
            x, y = x[side[x] != side[y]], y[side[x] != side[y]]
        cls, head = list(g["cls"]), (g["r"].iloc[0], g["i"].iloc[0], g["j"].iloc[0])
        return [(*head, side[k], cls[k]) for k in np.unique(np.concatenate([x, y])).tolist()]

    return _by_group(batches, work, ["r", "i", "j", "blk", "cls"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def work(g: pd.DataFrame) -> list[tuple]:
        return spanning_links(list(g["cls"]), [np.frombuffer(x, np.uint64) for x in g["hashes"]], g["blk"].to_numpy(), bool(g["i"].iloc[0] != g["j"].iloc[0]))

    return _by_group(batches, work, ["a", "b"])


def _remaining(pairs: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """(r, m, blk, i, j): what is left to compare of the large groups after their blocks' own links, whose parts are label(node, label).

    The largest connected part of a group is its core. Blocks 0 to u - 1 are of the rest, u and on of the core; a rest
    block meets itself, every other rest block and every core block, and core blocks don't meet.
    """
    members = pairs.union(pairs.select("r", "r").distinct()).join(classes.select("m", F.hex("cls").alias("node")), "m").join(label, "node", "left")
    members = materialize(members.select("r", "m", F.coalesce("label", "node").alias("label")), "members")
    parts = members.groupBy("r", "label").agg(F.count("*").alias("part"))
    core = parts.groupBy("r").agg(F.max_by("label", F.struct("part", "label")).alias("core"), F.sum("part").alias("all"), F.max("part").alias("most"))
    core = core.where(F.col("all") > F.col("most")).select("r", "core", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("u"), F.ceil(F.col("most") / BLOCK).cast("int").alias("c"))
    rows = members.join(small_side(materialize(core, "cores")), "r")
    key, u, c = F.xxhash64("m"), F.col("u"), F.col("c")
    rest = rows.where(F.col("label") != F.col("core")).withColumn("blk", F.pmod(key, u).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), u + c - 1)))
    rest = rest.select("r", "m", "blk", F.when(F.col("o") < u, F.least("blk", "o")).otherwise(F.col("blk")).alias("i"), F.when(F.col("o") < u, F.greatest("blk", "o")).otherwise(F.col("o")).alias("j"))
    held = rows.where(F.col("label") == F.col("core")).withColumn("blk", (u + F.pmod(key, c)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), u - 1)))
    return rest.union(held.select("r", "m", "blk", "i", F.col("blk").alias("j")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_class): the component is the smallest doc_id reachable by links.

    Two documents link when the Jaccard similarity of their shingle sets is 0.8 or more. A null or empty
    text has no shingles and links with nothing (its component is its own id). Repeated rows stay, each with
    its class; a null doc_id never names a component, but a text that only rows without an id have links like any
    other (where no text of a component has an id, component_id is null). Other columns are ignored, whatever their names.
    """
    rows = materialize(_classes(docs, id_col, text_col), "shingled")
    total, largest = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.max("n_shingles"), F.lit(1))).first()
    classes = rows.where("cls is not null").groupBy("cls", "m").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_class"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    buckets = max(32, -(-int(total) * 6 // 10 // KEYS_PER_BUCKET))
    met = materialize(_blocks(docs, text_col, buckets, int(largest)).groupBy("bucket").applyInPandas(_leaders, "m long, r long, run long, kind int"), "leaders")
    heads = small_side(met.where("kind = 2").select("run", F.col("m").alias("head"), F.col("r").alias("top")).distinct())
    in_runs = met.where("kind = 1").withColumnRenamed("r", "head").join(heads, ["run", "head"]).select("m", F.col("top").alias("r")).where("m <> r")
    pairs = materialize(met.where("kind = 0").select("m", "r").union(in_runs).distinct(), "pairs")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            names = [_digest(s) for s in sets]
            yield pd.DataFrame({"cls": names, "hashes": [s.tobytes() for s in sets]}).drop_duplicates("cls")

    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    grouped = lambda d: d.repartition(spread, "r", "i", "j").sortWithinPartitions("r", "i", "j")
    bodies = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def compared(placed: DataFrame) -> DataFrame:
        """Links (a, b) that span those within each group (r, i, j) of rows (r, i, j, blk, m), blk telling the sides where i <> j."""
        light = placed.join(classes.select("m", "cls", "n", "sketch"), "m").select("r", "i", "j", "blk", "cls", "n", "sketch")
        left = materialize(grouped(light).mapInPandas(_sift, "r long, i int, j int, blk int, cls binary"), "sifted")
        wanted = materialize(classes.join(left.select("cls").distinct(), "cls", "left_semi").select(F.col("first_id").alias("doc_id"), "cls"), "wanted")
        named = small_side(wanted.select("doc_id").where("doc_id is not null"))
        sets = bodies.join(named, "doc_id", "left_semi").mapInPandas(features, "cls binary, hashes binary")
        nameless = wanted.where("doc_id is null").select("cls")
        if nameless.limit(1).count():
            # texts that only rows without an id have: found by what they hold
            unnamed = bodies.where("doc_id is null").mapInPandas(features, "cls binary, hashes binary")
            sets = sets.union(unnamed.join(small_side(nameless), "cls", "left_semi"))
        sets = sets.dropDuplicates(["cls"])
        return materialize(grouped(left.join(sets, "cls").select("r", "i", "j", "blk", "cls", "hashes")).mapInPandas(_compare, "a binary, b binary").select(F.hex("a").alias("a"), F.hex("b").alias("b")), "near")

    large = materialize(pairs.groupBy("r").agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    several = small_side(large)
    blk = F.pmod(F.xxhash64("m"), F.coalesce("blocks", F.lit(1))).cast("int")
    each = pairs.join(several, "r", "left").select("r", "m", blk.alias("blk"))
    tops = pairs.select("r").distinct().join(several, "r", "left").select("r", F.col("r").alias("m"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("blk"))
    joined = components(compared(each.union(tops).select("r", "m", "blk", F.col("blk").alias("i"), F.col("blk").alias("j"))))
    if large.limit(1).count():
        more = compared(_remaining(pairs.join(several.drop("blocks"), "r", "left_semi"), classes, joined))
        # the parts found so far are the nodes of the second search
        of = joined.select("node", "label")
        ends = more.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        wider = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("wide"))
        nodes = of.union(wider.select("label", "label")).distinct()
        joined = nodes.join(wider, "label", "left").groupBy("node").agg(F.min(F.coalesce("wide", "label")).alias("label"))
    found = classes.select("cls", "first_id", "n_class").withColumn("node", F.hex("cls")).join(joined, "node", "left").select("cls", "first_id", "n_class", F.coalesce("label", "node").alias("label"))
    lowest = found.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = found.join(lowest, "label").select("cls", "component_id", "n_class")
    known = rows.where("cls is not null").join(named, "cls").select("doc_id", "n_shingles", "component_id", "n_class")
    return known.union(rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id"), F.lit(1).cast("long")))
