"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing in bands of norms.

Rows lie in BANDS bands, each of norms between M and M / RATIO for its own M. In a band a row x gets one more component,
sqrt(M^2 - |x|^2), and a query is brought to the length M and gets 0 there, so that the smallest Euclidean distance
is the largest inner product. A table has HASHES functions floor((a.x + b) / w) with Gaussian a (2-stable); the bucket
is the band and the tuple of their values. A query visits its own bucket and perturbed ones in order of estimated
success: the sum over the changed functions of the squared distance to the bucket's edge, smallest first. Each
bucket's exact best K by inner product on the original vectors are merged over buckets, tables and bands.

The number of functions a table has (one of HASHES), each band's width w and its probes (none, if the band's norms are
too small to matter) are fitted on a bounded sample (SAMPLE vectors) to reach RECALL of the sample's true neighbours
with the least work at the size of the whole table: rows compared, and SHIP times the query vectors sent to buckets. A
band with fewer than FEW rows in the sample is small, and every query is compared with all of it. Every vector is
indexed. Buckets split into blocks of members and of queries, so a hot bucket is many tasks; a block's product is one
small matrix product. Queries whose buckets held fewer than K candidates (or than all there are) are compared exactly
with all rows, in such blocks; so are all queries where no shape reaches LEAST_RECALL on the sample within the last of
PROBE_STEPS.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window as W

from .common import hashed_sample, materialize

K = 20
TABLES = 2
HASHES = (2, 4, 6)
SAMPLE = 3000
RECALL = 0.97
LEAST_RECALL = 0.93
SHIP = 2000
BLOCK_VALUES = 1 << 19
BANDS, RATIO = 12, 2**0.5
FEW = 40
PROBE_STEPS = (1, 2, 4, 6, 9, 16, 24, 32, 48, 64, 96, 128, 192, 256)


def _functions(dim: int, hashes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(TABLES, hashes, dim)), rng.random((TABLES, hashes))


def _bands(x: np.ndarray, most: float) -> np.ndarray:
    """The band of each row: 0 for norms over most / RATIO, and so on; the last one takes all smaller norms."""
    apart = np.log(most / np.sqrt((x * x).sum(1))) / np.log(RATIO)
    return np.clip(np.floor(apart + 1e-9), 0, BANDS - 1).astype(int)


def _tops(most: float) -> np.ndarray:
    """Each band's largest norm, a little more than that, so that rounding leaves no row above it."""
    return most * RATIO ** -np.arange(BANDS) * (1 + 1e-6)


def _rows_in(x: np.ndarray, top: np.ndarray | float) -> np.ndarray:
    """Rows with the component that brings each to its band's top."""
    return np.hstack([x, np.sqrt(np.maximum(0, top**2 - (x * x).sum(1)))[:, None]])


def _queries_in(x: np.ndarray, top: float) -> np.ndarray:
    """Queries at a band's top, with 0 in the rows' last component: their lengths play no part in what is nearest."""
    return np.hstack([x * (top / np.sqrt((x * x).sum(1)))[:, None], np.zeros((len(x), 1))])


def _buckets(x: np.ndarray, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(rows, tables, hashes) places on the functions' lines; the slot is the integer part."""
    return (x @ a.reshape(-1, a.shape[2]).T).reshape(len(x), *a.shape[:2]) / width + b


def _matrix(vectors: Iterable) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors])


def probes(place: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """The first `count` perturbations (tuples of -1, 0, 1 by function) in order of estimated success, the bucket itself first."""
    n = len(place)
    steps = sorted([(p * p, i, -1) for i, p in enumerate(place)] + [((1 - p) ** 2, i, 1) for i, p in enumerate(place)])
    out, heap, seen = [tuple([0] * n)], [(steps[0][0], (0,))], set()
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if chosen in seen:
            continue
        seen.add(chosen)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
        moved = [0] * n
        for c in chosen:
            if moved[steps[c][1]]:
                break
            moved[steps[c][1]] = steps[c][2]
        else:
            out.append(tuple(moved))
    return out


@dataclass
class Index:
    """Functions and offsets; by band its top, the functions' widths and a table's probes (WHOLE: all of the band); recall and share of all rows met on the sample."""

    a: np.ndarray
    b: np.ndarray
    tops: np.ndarray
    width: np.ndarray
    count: np.ndarray
    recall: float = 1.0
    met: float = 1.0


WHOLE = -1


def _ranks(place: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """(tables, rows): the probe at which a query (its places by table and function) meets each row in each table, past all probes if none does."""
    own = np.floor(place).astype(int)
    out = np.empty(slot.shape[1::-1], int)
    for t in range(slot.shape[1]):
        order = {p: i for i, p in enumerate(probes(place[t] - own[t], PROBE_STEPS[-1]))}
        moves, at = np.unique(slot[:, t] - own[t], axis=0, return_inverse=True)
        out[t] = np.array([order.get(tuple(m), PROBE_STEPS[-1]) for m in moves.tolist()])[at.ravel()]
    return out


def _fit_shape(sample: np.ndarray, band: np.ndarray, tops: np.ndarray, hashes: int, asked: np.ndarray, near: np.ndarray, rows: int) -> tuple[float, float, Index]:
    """(recall, work, index) with so many functions: probes are added to the band where they find most for their work until RECALL is reached."""
    a, b = _functions(sample.shape[1] + 1, hashes)
    width, steps = np.ones((BANDS, *a.shape[:2])), (0, *PROBE_STEPS)
    # by band and number of probes: share of true neighbours found, rows met and probes made by a query on average
    found, met, made = (np.zeros((BANDS, len(steps))) for _ in range(3))
    count = np.zeros(BANDS, int)
    for k in range(BANDS):
        own = np.flatnonzero(band == k)
        if len(own) < FEW:
            count[k] = WHOLE
            found[k], met[k] = np.isin(near, own).mean(), len(own) / len(sample)
            continue
        x = _rows_in(sample[own], tops[k])
        width[k] = np.maximum((x @ a.reshape(-1, a.shape[2]).T).std(0).reshape(a.shape[:2]) * 1.6, 1e-12)
        slot = np.floor(_buckets(x, a, b, width[k])).astype(int)
        place = _buckets(_queries_in(sample[asked], tops[k]), a, b, width[k])
        for i in range(len(asked)):
            ranks = _ranks(place[i], slot)
            first = ranks.min(0)[np.isin(own, near[i])]
            for j, probed in enumerate(steps[1:], 1):
                found[k, j] += (first < probed).sum() / near.size
                met[k, j] += (ranks < probed).sum() / len(sample) / len(asked)
        made[k] = TABLES * np.array(steps)
    at = np.zeros(BANDS, int)
    total = lambda: sum(found[k, at[k]] for k in range(BANDS))
    work = met * rows + SHIP * made
    while total() < RECALL:
        gains = [((found[k, j] - found[k, at[k]]) / max(work[k, j] - work[k, at[k]], 1e-9), k, j) for k in range(BANDS) if count[k] != WHOLE for j in range(at[k] + 1, len(steps)) if found[k, j] > found[k, at[k]]]
        if not gains:
            break
        _, k, j = max(gains)
        at[k] = j
    for k in np.flatnonzero(count != WHOLE):
        count[k] = steps[at[k]]
    index = Index(a, b, tops, width, count, float(total()), float(sum(met[k, at[k]] for k in range(BANDS))))
    return index.recall, float(sum(work[k, at[k]] for k in range(BANDS))), index


def fit_index(sample: np.ndarray, rows: int, k: int, most: float | None = None) -> Index:
    """The cheapest index for `rows` rows that reaches RECALL on the sample, or the one that finds most if none does. most: the largest norm of all rows."""
    most = most or float(np.sqrt((sample * sample).sum(1)).max())
    asked = np.arange(0, len(sample), max(1, len(sample) // 100))
    dots = sample[asked] @ sample.T
    dots[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-dots, axis=1)[:, : min(k, len(sample) - 1)]
    band, tops = _bands(sample, most), _tops(most)
    if near.size == 0:
        a, b = _functions(sample.shape[1] + 1, HASHES[0])
        return Index(a, b, tops, np.ones((BANDS, *a.shape[:2])), np.full(BANDS, WHOLE))
    fitted = [_fit_shape(sample, band, tops, hashes, asked, near, rows) for hashes in HASHES]
    return min(fitted, key=lambda f: (-min(f[0], RECALL), f[1]))[2]


def nearest(vectors: DataFrame, is_query: object, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product found for each query; all candidates if there are fewer.

    Candidates are all rows but the query's own id. Vectors that are null, empty, all zero or hold null or
    non-finite components take no part, nor do null ids; vectors of another length than most take no part. Ties
    go to the smaller id, repeated rows (same id and vector) count once. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType == ArrayType(FloatType(), True) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = sizes["dim"], float(np.sqrt(sizes["norm"]))
    rows = rows.where(F.size("v") == dim)
    got = hashed_sample(rows.select("vec_id", "v"), F.xxhash64("vec_id", "v"), SAMPLE, sizes["n"]).collect()
    fitted = fit_index(_matrix([r["v"] for r in got]), sizes["n"], k, most)
    a, b, tops, width, count = fitted.a, fitted.b, fitted.tops, fitted.width, fitted.count

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"band": np.unique(_bands(_matrix(p["v"]), most)) if len(p) else []})

    there = {r["band"] for r in rows.select("v").mapInPandas(held, "band int").distinct().collect()}  # BANDS at most
    count[[k for k in range(BANDS) if k not in there]] = 0
    # a block's vectors as doubles: 4 MB, whatever their length
    block = max(64, BLOCK_VALUES // dim)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if p.empty:
                continue
            x = _matrix(p["v"])
            band = _bands(x, most)
            slot = np.floor(_buckets(_rows_in(x, tops[band]), a, b, width[band])).astype(int)
            whole = count[band] == WHOLE
            for t in range(TABLES):
                names = [f"{k}" if w else f"{k}:{t}:" + ",".join(map(str, s)) for k, w, s in zip(band, whole, slot[:, t], strict=True)]
                rows = pd.DataFrame({"bucket": names, "vec_id": p["vec_id"], "v": p["v"]})
                yield rows if t == 0 else rows[~whole]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if p.empty:
                continue
            x = _matrix(p["v"])
            for k in np.flatnonzero(count):
                if count[k] == WHOLE:
                    yield pd.DataFrame({"bucket": f"{k}", "query_id": p["vec_id"], "v": p["v"]})
                    continue
                place = _buckets(_queries_in(x, tops[k]), a, b, width[k])
                slot = np.floor(place).astype(int)
                for i, (vec_id, v) in enumerate(zip(p["vec_id"], p["v"], strict=True)):
                    names = [f"{k}:{t}:" + ",".join(map(str, slot[i, t] + np.array(m))) for t in range(TABLES) for m in probes(place[i, t] - slot[i, t], count[k])]
                    yield pd.DataFrame({"bucket": names, "query_id": vec_id, "v": [v] * len(names)})

    def best(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if c.empty or q.empty:
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        c = c.sort_values("vec_id", kind="stable")
        ids, x, y = c["vec_id"].to_numpy(), _matrix(c["v"]), _matrix(q["v"])
        # more than the rounding of a product, so that no tie is cut before it is summed again
        slack = 1e-12 * x.shape[1] * np.sqrt((y * y).sum(1)) * np.sqrt((x * x).sum(1)).max()
        out = []
        for s in range(0, len(q), 256):
            dots = y[s : s + 256] @ x.T
            for query, vector, row, off in zip(q["query_id"].iloc[s : s + 256], y[s : s + 256], dots, slack[s : s + 256], strict=True):
                ok = np.flatnonzero(ids != query)
                if len(ok) > k:
                    ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k] - off]
                # the kept ones again, all summed in one order, so that equal vectors tie exactly
                score = (x[ok] * vector).sum(1)
                first = np.lexsort((ids[ok], -score))[:k]
                out.append((query, ids[ok][first].tolist(), score[first].tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    def compared(members: DataFrame, asked: DataFrame) -> DataFrame:
        """The k best of each query's buckets, ranked."""
        counts = materialize(members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("m")), "buckets")
        asked = asked.join(counts, "bucket")
        asked_counts = asked.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        left = members.join(counts, "bucket").join(asked_counts, "bucket").withColumn("i", F.pmod(F.xxhash64("vec_id"), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("bucket", "i", "j", "vec_id", "v")
        right = asked.join(asked_counts, "bucket").withColumn("j", F.pmod(F.xxhash64("query_id"), F.col("n")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("bucket", "i", "j", "query_id", "v")
        found = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInPandas(best, "query_id long, ids array<long>, scores array<double>")
        each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
        one = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = rows.where("q").select("vec_id", "v")
    every = rows.select(F.lit("all").alias("bucket"), "vec_id", "v")
    if fitted.recall < LEAST_RECALL:
        return compared(every, queries.select(F.lit("all").alias("bucket"), F.col("vec_id").alias("query_id"), F.col("v").alias("v")))
    probed = materialize(compared(rows.select("vec_id", "v").mapInPandas(index, f"bucket string, vec_id long, v {kind}"), queries.mapInPandas(visit, f"bucket string, query_id long, v {kind}")), "probed")
    # queries that met fewer rows than they are due are held against all rows
    due = min(k, rows.select("vec_id").distinct().count() - 1)
    met = probed.groupBy("query_id").agg(F.count("*").alias("met"))
    short = materialize(queries.select(F.col("vec_id").alias("query_id")).distinct().join(met, "query_id", "left").where(F.coalesce("met", F.lit(0)) < due).select("query_id"), "short")
    if not short.limit(1).count():
        return probed
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("v")).join(short, "query_id").select(F.lit("all").alias("bucket"), "query_id", "v")
    return probed.join(short, "query_id", "left_anti").unionByName(compared(every, asked))
