"""Whitening of embeddings by a singular value decomposition: TSQR over blocks, then one-sided Jacobi rotations.

Entries become whole numbers x = floor(64 c) + 1000000, so that sums and centred values are exact before anything is
divided. Every task brings its centred rows down to a triangular factor R by QR of BLOCK rows and the R so far; FAN
factors at a time are stacked and factorised again until one is left. Plane rotations then make R's columns
orthogonal, pair by pair in rounds of disjoint pairs, until no two of them have a cosine over TOLERANCE. The columns'
lengths are the singular values, so standard deviations never pass through a product of the data with itself, and the
accumulated rotations are the components.

Only sums by dimension, the last R and the whitened rows' covariance come to the driver: 8 d^2 bytes for d dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more have no exact x; their rows take no part.
MOST = 2.0**40
BLOCK = 4096
FAN = 16
TOLERANCE = 1e-15
SWEEPS = 60
WIDE = 1 << 62


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is not null and holds no null or non-finite entry."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = v.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST)))
    return whole.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit numbers, or Python's where they may not do."""
    if len(x) and n * int(np.abs(x).max()) >= WIDE:
        return x.astype(object) * n - sums
    return x * n - np.array(sums.tolist(), np.int64)


def triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The R of all centred rows, by a tree of QR factorisations."""
    dim = len(sums)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        r = np.zeros((0, dim))
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            for s in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, (_numerators(x[s : s + BLOCK], n, sums) / n).astype(float)]), mode="r")
        if len(r):
            yield {"r": [r.tobytes()]}

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [np.linalg.qr(np.vstack([np.frombuffer(r).reshape(-1, dim) for r in group["r"]]), mode="r").tobytes()]})

    factors = materialize(map_batches(rows.select("x"), reduced, "r binary"), "factors")
    while (count := factors.count()) > 1:
        groups = -(-count // FAN)
        dealt = factors.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        factors = materialize(dealt.groupBy("g").applyInPandas(joined, "r binary"), "factors")
    return np.frombuffer(bytes(factors.first()["r"])).reshape(-1, dim)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of r, by one-sided plane rotations of its columns."""
    dim = r.shape[1]
    pad = dim + dim % 2
    u, v = np.zeros((max(1, len(r)), pad)), np.eye(pad)
    u[: len(r), :dim] = r
    ring = np.arange(1, pad)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(pad - 1):
            # a round robin: the first column stays, the others go round, so that each pair meets once a sweep
            seats = np.concatenate([[0], ring])
            p, q = seats[: pad // 2], seats[: pad // 2 - 1 : -1]
            a, b, c = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            length = np.sqrt(a * b)
            turn = (np.abs(c) > TOLERANCE * length) & (length > 0)
            if not turn.any():
                ring = np.roll(ring, 1)
                continue
            worst = max(worst, float((np.abs(c[turn]) / length[turn]).max()))
            p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
            t = np.where(b >= a, 1.0, -1.0) * 2 * c / (np.abs(b - a) + np.hypot(b - a, 2 * c))
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            for m in (u, v):
                m[:, p], m[:, q] = cos * m[:, p] - sin * m[:, q], sin * m[:, p] + cos * m[:, q]
            ring = np.roll(ring, 1)
        if worst <= dim * np.finfo(float).eps:
            break
    sizes = np.sqrt((u[:, :dim] ** 2).sum(0))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:dim, order]


@dataclass
class Whitening:
    """n and S of the fit rows; components as columns, their standard deviations, and their shares of all variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Of all rows of scaled(); None without rows. Components whose variance is nothing but rounding are left out."""
    size = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if size is None or size["dim"] == 0:
        return None
    n, dim = size["count"], size["dim"]
    own = rows.where(F.size("x") == dim)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            if len(x) and len(x) * int(np.abs(x).max()) >= WIDE:
                x = x.astype(object)
            total = total + x.sum(0)
        yield {"place": np.arange(dim), "s": pa.array([str(t) for t in total])}

    parts = map_batches(own.select("x"), summed, "place long, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
    sums = np.array([int(r["s"]) for r in parts.groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").collect()], object)
    r = triangle(own, n, sums)
    sizes, vectors = jacobi(r)
    kept = int((sizes > dim * np.finfo(float).eps * sizes[0]).sum()) if sizes[0] > 0 else 0
    kept = min(kept, components)
    vectors = vectors[:, :kept]
    # either sign would do: the largest entry is positive, so that reruns agree
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(kept)] < 0, -1.0, 1.0) if kept else vectors
    return Whitening(n, sums, vectors, sizes[:kept] / np.sqrt(n), (sizes**2)[:kept] / (sizes**2).sum() if kept else sizes[:0])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every row of the model's length; deviation is null where it passes 64 bits."""
    dim, n, sums = len(model.sums), model.n, model.sums
    turned = model.components / model.deviations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            for s in range(0, len(x), BLOCK):
                top = _numerators(x[s : s + BLOCK], n, sums)
                if int(np.abs(top).max()) ** 2 * dim >= WIDE:
                    top = top.astype(object)
                apart = [d if d < 1 << 63 else None for d in (top * top).sum(1).tolist()]
                white = (top / n).astype(float) @ turned
                flat = pa.ListArray.from_arrays(np.arange(len(top) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel()))
                yield {"vec_id": batch.column("vec_id").slice(s, BLOCK), "deviation": apart, "whitened": flat}

    return map_batches(rows.where(F.size("x") == dim), run, "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n, centred) minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            w = _matrix(batch.column("whitened"), components)
            total += np.vstack([w.sum(0), w.T @ w])
        yield {"place": np.arange(total.size), "s": total.ravel()}

    parts = map_batches(white.select("whitened"), run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s"))
    total = np.array([r["s"] for r in parts.orderBy("place").collect()]).reshape(components + 1, components) / n
    # rows were centred exactly, so the means here are rounding and take nothing from the products
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(components)).max())


def whitened_embeddings(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each fit row on each component, by falling eigenvalue.

    All rows are fit rows but those whose vector is null or holds null or non-finite entries (or entries of 2^40 and
    more, which have no exact x), or has another length than most (ties: the smaller). Zero vectors count, repeated
    rows each time; a null id stays null. With fewer than `components` directions that vary, such as one row or equal
    rows, there are only so many components, as nothing can be divided by a deviation of zero. Other columns are ignored.
    """
    rows = materialize(scaled(vectors, id_col, vector_col), "scaled")
    model = fit_whitening(rows, components)
    kept = 0 if model is None else len(model.deviations)
    if not kept:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = materialize(whiten(rows, model), "whitened")
    off = identity_error(white, model.n, kept)
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(e)) for e in model.explained]), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(off).alias("identity_error"))
