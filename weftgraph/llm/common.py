"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.components import components
from ..storage import materialize

__all__ = ["WORD", "components", "documents", "hashed_sample", "map_batches", "materialize", "mix", "shingles", "small_side", "word_hashes"]

#: The contract's word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """rows through `run`, which takes Arrow batches and gives columns by name (lists, numpy or Arrow arrays).

    Nothing passes through pandas, where a whole number beside a null would become a float and lose digits.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in run(batches):
            yield pa.RecordBatch.from_arrays([c[f.name] if isinstance(c[f.name], pa.Array) else pa.array(c[f.name], f.type) for f in kind], schema=kind)

    return rows.mapInArrow(each, schema)


def hashed_sample(rows: DataFrame, key: Column, size: int, count: int) -> DataFrame:
    """At most `size` of `count` rows: of each key (a hash) one row, the keys smallest modulo 2^40.

    A threshold first leaves about size rows in all, so that no partition brings size rows of its own to the driver,
    however often a row is repeated.
    """
    ring, at = 1 << 40, F.pmod(key, F.lit(1 << 40))
    share = min(1.0, (1.1 * size + 300) / max(1, count))
    return rows.withColumn("_at", at).where(F.col("_at") <= int(share * ring)).dropDuplicates(["_at"]).orderBy("_at").limit(size).drop("_at")


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """For a join: broadcast if the table has `most` rows at most, else left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- 64-bit hashes of words and shingles, in numpy -------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(20240102).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 14)
        up, down = np.full(size, _M, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """A uint64 for every word of the whole text, A-Z lower-cased, in order; long texts go in segments that end between words."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").lower()
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        b = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(inside))
        start, stop = edge[0::2], edge[1::2]
        up, down = _power(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        parts.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct uint64 hashes of the text's 5-word shingles; fewer words make one shingle of them all."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    if n < 5:
        return mix((w * _STEP[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    s = w[: n - 4] * _STEP[0]
    for k in range(1, 5):
        s = s + w[k : n - 4 + k] * _STEP[k]
    return np.unique(mix(s))
