"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Letters are lower-cased, every run of other characters becomes one space, and character 2-, 3- and 4-grams hash
into BUCKETS embeddings. A document is the average of its n-grams' embeddings; a linear softmax over it is
trained together with the embeddings by stochastic gradient descent in numpy. After training the embeddings and
the softmax fold into one table (bucket x language), so a prediction is an average of table rows.

The fit uses a bounded sample: PER_LANGUAGE labelled rows of each language, the ones with the smallest hash of
doc_id. A quarter of it stays out of the gradient steps; it sets the softmax temperature (least log loss) and the
rejection level: the REJECT quantile of the confidence in right answers, MOST_REJECT at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import map_batches

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 6
RATE = 0.5
PER_LANGUAGE = 600
REJECT = 0.001
MOST_REJECT = 0.5
SEGMENT = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of the whole text's n-grams, in pieces of bounded size; nothing if it has no letter."""
    for at in range(0, len(text or ""), SEGMENT):
        c = np.frombuffer(text[at : at + SEGMENT].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_is_letter()[np.minimum(c, 0x10FFFF)], c, np.uint32(32))
        c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        if len(c) < 3:
            continue
        out = []
        for n in (2, 3, 4):
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                out.append((h >> np.uint32(16)) & np.uint32(BUCKETS - 1))
        yield np.concatenate(out)


def pack_counts(idx: np.ndarray, n: np.ndarray) -> bytes:
    """Rising bucket numbers and how often each occurs, in about a byte and a half each: what a sampled text sends to the driver."""
    steps, most = np.diff(idx, prepend=0).astype(np.uint16), np.min_scalar_type(int(n.max()))
    return zlib.compress(steps.tobytes() + n.astype(most).tobytes()) + bytes([most.itemsize])


def unpack_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw, width = zlib.decompress(packed[:-1]), packed[-1]
    size = len(raw) // (2 + width)
    return np.cumsum(np.frombuffer(raw, np.uint16, size), dtype=np.int32), np.frombuffer(raw, f"u{width}", size, 2 * size).astype(np.float64)


@dataclass
class LanguageModel:
    """languages, table (bucket x language logits, temperature included) and the confidence under which to reject."""

    languages: list[str]
    table: np.ndarray
    reject: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, rejected); `und`, 0, True without a letter or a language."""
        total, n = np.zeros(len(self.languages)), 0
        for idx in subwords(text):
            total += self.table[idx].sum(0, dtype=np.float64)
            n += len(idx)
        if not n or not self.languages:
            return "und", 0.0, True
        z = total / n
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.reject)


def _train(rows: list[tuple[int, bytes]], languages: list[str], seed: int = 7) -> LanguageModel:
    """rows: (language, packed counts). They stay packed, so that the driver never holds the sample's n-grams at once."""

    def features(r: int) -> tuple[np.ndarray, np.ndarray]:
        idx, n = unpack_counts(rows[r][1])
        return idx, n / n.sum()

    rng = np.random.default_rng(seed)
    k = len(languages)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = rng.normal(0, 0.1, (DIM, k))
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 4] if len(rows) >= 8 * k else order[:0]
    used = order[len(held) :]
    steps, step = EPOCHS * max(1, len(used)), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(used):
            y, (idx, w) = rows[r][0], features(r)
            rate = RATE * (1 - step / steps)
            step += 1
            x = w @ emb[idx]
            z = x @ soft
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = soft @ p
            soft -= rate * np.outer(x, p)
            emb[idx] -= rate * 30 * w[:, None] * back
    table = emb @ soft
    z = np.array([w @ table[idx] for idx, w in map(features, held if len(held) else used)]).reshape(-1, k)
    y = np.array([rows[r][0] for r in (held if len(held) else used)], int)

    def confidence(t: float) -> np.ndarray:
        p = np.exp(t * (z - z.max(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)

    if not len(y):
        return LanguageModel(languages, table.astype(np.float32), 0.0)
    scales = np.exp(np.linspace(np.log(0.25), np.log(16), 49))
    best = min(scales, key=lambda t: -np.log(confidence(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = confidence(best)
    right = p[np.arange(len(y)), y][p.argmax(1) == y]
    reject = min(MOST_REJECT, float(np.quantile(right, REJECT))) if len(right) else 0.0
    return LanguageModel(languages, (best * table).astype(np.float32), reject)


def fit_language_model(docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most per_language rows of each language among the trainable rows with a text and a language.

    Every language counts, however rare; the driver holds one number and BUCKETS logits for each.
    """
    rows = docs.where(trainable) if trainable is not None else docs
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 0.0)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, (2 * per_language + 50) / counts[k])))])
    rank = F.xxhash64("doc_id", "text")
    few = rows.withColumn("at", rank).where((F.pmod("at", F.lit(1 << 30)) / float(1 << 30)) < F.try_element_at(share, F.col("lang")))
    few = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("at", "doc_id"))).where(F.col("k") <= per_language)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, at, text in zip(b["lang"], b["at"], b["text"], strict=True):
                pieces = list(subwords(text))
                if pieces:
                    out.append((lang, at, pack_counts(*np.unique(np.concatenate(pieces), return_counts=True))))
            yield pd.DataFrame(out, columns=["lang", "at", "counts"])

    got = few.select("lang", "at", "text").mapInPandas(features, "lang string, at long, counts binary").collect()
    number = {k: i for i, k in enumerate(languages)}
    return _train([(number[r["lang"]], bytes(r["counts"])) for r in sorted(got, key=lambda r: (r["at"], r["lang"]))], languages)


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs with lang_pred, score (0 to 1) and rejected, one row for each row.

    A text that is null or without a letter gets `und`, 0 and rejected. Rows are independent, so repeated rows
    repeat; other columns are left out, whatever their names.
    """
    fields = [docs.schema[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column("_text").to_pylist()]
            yield {f.name: b.column(f.name) for f in fields} | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "rejected": [x[2] for x in got]}

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "rejected boolean"])
    return map_batches(docs.select(*keep, F.col(text_col).cast("string").alias("_text")), run, schema)
