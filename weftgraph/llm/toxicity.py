"""Toxicity as cumulative-link ordinal regression on sparse text features.

P(grade >= j) = sigmoid(w.x - theta_j): one weight vector for all thresholds, thresholds in order, so a document
has one latent severity and grade probabilities that never cross. Features are the distinct lower-cased words of
the whole text and their beginnings (PREFIXES letters), hashed to FEATURES places: a stem's many forms share weight.
The fit is full-batch gradient descent (Adam) with weight decay on a bounded sample: SAMPLE labelled rows, those with
the smallest hash of their id. No feature is left out for being rare; each is scaled by its score test z, to
z^2 / (z^2 + DOUBT^2), which makes the decay strong where the grades speak little for it. The output is the grade
probabilities' expected severity, the likeliest grade, and a flag: the severity is above that of all but CLEAN_LOSS of the lowest-grade rows in a quarter of the sample, which
the fit does not see.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, map_batches

FEATURES = 1 << 18
SAMPLE = 12_000
PREFIXES = (3, 4, 5, 6)
DOUBT = 4.0
STEPS = 150
RATE = 0.1
DECAY = 1e-3
CLEAN_LOSS = 0.003
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % FEATURES


def word_places(word: str) -> tuple[int, ...]:
    """The features of a word: itself and its beginnings; the star tells a beginning from a word."""
    return (place(word), *[place(word[:n] + "*") for n in PREFIXES if len(word) > n])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """grades in order, one weight a feature, one threshold between each two grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray
    flag: float = float("inf")

    def severity(self, latent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, likeliest grade) of latent scores."""
        if not self.grades:
            return np.zeros(len(latent)), np.zeros(len(latent), int)
        above = _sigmoid(latent[:, None] - self.thresholds[None, :])
        edge = np.hstack([np.ones((len(latent), 1)), above, np.zeros((len(latent), 1))])
        p = edge[:, :-1] - edge[:, 1:]
        return p @ np.array(self.grades, float), np.array(self.grades)[p.argmax(1)]


def fit_ordinal(features: list[np.ndarray], grades: list[int]) -> OrdinalModel:
    """Fit on rows of distinct feature places and their grades."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return OrdinalModel(levels, np.zeros(FEATURES), np.zeros(0))
    y = np.searchsorted(levels, grades)
    n, cuts = len(y), len(levels) - 1
    row, col = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features]), np.concatenate(features)
    rows_of = np.bincount(col, minlength=FEATURES)
    used = np.flatnonzero(rows_of)
    col = (np.cumsum(rows_of > 0) - 1)[col].astype(np.int32)
    # score test at zero weights: how far the grades of a feature's rows are from the mean, in chance's own deviations
    z2 = np.bincount(col, (y - y.mean())[row], len(used)) ** 2 / (rows_of[used] * max(y.var(), 1e-12))
    scale = z2 / (z2 + DOUBT**2)
    target = (y[:, None] > np.arange(cuts)[None, :]).astype(float)
    share = np.clip(target.mean(0), 1e-3, 1 - 1e-3)
    first, gaps = -np.log(share[0] / (1 - share[0])), np.full(max(0, cuts - 1), 0.5)
    x = np.concatenate([np.zeros(len(used)), [first], np.log(gaps)])
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, STEPS + 1):
        w, theta = x[: len(used)], x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1 :]))])
        latent = np.bincount(row, (w * scale)[col], n)
        above = _sigmoid(latent[:, None] - theta[None, :])
        # likelihood of the grade's cell: the difference of two neighbouring curves
        edge = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = edge * (1 - edge)
        at = np.arange(n)
        cell = np.maximum(edge[at, y] - edge[at, y + 1], 1e-9)
        g_latent = -(slope[at, y] - slope[at, y + 1]) / cell
        g_theta = np.zeros(cuts)
        np.add.at(g_theta, y[y > 0] - 1, (slope[at, y] / cell)[y > 0])
        np.add.at(g_theta, y[y < cuts], -(slope[at, y + 1] / cell)[y < cuts])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, g_latent[row], len(used)) * scale + DECAY * n * w, [tail[0]], tail[1:] * np.exp(x[len(used) + 1 :])]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 if t < STEPS * 2 // 3 else 0.3)
    weights = np.zeros(FEATURES)
    weights[used] = x[: len(used)] * scale
    return OrdinalModel(levels, weights, x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1 :]))]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` labelled rows; null grades and texts take no part.

    The sampled ids, of which there are `sample` at most, are broadcast; no text is shuffled.
    """
    graded = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    few = F.broadcast(hashed_sample(graded.withColumn("at", F.xxhash64("doc_id", "grade")), F.col("at"), sample, graded.count()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(few, "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(np.array([p for w in words(t) for p in word_places(w)], np.int32)).tobytes() for t in b["text"]]
            yield pd.DataFrame({"at": b["at"], "grade": b["grade"], "f": sets})

    got = sorted(rows.select("at", "grade", "text").mapInPandas(features, "at long, grade int, f binary").collect(), key=lambda r: (r["at"], r["grade"], bytes(r["f"])))
    features_of, grades = [np.frombuffer(r["f"], np.int32) for r in got], [r["grade"] for r in got]
    held = [i for i in range(len(got)) if i % 4 == 3]
    model = fit_ordinal([x for i, x in enumerate(features_of) if i % 4 != 3], [g for i, g in enumerate(grades) if i % 4 != 3])
    clean = [i for i in held if model.grades and grades[i] == model.grades[0]]
    if len(model.grades) > 1:
        latent = np.array([model.weights[features_of[i]].sum() for i in clean] or [0.0])
        model.flag = float(np.quantile(model.severity(latent)[0], 1 - CLEAN_LOSS))
    return model


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic), one row for each row of docs; toxic where the severity is above the model's flag.

    severity is the expected grade. A null or empty text has no features and keeps the thresholds' prior.
    Repeated rows repeat; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.grades, model.thresholds, model.flag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        weight, grades, thresholds, flag = shared.value
        small = OrdinalModel(grades, np.zeros(0), thresholds)
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            latent = np.zeros(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                seen: set[int] = set()
                for w in words(t):
                    x = memo.get(w)
                    if x is None:
                        x = memo[w] = word_places(w)
                    seen.update(x)
                # summed in the places' order, as in the fit
                latent[i] = weight[np.sort(np.fromiter(seen, np.int64, len(seen)))].sum()
                if len(memo) > 200_000:
                    memo.clear()
            severity, grade = small.severity(latent)
            yield {"doc_id": b.column("doc_id"), "severity": np.round(severity, 6), "grade": grade.astype(np.int32), "toxic": severity > flag}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, severity double, grade int, toxic boolean")
