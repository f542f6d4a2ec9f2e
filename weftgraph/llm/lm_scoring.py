"""Subword lattice likelihood: the marginal probability of a text under a unigram model of subword pieces.

The pieces and their scores come from an existing tokenizer's vocabulary file (a path, read by the driver alone and
broadcast; never trained here). A word is a path through the lattice of all its segmentations into pieces, the first
of which carries the word's start; the forward recursion in log space sums over all paths.

The file's scores weigh the segmentations of every distinct training word; a piece's weight is then PRIOR parts its
score in the file and the rest its expected count (forward-backward) under those scores. Scores that are log
probabilities count as they are; those of a merge table are ranks, which stand for Zipf's law: 1 / (ZIPF + distance
from the best score). A word of the training rows is one more piece, its edge across the whole lattice, by absolute
discounting: what is taken off the words' counts is the share of the subword pieces. Training rows fall into classes
by a column (their language), each with its own weights; a text's probability is the mixture over classes of the
product of its words' marginals and one end, a proper distribution over word sequences. The marginal under the file's
scores alone, without learned counts, words or classes, stands beside it.

Word counts are a grouped table; each distinct word is scored once, and documents join with that table. The most
frequent words (HOT at most) travel to the tasks instead, so that the words of a third of all rows need no
shuffle; every other word is joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF = 50.0
PRIOR = 0.1
HOT = 40_000
LN10 = float(np.log(10))
_B = np.uint64(0x9E3779B97F4A7C15)
_T = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece bytes (a leading space marks a word's start) and score; every single byte is there, so any word has a path.

    Pieces with A-Z can't match lower-cased words and stay out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        text = sp.id_to_piece(i)
        piece = bytes([int(text[3:5], 16)]) if sp.is_byte(i) else text.replace("▁", " ").encode()
        if piece != piece.lower() or b" " in piece[1:] or not piece:
            continue
        out[piece] = max(out.get(piece, -np.inf), sp.get_score(i))
    low = min(out.values(), default=0.0) - 1
    for k in range(256):
        out.setdefault(bytes([k]), low)
    return out


def file_weights(vocabulary: dict[bytes, float], scores: str = "rank") -> tuple[list[bytes], np.ndarray]:
    """Pieces in order of score, and the probabilities that the file's scores stand for ("rank" or "log")."""
    pieces = sorted(vocabulary, key=lambda p: (-vocabulary[p], p))
    own = np.array([vocabulary[p] for p in pieces])
    w = np.exp(own - own.max()) if scores == "log" else 1 / (own.max() - own + ZIPF)
    return pieces, w / w.sum()


class Lattice:
    """All segmentations of many words at once, under one or more sets of weights (rows of natural logs)."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.weights = np.hstack([np.atleast_2d(weights), np.full((len(np.atleast_2d(weights)), 1), -np.inf)])
        self.size, self.by_length = len(pieces), {}
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            groups.setdefault(len(p), []).append(i)
        for n, ids in sorted(groups.items()):
            m = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
            h = np.zeros(len(ids), np.uint64)
            for k in range(n):
                h = h * _B + _T[m[:, k]]
            key = mix(h + np.uint64(n))
            order = np.argsort(key)
            self.by_length[n] = (key[order], np.array(ids)[order], np.uint64(pow(int(_B), n, 1 << 64)))

    def _edges(self, words: list[bytes]) -> tuple[np.ndarray, int, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Lengths, the longest, and by piece length: the piece at each start of each word (`size` if none), and which starts have one."""
        length = np.array([len(w) + 1 for w in words])
        wide = int(length.max())
        m = np.frombuffer(b"".join((b" " + w).ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        h = np.zeros((wide + 1, len(words)), np.uint64)
        for k in range(wide):
            h[k + 1] = h[k] * _B + _T[m[:, k]]
        edges = {}
        for n, (key, ids, power) in self.by_length.items():
            if n > wide:
                break
            k = mix(h[n:] - h[:-n] * power + np.uint64(n))
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            hit = key[at] == k
            edges[n] = (np.where(hit, ids[at], self.size), hit.any(1))
        return length, wide, edges

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        top = terms[0]
        for x in terms[1:]:
            top = np.maximum(top, x)
        top = np.where(np.isfinite(top), top, 0.0)
        total = sum(np.exp(x - top) for x in terms)
        with np.errstate(divide="ignore"):
            return top + np.log(total)

    def forward(self, words: list[bytes], counts: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Natural-log marginal of each word under each set of weights (sets x words).

        With counts (rows x words), the expected number of each piece under the first set is added to into (rows x pieces).
        """
        length, wide, edges = self._edges(words)
        n, sets, at = len(words), len(self.weights), np.arange(len(words))
        none = np.full((sets, n), -np.inf)
        a = np.full((wide + 1, sets, n), -np.inf)
        a[0] = 0
        for j in range(1, wide + 1):
            terms = [a[j - k] + self.weights[:, ids[j - k]] for k, (ids, some) in edges.items() if k <= j and some[j - k]]
            a[j] = self._sum(terms) if terms else none
        total = a[length, :, at].T
        if counts is not None:
            b = np.full((wide + 1, n), -np.inf)
            b[length, at] = 0
            for i in range(wide - 1, -1, -1):
                terms = [self.weights[0, ids[i]] + b[i + k] for k, (ids, some) in edges.items() if i + k <= wide and some[i]]
                b[i] = np.where(length > i, self._sum(terms) if terms else none[0], b[i])
            for k, (ids, some) in edges.items():
                for i in np.flatnonzero(some):
                    ok = np.flatnonzero(ids[i] < self.size)
                    p = np.exp(a[i, 0, ok] + self.weights[0, ids[i, ok]] + b[i + k, ok] - total[0, ok])
                    for row, times in zip(into, counts, strict=True):
                        np.add.at(row, ids[i, ok], p * times[ok])
        return total

    def score(self, words: list[bytes], counts: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """As forward, in blocks of words of like length."""
        out = np.zeros((len(self.weights), len(words)))
        order, room = sorted(range(len(words)), key=lambda i: len(words[i])), max(1, 60_000 // len(self.weights))
        at = 0
        while at < len(order):
            take = 0
            while at + take < len(order) and (take < 1 or (take + 1) * (len(words[order[at + take]]) + 1) <= room):
                take += 1
            block = order[at : at + take]
            out[:, block] = self.forward([words[i] for i in block], None if counts is None else counts[:, block], into)
            at += take
        return out


def tokens(text: str | None) -> list[bytes]:
    """The text's words, A-Z lower-cased; bytes.split() splits at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _word_counts(rows: DataFrame, classes: int) -> DataFrame:
    """(word, c, n): how often each word occurs in the training rows of each class, and in all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Counter] = {}

        def flush() -> pd.DataFrame:
            return pd.concat([pd.DataFrame({"word": list(c), "k": k, "n": list(c.values())}) for k, c in found.items()])

        for b in batches:
            for t, k in zip(b["text"], b["k"], strict=True):
                found.setdefault(k, Counter()).update(tokens(t))
                if sum(map(len, found.values())) > 400_000:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    counts = rows.select("text", "k").mapInPandas(run, "word binary, k int, n long")
    by_class = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(classes)]
    return counts.groupBy("word").agg(F.sum("n").alias("n"), *by_class).select("word", F.array(*[f"c{k}" for k in range(classes)]).alias("c"), "n")


class Model:
    """The lattice, and of each class: counted tokens N (ends included), discount, the pieces' share, log10 of its weight and its end."""

    def __init__(self, lattice: Lattice, stats: list[dict], ends: list[int]):
        self.lattice = lattice
        n, n1, n2, v, ends = *(np.array([s[x] for s in stats], float) for x in ("n", "n1", "n2", "v")), np.array(ends, float)
        self.total = np.maximum(1, n + ends)
        self.off = np.clip(n1 / np.maximum(1, n1 + 2 * n2), 0.1, 0.95)
        self.share = np.maximum(1e-9, np.where(v > 0, self.off * v / self.total, 1 - ends / self.total))
        learned = ends.sum() > 0
        self.start = np.log10(ends / ends.sum()) + np.log10(ends / self.total) if learned else np.full(1, -1.0)
        self.end = float(np.log10(ends.sum() / self.total.sum())) if learned else -1.0

    def word_scores(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 P(word) in each class (classes x words) from the words' counts there."""
        own = np.maximum(counts - self.off[:, None], 0) / self.total[:, None]
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(own), np.log(self.share)[:, None] + self.lattice.score(words)) / LN10


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words of a count above a threshold that at most `most` of them reach; the counts are tallied on a log scale."""
    step = F.floor(F.log2("n") * 16)
    tally = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, held = None, 0
    for at, count in tally:
        held += count
        if held > most:
            break
        least = at
    return words.where(step >= least) if least is not None else words.limit(0)


def lattice_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, vocabulary: str = VOCABULARY, scores: str = "rank", prior: float = PRIOR, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score), one row for each row of docs.

    score is the log10 marginal probability of the text under the lattice model, vocabulary_score that under the
    file's scores alone, base_score that of add-one word unigrams. What is learned comes from the rows that held_out
    leaves (a null there counts as not held out). class_col is read from those alone; each of its values is a class,
    null one more; time and width grow with their number. A null text is empty: one end. Without training rows the
    file's scores are all there is. Repeated rows repeat; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    label = F.col(class_col).cast("string") if class_col else F.lit("all")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), label.alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.where("not held_out").groupBy("label").count().collect()}
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    ends, classes = [sizes[x] for x in names] or [0], max(1, len(names))
    place = F.map_from_arrays(F.array(*[F.lit(x) for x in names if x is not None]).cast("array<string>"), F.array(*[F.lit(i) for i, x in enumerate(names) if x is not None]).cast("array<int>"))
    rows = rows.withColumn("k", F.when(F.col("held_out"), -1).otherwise(F.coalesce(F.try_element_at(place, F.col("label")), F.lit(classes - 1))).cast("int"))
    words = materialize(_word_counts(rows, classes), "words")
    count_if = [(F.count_if(F.col("c")[i] == 1).alias(f"n1_{i}"), F.count_if(F.col("c")[i] == 2).alias(f"n2_{i}"), F.count_if(F.col("c")[i] > 0).alias(f"v_{i}"), F.coalesce(F.sum(F.col("c")[i]), F.lit(0)).alias(f"n_{i}")) for i in range(classes)]
    every = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    found = words.agg(F.count_if(every > 0).alias("v"), *[x for four in count_if for x in four]).first().asDict()
    stats, v = [{x: found[f"{x}_{i}"] for x in ("n1", "n2", "v", "n")} for i in range(classes)], found["v"]
    pieces, given = file_weights(load_vocabulary(vocabulary), scores)
    plain = Lattice(pieces, np.log(given))
    shared = spark.sparkContext.broadcast(plain)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((classes, len(pieces)))
        for b in batches:
            if len(b):
                shared.value.score(b["word"].tolist(), (np.stack(b["c"].to_list()).T > 0).astype(float), total)
        k, used = np.nonzero(total)
        yield pd.DataFrame({"k": k, "piece": used, "n": total[k, used]})

    # one row a class and piece of the vocabulary
    got = words.where(every > 0).mapInPandas(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect() if v else []
    weights = np.zeros((classes, len(pieces)))
    for r in got:
        weights[r["k"], r["piece"]] = r["n"]
    sums = weights.sum(1, keepdims=True)
    weights = np.where(sums > 0, prior * given + (1 - prior) * weights / np.maximum(sums, 1e-300), given)
    model = Model(Lattice(pieces, np.log(weights)), stats, ends)
    both = spark.sparkContext.broadcast((model, plain))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, alone = both.value
        for b in batches:
            if len(b):
                w, c = b["word"].tolist(), np.stack(b["c"].to_list()).T
                yield pd.DataFrame({"word": w, "c": c.sum(0), "n": b["n"], "logp": list(fitted.word_scores(w, c).T), "alone": alone.score(w)[0] / LN10})

    known = materialize(words.mapInPandas(weigh, "word binary, c long, n long, logp array<double>, alone double"), "word-scores")
    tokens_in = sum(s["n"] for s in stats) + sum(ends)
    room = float(np.log10(tokens_in + (v + (sum(ends) > 0) + 1)))
    most = _frequent(known, hot).collect()
    table = {bytes(r["word"]): i for i, r in enumerate(most)}
    hot_known = np.array([r["c"] > 0 for r in most], np.int64)
    hot_scores = np.array([[np.log10(r["c"] + 1) - room, r["alone"], *r["logp"]] for r in most]).reshape(-1, classes + 2)
    often = spark.sparkContext.broadcast((table, hot_known, hot_scores))
    start = np.array([np.log10(sum(ends) + 1) - room, model.end, *model.start])
    end_known = int(sum(ends) > 0)
    own_type = "struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,sums:array<double>>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place, flags, scored = often.value
        names = ("k1", "k2", "word", "times", "own")
        for b in batches:
            out: list[tuple] = []
            for k1, k2, doc_id, held, text in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "held_out", "text")], strict=True):
                w = tokens(text)
                idx, n_hot = [], []
                for x, c in Counter(w).items():
                    hit = place.get(x)
                    if hit is None:
                        out.append((k1, k2, x, c, None))
                    else:
                        idx.append(hit)
                        n_hot.append(c)
                c = np.array(n_hot, float)
                sums = (start + c @ scored[idx] if idx else start).tolist()
                # white space: no word of a text, so it joins with nothing
                out.append((k1, k2, b"\n%d %d" % (k1, k2), 0, {"doc_id": doc_id, "held_out": held, "n_tokens": len(w) + 1, "n_known": end_known + int(c @ flags[idx] if idx else 0), "sums": sums}))
                if len(out) > 200_000:
                    yield dict(zip(names, zip(*out, strict=True), strict=True))
                    out = []
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))

    # two differently seeded hashes name a row; rows that are equal in both are equal
    rows = rows.withColumns({"k1": F.xxhash64("text", "doc_id", F.col("doc_id").isNull()), "k2": F.xxhash64(F.lit(17), "text", "doc_id")})
    parts = map_batches(rows, look_up, f"k1 long, k2 long, word binary, times int, own {own_type}")
    joined = parts.join(known.select("word", "c", "logp", "alone"), "word", "left")
    times, c = F.col("times"), F.coalesce("c", F.lit(0))
    total = joined.groupBy("k1", "k2").agg(
        F.count("own").alias("rows"),
        *[F.max(f"own.{x}").alias(x) for x in ("doc_id", "held_out", "n_tokens")],
        F.max("own.n_known").alias("own_known"),
        *[F.max(F.col("own.sums")[i]).alias(f"own{i}") for i in range(classes + 2)],
        F.sum(F.when(c > 0, times).otherwise(0)).alias("known"),
        F.sum(times * (F.log10(c + 1.0) - room)).alias("sum0"),
        F.sum(times * F.coalesce("alone", F.lit(0.0))).alias("sum1"),
        *[F.sum(times * F.coalesce(F.col("logp")[i], F.lit(0.0))).alias(f"sum{i + 2}") for i in range(classes)],
    )
    part = [F.col(f"own{i}") + F.col(f"sum{i}") / F.col("rows") for i in range(classes + 2)]
    total = total.withColumn("parts", F.array(*part)).withColumn("best", F.array_max(F.slice("parts", 3, classes)))
    mixed = F.col("best") + F.log10(F.aggregate(F.slice("parts", 3, classes), F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - F.col("best"))))
    return total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("own_known") + (F.col("known") / F.col("rows")).cast("long")).alias("n_known"),
        F.lit(tokens_in).cast("long").alias("train_tokens"),
        F.round(F.col("parts")[0], 6).alias("base_score"),
        F.round(mixed, 6).alias("score"),
        F.round(F.col("parts")[1], 6).alias("vocabulary_score"),
    )
