"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers (leftmost, not overlapping, by kind;
what fails its check is dropped). A skip-chain CRF then labels every word that holds a digit or an `@`: its
potentials are word-shape features, neighbouring words' labels (chain) and the labels of distant words with the
same digits or the same address (skip links, so that one entity has one label across the document). Marginals come
from loopy message passing, with the rules' words clamped. Words that reach ADD for a kind add spans; the rules'
spans stay.

The CRF is trained by pseudo-likelihood in numpy on SAMPLE documents (smallest hash of the text), labelled by the
rules; each labelled word also stands for a mention that the rules would miss, which is how skip links learn to carry
a label to another spelling of the same number or address. All documents of an Arrow batch are one graph of disjoint parts, so a pass is a few array operations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ADD = 0.9
ROUNDS = 8
SAMPLE = 1500
CLAMP = 12.0
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match of these starts where a run of digits starts, so the look-behind and possessive repeats only save time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CANDIDATE = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_FIRST = re.compile(r"[\w@+(]")
_LAST = re.compile(r"[\w)]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules, by start and then kind as listed."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last if m else 0))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


N_FEATURES = 40


def _features(word: str) -> list[int]:
    """Word-shape features."""
    digits = sum(c.isdigit() for c in word)
    out = [0, 1 + min(digits, 20)]
    out += [22 + min(3, word.count("."))]
    for k, hit in enumerate(("@" in word, word.startswith("+"), word.startswith("("), word.endswith(")"), "-" in word, any(c.isalpha() for c in word), len(word) == digits, ":" in word, "/" in word, "%" in word)):
        if hit:
            out.append(26 + k)
    return out


def _bare(span: str) -> str:
    """Another spelling of what a rule found: an address without its domain, else the digits alone."""
    return span.partition("@")[0] + "@" if "@" in span else _NOT_DIGIT.sub("", span)


@dataclass
class Graph:
    """Candidate words of documents: features, rule labels, chain and skip links (pairs of word numbers); the features of the bare spelling."""

    doc: list[int]
    start: list[int]
    end: list[int]
    features: list[list[int]]
    label: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    bare: list[list[int]] = field(default_factory=list)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The word without punctuation at its ends; a + or ( stays in front, a ) behind."""
    first = _FIRST.search(text, start, end)
    if not first:
        return end, end
    while not _LAST.match(text, end - 1):
        end -= 1
        if end <= first.start():
            return end, end
    return first.start(), end


def build_graph(texts: list[str | None], bases: list[list[tuple[int, int, str]]]) -> Graph:
    g = Graph([], [], [], [], [], [], [])
    for d, (text, spans) in enumerate(zip(texts, bases, strict=True)):
        if not text or not (_DIGIT.search(text) or "@" in text):
            continue
        before, seen, k = -1, {}, 0
        for m in _WORD.finditer(text):
            s, e = trimmed(text, *m.span()) if _CANDIDATE.search(m[0]) else (0, 0)
            if s >= e:
                continue
            word = text[s:e]
            while k < len(spans) and spans[k][1] <= s:
                k += 1
            own = next((x for x in spans[k : k + 4] if x[0] < e and s < x[1]), None)
            label = LABELS.index(own[2]) if own else 0
            n = len(g.doc)
            g.doc.append(d)
            g.start.append(s)
            g.end.append(e)
            g.features.append(_features(word))
            g.label.append(label)
            g.bare.append(_features(_bare(text[own[0] : own[1]])) if own else [])
            if before >= 0 and s - g.end[before] <= 3:
                g.chain.append((before, n))
            before = n
            digits = _NOT_DIGIT.sub("", word)
            name = word.partition("@")[0].lower()
            key = (name if len(name) >= 5 else word.lower()) if "@" in word else digits[-7:] if len(digits) >= 7 else ""
            if key:
                if key in seen:
                    g.skip.append((seen[key], n))
                seen[key] = n
    return g


@dataclass
class Crf:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, left to right
    skip: np.ndarray  # labels x labels, symmetric


def _scores(g: Graph, crf: Crf) -> np.ndarray:
    row = np.repeat(np.arange(len(g.doc)), [len(f) for f in g.features])
    col = np.concatenate([np.array(f) for f in g.features]) if g.doc else np.zeros(0, int)
    out = np.zeros((len(g.doc), len(LABELS)))
    np.add.at(out, row, crf.unary[col])
    return out


def train_crf(g: Graph, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Crf:
    """Pseudo-likelihood: each word's label given its neighbours' labels, by full-batch Adam.

    The rules label only what they can read, so a word without a label that a skip link ties to a labelled one is
    unknown and has no term; in its place each labelled word has a second term as a mention that the rules miss:
    the bare spelling of its span, one skip link to a mention of its own label.
    """
    n, k = len(g.doc), len(LABELS)
    x = np.zeros((n, N_FEATURES + 3 * k))
    for i, f in enumerate(g.features):
        x[i, f] = 1
    label = np.array(g.label, int)
    for a, b in g.chain:
        x[b, N_FEATURES + label[a]] += 1
        x[a, N_FEATURES + k + label[b]] += 1
    for a, b in g.skip:
        x[a, N_FEATURES + 2 * k + label[b]] += 1
        x[b, N_FEATURES + 2 * k + label[a]] += 1
    unknown = np.zeros(n, bool)
    for a, b in g.skip:
        unknown[a] |= label[a] == 0 and label[b] > 0
        unknown[b] |= label[b] == 0 and label[a] > 0
    known = np.flatnonzero(label) if g.bare else np.zeros(0, int)
    missed = np.zeros((len(known), x.shape[1]))
    for i, word in enumerate(known):
        missed[i, g.bare[word]] = 1
        missed[i, N_FEATURES + 2 * k + label[word]] = 1
    x, label = np.vstack([x[~unknown], missed]), np.concatenate([label[~unknown], label[known]])
    n = len(label)
    w = np.zeros((x.shape[1], k))
    m, v = np.zeros_like(w), np.zeros_like(w)
    y = np.eye(k)[label]
    for t in range(1, steps + 1 if n else 0):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (p - y) / n + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    left, right, far = w[N_FEATURES : N_FEATURES + k], w[N_FEATURES + k : N_FEATURES + 2 * k], w[N_FEATURES + 2 * k :]
    return Crf(w[:N_FEATURES], (left + right.T) / 2, (far + far.T) / 2)


def marginals(g: Graph, crf: Crf, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product, all messages at once with damping: words x labels."""
    own = _scores(g, crf)
    label = np.array(g.label, int)
    fixed = np.flatnonzero(label)
    own[fixed] = -CLAMP
    own[fixed, label[fixed]] = CLAMP
    pairs = np.array(g.chain + g.skip, int).reshape(-1, 2)
    table = np.concatenate([np.repeat(crf.chain[None], len(g.chain), 0), np.repeat(crf.skip[None], len(g.skip), 0)]) if len(pairs) else np.zeros((0, len(LABELS), len(LABELS)))
    a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    pot = np.concatenate([table, table.transpose(0, 2, 1)])  # from a (rows) to b (columns)
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(a), len(LABELS)))
    for _ in range(rounds if len(a) else 0):
        belief = own.copy()
        np.add.at(belief, b, message)
        out = (belief[a] - message[back])[:, :, None] + pot
        top = out.max(1, keepdims=True)
        new = top[:, 0] + np.log(np.exp(out - top).sum(1))
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    belief = own.copy()
    np.add.at(belief, b, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find_spans(texts: list[str | None], crf: Crf) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int, str]]]]:
    """(rule spans, all spans) of each text; neighbouring words of one kind join into one added span."""
    bases = [base_spans(t) for t in texts]
    g = build_graph(texts, bases)
    spans = [list(b) for b in bases]
    if g.doc:
        p = marginals(g, crf)
        best = p.argmax(1)
        sure = (p.max(1) >= ADD) & (best > 0) & (np.array(g.label) == 0)
        linked = set(g.chain)
        added: list[list] = []
        for n in np.flatnonzero(sure).tolist():
            if added and added[-1][4] == n - 1 and added[-1][3] == best[n] and (n - 1, n) in linked:
                added[-1][2], added[-1][4] = g.end[n], n
            else:
                added.append([g.doc[n], g.start[n], g.end[n], best[n], n])
        for d, s, e, k, _ in added:
            if not any(x[0] < e and s < x[1] for x in bases[d]):
                spans[d].append((s, e, LABELS[k]))
    return bases, [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for s in spans]


def fit_pii(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Crf:
    """Train on at most `sample` texts with a digit or an `@`."""
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = [r["text"] for r in hashed_sample(rows, F.xxhash64("text"), sample, rows.count()).collect()]
    return train_crf(build_graph(texts, [base_spans(t) for t in texts]))


def detect_pii(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of docs.

    The counts and the digest are of the rules' spans; spans lists all. A null text is empty. Offsets are code
    points. Repeated rows repeat; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            bases, spans = find_spans(b.column("text").to_pylist(), crf)
            counts = {f"n_{k}": [sum(s[2] == k for s in x) for x in bases] for k in KINDS}
            yield {"doc_id": b.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in bases], "spans": [joined(x) for x in spans]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span, or each group of overlapping ones, replaced by the first one's kind in angle brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, crf: Crf, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced in the text (and its length renewed); all columns and rows stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            _, spans = find_spans(texts, crf)
            yield {c: b.column(c) for c in names} | {text_col: [redact(t, s) for t, s in zip(texts, spans, strict=True)]}

    out = map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
