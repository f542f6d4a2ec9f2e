"""The pipeline and the lattice scores against plain Python and SQL, computed another way."""

import collections
import itertools
import math
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language_id, lm_scoring, pii, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_pipeline_stage_by_stage(spark):
    """Language by the model's own prediction row by row, near copies by all pairs, leaks and the mix by SQL, redaction by spans."""
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source.toPandas()
    model = language_id.fit_language_model(source)
    said = [model.predict(t) for t in docs.text]
    docs["lang"] = [s[0] for s in said]
    docs = docs[[not s[2] for s in said]].reset_index(drop=True)

    sets, up = [shingles(t) for t in docs.text], list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[x if docs.doc_id[x] > docs.doc_id[y] else y] = x if docs.doc_id[x] < docs.doc_id[y] else y
    docs = docs[[root(i) == i for i in range(len(docs))]].reset_index(drop=True)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.register("documents", docs)
    docs = docs[~docs.doc_id.isin(con.execute(queries.DECONTAMINATION_SQL).df().doc_id)].reset_index(drop=True)

    crf = pii.fit_pii(spark.createDataFrame(docs))
    for i, spans in enumerate(pii.find_spans(docs.text.tolist(), crf)[1]):
        text, shift = docs.at[i, "text"], 0
        end = -1
        for s, e, k in spans:
            if s >= end:
                text = text[: s + shift] + f"<{k}>" + text[e + shift :]
                shift += len(k) + 2 - (e - s)
                end = e
            else:  # what an overlapping span adds behind the first goes too
                text = text[: end + shift] + text[max(e, end) + shift :]
                shift -= max(e, end) - end
                end = max(e, end)
        docs.at[i, "text"] = text
    con.unregister("documents")
    con.register("documents", docs)
    want = con.execute(queries.MIXING_SQL).df()

    got = corpus_pipeline.run(spark, SF).toPandas()
    key = lambda d: sorted((int(r.doc_id), int(r["size"]), int(r.source_size), round(float(r.target), 4), int(r.taken)) for _, r in d.iterrows())
    assert len(got) > 50 and key(got) == key(want)


def test_lattice_scores_of_all_segmentations(spark):
    """A few rows of two classes: counts, expected pieces, marginals and the mixture by plain recursion."""
    rows = [(i, t, c) for i, (t, c) in enumerate([("the cat sat on the mat", "a"), ("the dog sat", "a"), ("le chat noir", "b"), ("Le chien et le chat", "b"), ("", "a"), ("the chat zzyx", "a"), (None, "b"), ("un mat noir noir", None)])]
    held = {5, 6}
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lm_scoring.lattice_scores(d, F.col("doc_id").isin(*held), class_col="lang", hot=3).collect()}

    vocabulary = lm_scoring.load_vocabulary()
    top = max(vocabulary.values())
    given = {p: 1 / (top - s + lm_scoring.ZIPF) for p, s in vocabulary.items()}
    total = sum(given.values())
    given = {p: x / total for p, x in given.items()}
    longest = max(map(len, given))

    def forward(word, w):
        s, a = b" " + word, [1.0]
        for j in range(1, len(s) + 1):
            a.append(sum(a[i] * w.get(s[i:j], 0.0) for i in range(max(0, j - longest), j)))
        return a

    def expected(word):
        s, a = b" " + word, forward(word, given)
        b = [0.0] * len(s) + [1.0]
        for i in range(len(s) - 1, -1, -1):
            b[i] = sum(given.get(s[i:j], 0.0) * b[j] for j in range(i + 1, min(len(s), i + longest) + 1))
        out = collections.Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + longest) + 1):
                if s[i:j] in given:
                    out[s[i:j]] += a[i] * given[s[i:j]] * b[j] / a[-1]
        return out

    learn = [(words(t), c) for i, t, c in rows if i not in held]
    classes = ["a", "b", None]
    models = []
    for k in classes:
        c, ends = collections.Counter(x for w, y in learn if y == k for x in w), sum(y == k for _, y in learn)
        n1, n2, n = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()), sum(c.values()) + ends
        off = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
        pieces = sum((expected(x) for x in c), collections.Counter())
        whole = sum(pieces.values())
        weights = {p: lm_scoring.PRIOR * g + (1 - lm_scoring.PRIOR) * pieces[p] / whole for p, g in given.items()}
        models.append((c, ends, n, off, off * len(c) / n, weights))
    ends = sum(m[1] for m in models)
    for i, t, _ in rows:
        parts, alone = [], math.log10(ends / sum(m[2] for m in models))
        for c, e, n, off, share, w in models:
            parts.append(math.log10(e / ends) + math.log10(e / n) + sum(math.log10(max(c[x] - off, 0) / n + share * forward(x, w)[-1]) for x in words(t)))
        alone += sum(math.log10(forward(x, given)[-1]) for x in words(t))
        assert got[i]["score"] == pytest.approx(math.log10(sum(10**p for p in parts)), abs=2e-5)
        assert got[i]["vocabulary_score"] == pytest.approx(alone, abs=2e-5)


def test_lattice_beats_add_one_on_held_out_rows(spark):
    """Held-out rows of sf0.1 by token. (At sf0.01 one held-out word in six is new, which add-one, no distribution over words, gets too cheaply.)"""
    got = queries.op1_lattice_lm(spark, "/root/testdata/sf0.1").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    assert len(got) == len(docs) and (got.held_out == [zlib.crc32(str(i).encode()) % 7 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum()
