"""The training-data operators on small fixtures: hard rows, and brute force or held-out truth."""

import collections
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann, decontamination, html_text, language_id, license_scan, lm_scoring, mixing, ngram_join, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, m string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 5, 40, 80]))), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 1, "k", None))
    base = rows[7][1].split() * 3
    rows += [(100 + i, " ".join([*base[:i], "odd", *base[i + 1 :]]), "en", "a", 1, "k", "x") for i in range(20, 40)]
    rows += [rows[0], rows[0], (200, None, None, None, None, None, None), (201, "", "en", "a", 0, "k", "m"), (202, " \n\t ", "en", "b", 3, "k", "m"), (None, "w1 w2 w3", "en", "a", 8, "k", "m"), (203, "w9 " * 30000, "en", "a", 90000, "k", "m")]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(spark, docs):
    data = [(r["doc_id"], shingles(r["text"])) for r in docs.select("doc_id", "text").collect()]
    up = {i: i for i, _ in data if i is not None}

    def root(x):
        return x if up[x] == x else root(up[x])

    for (a, x), (b, y) in itertools.combinations([d for d in data if d[0] is not None], 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == root(r["doc_id"])
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_part_keys_lose_no_link():
    rng = np.random.default_rng(1)
    edges = ngram_join.band_edges(1000)
    for n in (4, 5, 9, 10, 23, 60, 150, 400):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            keep = int(np.ceil(0.8 * len(a)))
            b = np.sort(a[rng.permutation(len(a))[:keep]])
            if 100 * keep >= 80 * len(a) and keep < len(a):
                assert set(ngram_join.part_keys(a, edges).tolist()) & set(ngram_join.part_keys(b, edges).tolist())


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b" ab", b"ba", b" "]
    w = np.log(np.array([0.2, 0.2, 0.2, 0.1, 0.1, 0.2]))
    into = np.zeros((2, 6))
    got = lm_scoring.Lattice(pieces, np.stack([w, w - 1])).score([b"aba", b"a"], np.array([[1.0, 1.0], [0.0, 1.0]]), into)

    def total(s):
        return 1.0 if not s else sum(np.exp(w[i]) * total(s[len(p) :]) for i, p in enumerate(pieces) if s.startswith(p))

    assert np.allclose(np.exp(got[0]), [total(b" aba"), total(b" a")])
    # " a" is one piece, or a space and an a
    whole = 0.2 / (0.2 + 0.2 * 0.2)
    assert np.allclose(into[1], [whole, 1 - whole, 0, 0, 0, 1 - whole]) and into[0].sum() > 2


def test_lattice_scores(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm_scoring.lattice_scores(docs, held, class_col="lang", hot=5).collect()
    rows = docs.select("doc_id", "text").collect()
    learn = [r["text"] or "" for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    c = collections.Counter(w for t in learn for w in t.encode().lower().split())
    n, v = sum(c.values()) + len(learn), len(c) + 1
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        w = (text[r["doc_id"]] or "").encode().lower().split()
        assert r["train_tokens"] == n and r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(c[x] > 0 for x in w) + 1
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learn) + 1) / (n + v + 1))
        assert abs(r["base_score"] - base) < 1e-4 * max(1, abs(base)) and r["vocabulary_score"] < r["score"] < 0
    assert lm_scoring.lattice_scores(docs.limit(0), held).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs, block=16).toPandas()
    again = mixing.mix_sources(docs, block=16).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    assert sorted(map(tuple, got.fillna(-1).values)) == sorted(map(tuple, again.fillna(-1).values))
    by = got.groupby(["source_size", "target"]).taken.sum()
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 0.1 * target + 64
    assert abs(by.index.get_level_values("target").to_numpy().sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum()
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[50] = x[51]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (903, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        hit += len(set(best) & set(mine.vec_id))
        assert np.allclose(mine.score, s[mine.vec_id]) and (mine.score.diff().dropna() <= 1e-12).all()
    assert hit >= 0.9 * 15 * 20
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_ann_fills_every_query(spark):
    """Every query gets k neighbours or all candidates: small tables, and outliers whose buckets are empty."""
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=(10, 16)), rng.normal(size=(20, 16)), np.vstack([rng.normal(size=(1, 16)) + 4 + rng.normal(size=(1500, 16)) * 0.05, -40 * rng.normal(size=(4, 16))])):
        d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        asked = [0, 1, 2, 3, *range(len(x) - 4, len(x))]
        got = ann.nearest(d, F.col("vec_id").isin(asked)).toPandas()
        assert got.groupby("query_id").size().to_dict() == {q: min(20, len(x) - 1) for q in asked}
        if len(x) <= 21:
            for q in asked:
                best = sorted((i for i in range(len(x)) if i != q), key=lambda i: -(x[i] @ x[q]))
                assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == best


def test_ordinal_four_grades():
    rng = np.random.default_rng(0)
    feats, grades = [], []
    for _ in range(1500):
        g = int(rng.integers(0, 4))
        feats.append(np.unique(np.concatenate([rng.integers(100, 400, 8), np.arange(g) + 1]).astype(np.int32)))
        grades.append(g)
    m = toxicity.fit_ordinal(feats, grades)
    sev, best = m.severity(np.array([m.weights[f].sum() for f in feats]))
    assert (np.diff(m.thresholds) > 0).all() and (best == grades).mean() > 0.9
    assert [sev[np.array(grades) == k].mean() for k in range(4)] == sorted(sev[np.array(grades) == k].mean() for k in range(4))


def test_toxicity_rows(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("text"))
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert got.count() == docs.count()
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs.limit(0), labels.limit(0))).where("toxic").count() == 0


def test_toxicity_of_rare_forms(spark):
    """Toxic words of the smaller language are forms of one stem, each in a few rows only; held-out rows are flagged."""
    rnd = random.Random(5)
    ends = ["".join(x) for x in itertools.product("aeiou", "lmnrst", "aeiou")]
    rows = []
    for i in range(2400):
        toxic, small = i % 10 == 0, i % 4 == 0
        text = [("z" if small else "q") + rnd.choice(ends) + rnd.choice(ends) for _ in range(30)]
        rows.append((i, " ".join([*text, *(["vilestem" + rnd.choice(ends) for _ in range(3)] if small else ["scum"]) * toxic]), int(toxic), small))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, small boolean")
    model = toxicity.fit_toxicity(table.select("doc_id", "text"), table.where("doc_id < 1800").select("doc_id", "toxic"))
    got = toxicity.score_toxicity(table.where("doc_id >= 1800"), model).select("doc_id", F.col("toxic").alias("flag")).join(table, "doc_id")
    said = {(r["small"], r["toxic"]): (r["n"], r["flagged"]) for r in got.groupBy("small", "toxic").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged")).collect()}
    assert all(said[small, 1][1] >= 0.95 * said[small, 1][0] and said[small, 0][1] <= 0.02 * said[small, 0][0] for small in (True, False)), said


def test_pii_rules_and_crf(spark, docs):
    t = "mail a.b@x.example.com, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (578) 555-6437."
    kinds = [(k, t[s:e]) for s, e, k in pii.base_spans(t)]
    assert kinds == [("email", "a.b@x.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (578) 555-6437")]
    g = pii.build_graph([t, "seen +15785556437 then (578)5556437"], [pii.base_spans(t), pii.base_spans("seen +15785556437 then (578)5556437")])
    crf = pii.train_crf(g, steps=50)
    p = pii.marginals(g, crf)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1)[np.array(g.label) > 0] == np.array(g.label)[np.array(g.label) > 0]).all()
    assert pii.redact("a b@c.d e", [(2, 7, "email")]) == "a <email> e"
    assert pii.detect_pii(docs, crf).count() == docs.count()


def test_marginals_on_a_tree_are_exact():
    g = pii.Graph([0, 0, 0], [0, 5, 9], [3, 8, 12], [[0], [0, 3], [0, 5]], [0, 0, 0], [(0, 1)], [(1, 2)])
    rng = np.random.default_rng(2)
    skip = rng.normal(size=(5, 5))
    crf = pii.Crf(rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), skip + skip.T)
    own, p = pii._scores(g, crf), np.zeros((3, 5))
    for a, b, c in itertools.product(range(5), repeat=3):
        w = np.exp(own[0, a] + own[1, b] + own[2, c] + crf.chain[a, b] + crf.skip[b, c])
        p[0, a] += w
        p[1, b] += w
        p[2, c] += w
    assert np.allclose(pii.marginals(g, crf, rounds=80), p / p.sum(1, keepdims=True), atol=1e-6)


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy &amp; go</div><article><h1>Big   title</h1><p>One &amp; two<br>three<p>Four words are here</article><aside>s</aside><footer>&copy; me</footer><script>var a='</p>'</script></body></html>"
    assert html_text.main_text(page) == "Big title\n\nOne & two three\n\nFour words are here"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<div>" + "plain text of some length here. " * 5 + "</div>").startswith("plain text")


def test_html_open_heads_and_marks_inside():
    """A head without an end tag, self-closed skipped elements, headings and sections whose names only look like menus."""
    body = "Plain words of an article that go on for a while. " * 3
    want = body.strip()
    assert html_text.main_text(f"<html><head><title>t</title><body><article><p>{body}</p></article></body></html>") == want
    assert html_text.main_text(f"<head><meta charset=x><article><p>{body}</p></article>") == want
    assert html_text.main_text(f"<body><article><svg/><iframe src=x /><p>{body}</p></article>") == want
    page = f"<article><div class='entry-header'><h1>One</h1></div><h2 id='search'>Two</h2><section id='related-work'><p>{body}</p></section><div class='share'>x</div></article>"
    assert html_text.main_text(page) == f"One\n\nTwo\n\n{want}"


def test_licenses(spark, docs):
    s = license_scan.Scanner()
    assert s.match("Licensed under the Apache License, Version 2.0.")[0] == "Apache-2.0"
    assert s.match("This work is licensed under the GNU General Public License, version 3.")[2] == 0
    assert s.match("A licence to do as one likes, said the old fisherman to the sea.") is None
    assert license_scan.scan_licenses(docs).count() == 0


def test_licenses_inside_lines_and_over_lines():
    """Exact notices at the end of a line of prose, behind a copyright line, wrapped over comment lines, and beside others."""
    prose = "This folder has the tables of the river survey and the notes which our group took down on the boats. "
    mit = dict(license_scan.TEMPLATES[3:4])["MIT"].split()
    wrapped = "\n".join("# " + " ".join(mit[i : i + 11]) for i in range(0, len(mit), 11))
    s = license_scan.Scanner()
    held = lambda t: [(t[a:b].strip(), m[0], m[2]) for _, a, b, m in s.notices(t)]
    assert held(prose + "Released under the MIT License.") == [("Released under the MIT License.", "MIT", 0)]
    assert [h[1:] for h in held("Copyright 2019-2024 The River Survey Group and the many people who helped it, all rights reserved")] == [("Proprietary", 0)]
    assert held(prose + "Licensed under the Apache License, Version 2.0. Thanks!") == [("Licensed under the Apache License, Version 2.0.", "Apache-2.0", 0)]
    assert held("x = 1\n" + wrapped + "\ny = 2") == [(wrapped, "MIT", 0)]
    assert [h[1] for h in held("All rights reserved.\nReleased under the MIT License.")] == ["Proprietary", "MIT"]
    assert held(prose) == held("") == []


def test_decontamination_slots(spark):
    b = spark.createDataFrame([(1, "In the shop Anna has 12 apples and gives 5 apples to Bert then how many of the 12 remain"), (2, None), (3, "")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x y. In the shop Carl has 70 apples and gives 3 apples to Dora then how many of the 70 remain okay", 1), (2, "In the shop Anna has 12 apples and gives 5 apples to Bert then how many of the 12 remain", 1), (3, "nothing of the kind is in this text at all", 1), (4, None, 1), (5, "", 1), (None, "x", 1)], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.contaminated(d, b).collect()}
    assert got == {(1, 1): True, (2, 1): False}


def test_decontamination_repeated_windows(spark):
    """Items whose windows occur more than once, and a whole item behind a part of a like one."""
    run = "please continue the sequence 2, 4, 6, 8, 10, 12, 14, 16 and why does it go on so"
    prime = "Which is prime: 12, 15, 17, 21, 25, 27 or 33?"
    shop = "in the shop we saw 12 red apples and then 5 green pears while 7 old men sold 9 eggs"
    b = spark.createDataFrame([(1, run), (2, prime), (3, shop)], "item_id long, text string")
    part = "in the shop we saw 80 red apples and then 60 green pears while nobody came. "
    d = spark.createDataFrame([(1, "look: " + run), (2, prime), (3, part + shop), (4, run.replace("2, 4", "3, 5"))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.contaminated(d, b).collect()}
    assert got == {(1, 1): False, (2, 2): False, (3, 3): False, (4, 1): True}


def test_language_fit_holds_little_on_the_driver(spark, monkeypatch):
    """What the sample brings to the driver is under three bytes a distinct n-gram, and nothing is lost by it."""
    held, train = [], language_id._train
    monkeypatch.setattr(language_id, "_train", lambda rows, *rest: held.extend(rows) or train(rows, *rest))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    language_id.fit_language_model(docs)
    texts = [r["text"] for r in docs.where("text is not null and lang is not null").collect()]
    want = [np.unique(np.concatenate(p), return_counts=True) for t in texts if (p := list(language_id.subwords(t)))]
    size = sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for row in held for x in row[1:])
    assert len(held) == len(want) and size < 3 * sum(len(idx) for idx, _ in want)
    got = [language_id.unpack_counts(packed) for _, packed in held]
    pairs = lambda rows: sorted((idx.tolist(), n.tolist()) for idx, n in rows)
    assert pairs(got) == pairs(want)
    for most in (1, 255, 256, 65_536, 1 << 33):
        idx, n = language_id.unpack_counts(language_id.pack_counts(np.array([0, 5, 65_535]), np.array([1, most, 2])))
        assert idx.tolist() == [0, 5, 65_535] and n.tolist() == [1, most, 2]


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.9
    hard = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the of and")], "doc_id long, text string")
    m = language_id.fit_language_model(docs)
    out = {r["doc_id"]: r for r in language_id.predict_languages(hard, m, ["doc_id"]).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] in m.languages


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    key = lambda d: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(a) == key(b)


def test_pipeline_null_and_repeated_ids(spark):
    """Near-duplicate removal keeps clean rows whose id is null or repeated, and one row of each group."""
    import corpus_pipeline

    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (7, text("e")), (3, text("e")), (None, text("e")), (9, text("f")), (9, text("f"))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    got = sorted(((r["doc_id"] or 0, r["text"][0]) for r in corpus_pipeline.remove_near_duplicates(spark, d, SF).collect()))
    assert got == [(0, "a"), (0, "b"), (3, "e"), (5, "c"), (5, "d"), (9, "f")]


def test_pipeline_against_stages(spark):
    import corpus_pipeline as c

    out = c.run(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    dup = ngram_join.near_duplicates(spark.createDataFrame(docs)).toPandas()
    leaks = set(queries.op9_template_decontamination(spark, SF).toPandas().doc_id)
    want = set(dup[dup.doc_id == dup.component_id].doc_id) - leaks
    assert set(out.doc_id) == want
