"""Hard rows for every training-data operator: large ids beside nulls, empty tables, texts that must not crash or take square time."""

import collections
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import ann, decontamination, html_text, language_id, license_scan, lm_scoring, mixing, ngram_join, pii, toxicity

BIG = (1 << 53) + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, m string, word string, label string"


@pytest.fixture(scope="module")
def few(spark):
    """Two large ids that a double can't tell apart, beside a null one, in one batch; clashing names."""
    text = "The ships came in at dawn and the harbour woke slowly. Released under the MIT License. Mail a.bc@example.com now."
    rows = [(BIG, text, "en", "a", 1, "x", "x", "x", "x"), (None, text + " Other words here.", "de", None, 1, None, None, None, None), (BIG - 1, "Una cosa distinta de todas las demas en la mesa.", "es", "b", 1, "x", "x", "x", "x")]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def _operators(docs, labels):
    bench = docs.select(F.col("doc_id").alias("item_id"), F.lit("The ships came in at dawn and the harbour woke slowly").alias("text"))
    return {
        "lm": lambda d: lm_scoring.lattice_scores(d, F.lit(False), class_col="lang"),
        "near": ngram_join.near_duplicates,
        "mixing": mixing.mix_sources,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)),
        "pii": lambda d: pii.detect_pii(d, pii.fit_pii(d)),
        "redact": lambda d: pii.redact_pii(d, pii.fit_pii(d)),
        "html": lambda d: html_text.extract_main_text(d, "text", ("doc_id", "lang")),
        "licenses": license_scan.scan_licenses,
        "leaks": lambda d: decontamination.contaminated(d, bench),
        "language": lambda d: language_id.predict_languages(d, language_id.fit_language_model(d), ["doc_id"]),
    }


@pytest.mark.parametrize("name", ["lm", "near", "mixing", "toxicity", "pii", "redact", "html", "licenses", "leaks", "language"])
def test_large_ids_and_empty_tables(few, name):
    labels = few.select("doc_id", F.lit(1).alias("toxic"))
    run = _operators(few, labels)[name]
    got = {r["doc_id"] for r in run(few).select("doc_id").collect()}
    assert BIG in got and got <= {BIG, BIG - 1, None}
    assert run(few.limit(0)).count() == 0
    if name == "near":
        assert {r["component_id"] for r in run(few).collect()} <= {BIG, BIG - 1, None}


def test_ann_large_ids_and_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) * 1e9
    x[7] = x[8]
    d = spark.createDataFrame([(BIG + i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 6)], "vec_id long, embedding array<double>")
    got = ann.nearest(d, F.col("vec_id") == BIG, k=59).orderBy("rank").collect()
    best = sorted(range(1, 60), key=lambda i: (-(x[i] * x[0]).sum(), i))
    assert [r["vec_id"] - BIG for r in got] == best


def test_ann_exact_where_no_shape_reaches_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_RECALL", 1.1)
    x = np.random.default_rng(5).normal(size=(200, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for q, rows in itertools.groupby(ann.nearest(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect(), key=lambda r: r["query_id"]):
        best = sorted((i for i in range(200) if i != q), key=lambda i: -(x[i] @ x[q]))[:20]
        assert [r["vec_id"] for r in rows] == best


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Small blocks and short runs, so that every path is taken: brute force agrees on a chain that drifts from its start."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "HOT_RUN", 4)
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(900)}" for _ in range(100)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            w[rnd.randrange(100)] = f"x{rnd.randrange(99999)}"
        texts.append(" ".join(w))
    for i in range(40):
        base[(i * 7) % 100] = f"y{i}"
        texts.append(" ".join(base))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(d).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


@pytest.fixture(scope="module")
def crf():
    rnd = random.Random(2)
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    texts = []
    for _ in range(300):
        texts.append(f"call +1 ({n(3)}) 555-{n(4)} or write to {rnd.choice('abcdef')}{n(3)}@mail.example.com about order {n(rnd.choice([2, 4, 6]))} of 20{n(2)}")
        texts.append(f"host 10.{rnd.randrange(200)}.{rnd.randrange(200)}.7 has {n(3)} jobs, item {n(rnd.choice([5, 8, 11]))} and {n(2)} %")
    return pii.train_crf(pii.build_graph(texts, [pii.base_spans(t) for t in texts]))


def test_pii_skip_links_carry_a_label(crf):
    """The second spelling has no plus, so no rule finds it; the skip link gives it the first one's label."""
    text = "Reach us at +1 (578) 555-6437 at noon. The board in the hall says 15785556437 in chalk."
    alone = pii.Crf(crf.unary, crf.chain, np.zeros_like(crf.skip))
    spans = lambda c: [(text[s:e], k) for s, e, k in pii.find_spans([text], c)[1][0]]
    assert spans(crf) == [("+1 (578) 555-6437", "phone"), ("15785556437", "phone")]
    assert spans(alone) == [("+1 (578) 555-6437", "phone")]
    unlinked = text.replace("says 15785556437", "says 15780000001")
    assert [k for _, _, k in pii.find_spans([unlinked], crf)[1][0]] == ["phone"]


def _base_by_regex(text):
    """The contract's rules, written plainly."""
    import re

    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_pii_base_against_plain_rules():
    rnd = random.Random(8)
    for _ in range(4000):
        text = "".join(rnd.choice(["a", "b.", "@", ".", "-", "+", " ", "(", ")", "1", "23", "456", "4111 1111 1111 1111", "10.0.0.1", "%", "é"]) for _ in range(rnd.randrange(30)))
        assert pii.base_spans(text) == _base_by_regex(text), text


def test_pii_long_texts_in_linear_time(crf):
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [(0, 5007, "ip")]
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []
    began = time.time()
    for text in ("x" * 1_000_000, "1" * 1_000_000, "a" + "!" * 300_000 + "1", "!" * 300_000 + "1" + "?" * 300_000, "@" * 300_000, "+1(" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.find_spans([text], crf)
    assert time.time() - began < 60


BODY = "Plain words of an article that go on for a while, as such words do. "


def test_html_declarations_and_open_markup():
    want = (BODY * 3).strip()
    for page in (f"<article><p>{BODY * 3}</p></article><![foo[ a ]]>", f"<!DOCTYPE html [<!ELEMENT a (b)> ]><article><p>{BODY * 3}</p></article>", f"<article><p>{BODY * 3}</p></article><!-- open <p>no</p>", f"<article><![CDATA[ no ]]><p>{BODY * 3}</p></article>", f"<article><p>{BODY * 3}</p></article><a href='no"):
        assert html_text.main_text(page) == want
    for page in ("<", "<!", "<!-", "</", "<a", "&#xfffffffff;", "&#0;&bogus;x &lt", "<![if !IE]>", "<?php x ?>", "<![CDATA[", "<!DOCTYPE ["):
        html_text.main_text(page)


def test_html_in_linear_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<p><b>" * 50_000, "<ul><li>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<" * 100_000, "<a " * 100_000, "<a '" * 100_000 + ">", "&" * 100_000, "x " * 500_000):
        html_text.main_text(page)
    assert time.time() - began < 60


def test_html_planted_articles(spark):
    """Pages put together from known blocks come back as exactly their articles, with or without an article element."""
    rnd = random.Random(6)
    words = "river stone market letter garden winter silver morning teacher window paper".split()
    para = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    pages, want = [], {}
    for i in range(60):
        blocks = [para(rnd.randrange(25, 70)) for _ in range(rnd.randrange(2, 6))]
        inner = "".join(f"<p>{b.replace('stone', '<b>stone</b>')}</p>" for b in blocks)
        menu = "<nav>" + "".join(f"<a href='/{w}'>{w}</a>" for w in words) + "</nav>"
        around = ("<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>", "<td>{}</td>")[i % 4]
        aside = "<div class='sidebar'><p>" + para(30) + "</p></div>" if i % 2 else ""
        pages.append((i, None, f"<html><head><title>t</title></head><body>{menu}<header><h1>Site</h1></header>{around.format(inner)}{aside}<footer>{para(8)}</footer><script>var a = 1;</script></body></html>"))
        want[i] = "\n\n".join(blocks)
    pages += [pages[0], (100, "u", None), (101, "u", "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_main_text(d).collect()]
    assert sorted(got) == sorted([(i, t, len(t)) for i, t in want.items()] + [(0, want[0], len(want[0])), (100, "", 0), (101, "", 0)])


def test_licenses_planted(spark):
    """Every template, as it is and with a word changed where it is long enough, is found in prose; prose alone has none."""
    rnd = random.Random(9)
    words = "river stone market letter garden winter silver morning teacher window paper the of and was".split()
    prose = lambda: " ".join(rnd.choice(words) for _ in range(40)).capitalize() + ". "
    rows, want = [], {}
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        rows.append((i, prose() + text + ("" if text.endswith(".") else "\n") + " " + prose()))
        want[i] = (name, 0)
        w = text.split()
        if len(w) > 14:
            w[3] = "pebble"
            rows.append((100 + i, prose() + " ".join(w) + "\n" + prose()))
            want[100 + i] = (name, 1)
    rows += [(1000 + i, prose() * 3) for i in range(30)] + [(2000, None), (2001, "")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["differing_words"]) for r in got} == want and len(got) == len(want)


def test_toxicity_of_labels_held_out(spark):
    """Of the rows whose labels the fit doesn't see, most toxic ones are flagged and few others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 4 <> 1"))
    held = labels.where("doc_id % 4 = 1").select("doc_id", F.col("toxic").alias("said"))
    got = {r["said"]: (r["n"], r["flagged"]) for r in toxicity.score_toxicity(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").groupBy("said").agg(F.count("*").alias("n"), F.count_if("toxic").alias("flagged")).collect()}
    assert got[1][1] >= 0.85 * got[1][0] and got[0][1] <= 0.03 * got[0][0], got


def test_decontamination_of_short_items_and_repeats(spark):
    b = spark.createDataFrame([(4, "Who wrote Hamlet?"), (5, "Yes"), (6, None), (7, "")], "item_id long, text string")
    d = spark.createDataFrame([(5, "I ask who wrote Hamlet, said he. Yes"), (6, "yes!"), (7, None), (None, "Who wrote Hamlet?"), (8, "who wrote Macbeth"), (6, "yes!"), (9, "x " * 200_000)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()) == [(5, 4), (6, 5)]


def test_decontamination_of_long_runs(spark):
    """Names or numbers by the ten thousand in a row are one slot each; they cost no stack, and the item behind them is found."""
    item = "which old bridge over the wide river was built before the great fire"
    names, numbers = "we met " + "Anna Bert " * 50_000 + "there. ", "1,2." * 100_000 + "3 "
    d = spark.createDataFrame([(1, names + item), (2, numbers + item), (3, names + numbers)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, numbers + "apples and Carl Dora " * 30_000 + "said so")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()) == [(1, 1), (2, 1)]
    sizes = d.select(F.size(decontamination.template_tokens(F.col("text"))).alias("t"), F.size(decontamination.raw_tokens(F.col("text"))).alias("r"))
    assert [(r["t"], r["r"]) for r in sizes.collect()] == [(17, 17), (14, 14), (5, 5)]


def test_texts_without_an_id_bridge(spark):
    """1 and 3 differ, but both link with a text that only a row without an id has."""
    one = [f"w{i}" for i in range(60)]
    two = ["odd" if i == 8 else w for i, w in enumerate(one)]
    three = ["strange" if i == 50 else w for i, w in enumerate(two)]
    rows = [(1, " ".join(one)), (None, " ".join(two)), (3, " ".join(three)), (None, " ".join(two)), (4, "on its own"), (None, "alone too"), (None, None)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == collections.Counter([(1, 1), (None, 1), (3, 1), (None, 1), (4, 4), (None, None), (None, None)])


def test_contaminated_rows_with_long_runs_go(spark):
    """The pipeline's third stage on a run of names that takes more stack than a task has."""
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()["text"]
    run = "we met " + "Anna Bert " * 20_000 + "there. "
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, run + item), (2, run), (3, item)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.remove_benchmark(spark, docs, "/root/testdata/sf0.001").collect()] == [2]


def test_contaminated_rows_go_by_row(spark):
    """A row without an id that holds an item goes, a clean one that shares its id with such a row stays."""
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, f"Before it. {item} And after."), (5, item), (5, "a clean text of its own"), (6, "another clean text"), (None, "clean without an id"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.remove_benchmark(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter(rows[2:])
