"""Whitening, collocations and byte BPE: against plain Python, the tokenizer library and exact arithmetic; hard rows."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import ann, byte_bpe, collocations, queries, whitening

BIG = (1 << 53) + 1
DOC = "doc_id long, text string, lang string, source string, n_chars long, lang_ string, x string, size string, key string"


def doc(i, text, lang="en"):
    return (i, text, lang, "s", 1, "l", "x", "s", "k")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- byte BPE ---------------------------------------------------------------------------------------


def test_minimal_perfect_hash(vocabulary):
    assert sorted(vocabulary.slot.tolist()) == list(range(len(vocabulary.tokens)))
    assert vocabulary.find(vocabulary.tokens).tolist() == list(range(len(vocabulary.tokens)))
    import pyarrow as pa

    others = [t + b"\xff\x00" for t in vocabulary.tokens.to_pylist()[::37]]
    assert (vocabulary.find(pa.array(others, pa.binary())) == -1).all()
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary.load(__file__, "x")


def test_encoding_is_the_librarys(vocabulary, library):
    rnd = random.Random(1)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0x500), lambda: rnd.randrange(0x3000, 0xD7FF), lambda: rnd.randrange(0x10000, 0x110000), lambda: rnd.choice([32, 10, 39, 9, 0x85, 0xA0])]
    texts = ["", " ", "<|endoftext|> 's 'LL don't\n\n  x", "\x00\x1c a", "x" * 60_000, "ab" * 3000 + " " * 4000 + "z", "\U00018da7a\U00018da71՘", "é" * 3000 + "1" * 500]
    texts += ["".join(chr(rnd.choice(kinds)()) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    coder = byte_bpe.Coder(vocabulary)
    got = coder.encode([t.encode() for t in texts])
    assert got == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert coder.decode(got) == [t.encode() for t in texts]


def test_every_code_point_is_split_as_the_library_does(vocabulary):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != "'"]
    ranks = {bytes([b]): b for b in range(256)}
    for c in points:
        for p in (b"a", b"1", b"!"):
            ranks.setdefault(p + chr(c).encode(), len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.Coder(vocabulary)
    for s in range(0, len(points), 50_000):
        run = [p + chr(c) for c in points[s : s + 50_000] for p in "a1!"]
        whole = [len(probe.encode_ordinary(t)) == 1 for t in run]
        assert [len(next(coder.pieces(t))) == 1 for t in run] == whole


def test_coding_hard_rows(spark, vocabulary, library):
    rows = [doc(1, None), doc(2, ""), doc(None, "null id"), doc(BIG, "same"), doc(BIG, "same"), doc(4, "long word " * 60_000, None)]
    df = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit("old")).withColumnRenamed("x", "a b.c")
    coded = byte_bpe.encode_bpe(df, vocabulary)
    assert [c for c in coded.columns if c != "ids"] == [c for c in df.columns if c not in ("text", "ids")]
    got = byte_bpe.decode_bpe(coded, vocabulary).select("doc_id", "ids", "decoded", "`a b.c`").collect()
    want = collections.Counter((r[0], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode(), "x") for r in rows)
    assert collections.Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]), r["a b.c"]) for r in got) == want
    odd = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\xff")), (2, bytearray(b"123")), (3, None)], "i int, ids binary")
    assert [r["decoded"] for r in byte_bpe.decode_bpe(odd, vocabulary).collect()] == [None] * 3
    assert byte_bpe.encode_bpe(df.limit(0), vocabulary).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61ff62' AS string) AS text")
    assert bytes(byte_bpe.encode_bpe(broken, vocabulary).first()["ids"]) == np.array(library.encode_ordinary("a�b"), "<u4").tobytes()


def test_bpe_query(spark, library, tmp_path):
    spark.createDataFrame([doc(i, t) for i, t in enumerate(["Hello  wörld's", None, "x1y2 " * 9])], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_byte_bpe(spark, f"file://{tmp_path}").collect():
        text = ["Hello  wörld's", "", "x1y2 " * 9][r["doc_id"]]
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert r[:] == (r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# --- collocations -----------------------------------------------------------------------------------


def phrases_of(rows, least, top, subsumed=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in (text or "").encode().lower().translate(collocations._MARKS).split(b"."):
            w = [x for x in piece.replace(b"\t", b" ").split(b" ") if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least or any(len(q) > len(p) and b >= least and 100 * b >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, b" ".join(p), left, right))
        out[lang] = [(r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(4)
    words = ["a", "B", "c", "dd", "É", "ee", "f-f"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", ",", " x y z "]) for _ in range(n))
    rows = [doc(i, text(rnd.randrange(60)), rnd.choice(["en", "en", "de", None, "und"])) for i in range(60)]
    return rows + [doc(None, "a b"), doc(BIG, None), doc(BIG, ""), doc(7, " .\t. "), rows[3], rows[3], doc(8, "one " * 3000, "fr"), doc(9, "l1\nl2", "a\nb")]


@pytest.mark.parametrize(("shard", "segment"), [(1 << 21, 1 << 20), (50, 40), (3, 7)])
def test_collocations_are_brute_force(spark, talk, monkeypatch, shard, segment):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "SEGMENT", segment)
    monkeypatch.setattr(collocations, "CODED", 5)
    # run here, as workers would not see the small shards
    common = [("en", "a"), ("en", "b c"), ("de", "x")] if shard == 50 else []
    lists = spark.createDataFrame(list(_lists(talk, common)), "head string, salt int, tails string")
    assert lists.where("salt > 0").count() > 0 or not common
    monkeypatch.setattr(collocations, "phrase_lists", lambda *a: lists)
    got = collections.defaultdict(list)
    for r in collocations.collocations(spark.createDataFrame(talk, DOC), top=40, least=3).orderBy("lang", "rank").collect():
        got[r["lang"]].append(r[1:])
    assert dict(got) == {k: v for k, v in phrases_of(talk, 3, 40).items() if v}


def _lists(rows, common):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([(r[1] or "").encode() for r in rows], pa.binary())], ["lang", "x"])
    plain = lambda c: c if isinstance(c, list) else c.to_pylist()
    for c in collocations.shard_phrases(iter([batch]), common):
        yield from ((f"{h.decode()}\n{lang}", salt, t.decode()) for lang, h, salt, t in zip(*[plain(c[k]) for k in ("lang", "head", "salt", "tails")], strict=True))


def automaton(pieces):
    """A generalised suffix automaton, word by word: (longest length, link, endpos count, words) of each state."""
    size, link, step, count, label = [0], [-1], [{}], [0], [()]
    for piece in pieces:
        last = 0
        for at, w in enumerate(piece):
            if w in step[last] and size[step[last][w]] == size[last] + 1:
                last = step[last][w]
                count[last] += 1
                continue
            here = len(size)
            size.append(size[last] + 1), link.append(0), step.append({}), count.append(1), label.append(tuple(piece[: at + 1]))
            p, clone = last, None
            while p != -1 and w not in step[p]:
                step[p][w] = here
                p = link[p]
            if p != -1:
                q = step[p][w]
                if size[q] == size[p] + 1:
                    link[here] = q
                else:
                    clone = len(size)
                    size.append(size[p] + 1), link.append(link[q]), step.append(dict(step[q])), count.append(0), label.append(label[q][len(label[q]) - size[p] - 1 :])
                    while p != -1 and step[p].get(w) == q:
                        step[p][w] = clone
                        p = link[p]
                    link[q] = link[here] = clone
                    if p == -1 or size[here] == size[clone]:
                        pass
            last = here
    for s in sorted(range(1, len(size)), key=lambda s: -size[s]):
        if link[s] > 0:
            count[link[s]] += count[s]
    return size, link, count, label


def test_shards_have_the_states_of_an_automaton():
    rnd = random.Random(9)
    pieces = [[rnd.choice("abc") for _ in range(rnd.randrange(1, 9))] for _ in range(20)]
    shard = collocations.Shard()
    for p in pieces:
        shard.add([w.encode() for w in p])
        shard.add([b"."])
    got = {(" ".join(words), least, len(words)): n for words, least, n in shard.states()}
    # of the unbounded automaton each state's phrases of three words at most; a state's suffix link tells its shortest
    size, link, count, label = automaton(pieces)
    want = collections.defaultdict(int)
    for s in range(1, len(size)):
        low, high = size[link[s]] + 1, min(size[s], 3)
        if low <= high and count[s]:
            want[" ".join(label[s][len(label[s]) - high :]), low, high] = count[s]
    # states whose phrases are longer than the bound lie above it as several; they are one below it
    merged = collections.defaultdict(int)
    for (phrase, low, high), n in want.items():
        merged[phrase, low, high] = max(merged[phrase, low, high], n)
    assert got == dict(merged)


def test_collocations_hard_rows(spark, talk):
    df = spark.createDataFrame(talk, DOC).withColumnRenamed("source", "phrase")
    assert {r["lang"] for r in collocations.collocations(df).collect()} >= {"en"}
    assert collocations.collocations(df.limit(0)).count() == 0
    only = collocations.collocations(df.where("lang = 'fr'")).collect()
    assert [r["phrase"] for r in only] == ["one one one"] and only[0]["n"] == 3000


# --- whitening --------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, component string, n string, x string"


def test_whitening_against_exact_sums_and_eigenvectors(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(700, 40)) @ np.diag(np.geomspace(9, 0.03, 40)) + rng.normal(size=40) * 50).astype(np.float32)
    got = whitening.whitened_embeddings(spark.createDataFrame([(i, r.tolist(), 1, "c", "n", "x") for i, r in enumerate(v)], VEC).repartition(7)).toPandas()
    x = np.floor(v.astype(float) * 64).astype(np.int64) + 1_000_000
    top = x * len(x) - x.sum(0)
    cov = (top / len(x)).T @ (top / len(x)) / len(x)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 700 * 32 and set(got["n"]) == {700}
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(enumerate(sum(c * c for c in row) for row in top.tolist()))
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (top / len(x)) @ u[:, :32] / np.sqrt(e[:32])
    assert np.allclose(np.abs((w * want).mean(0)), 1, atol=1e-9) and np.allclose(w.T @ w / 700, np.eye(32), atol=1e-9)
    explained = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(explained, e[:32] / np.trace(cov), rtol=1e-9) and 0 <= got["identity_error"].max() < 1e-9


def test_jacobi():
    rng = np.random.default_rng(7)
    for rows, dim in ((1, 1), (3, 3), (9, 4), (5, 8), (40, 33)):
        a = rng.normal(size=(rows, dim)) * np.geomspace(1, 1e-7, dim)
        s, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
        assert np.allclose(v.T @ v, np.eye(dim), atol=1e-12)
        k = min(rows, dim)
        assert np.allclose(s[:k], np.linalg.svd(a, compute_uv=False), rtol=1e-8) and np.allclose((a @ v[:, :k]).T @ (a @ v[:, :k]), np.diag(s[:k] ** 2), atol=1e-12)


def test_whitening_hard_rows(spark):
    odd = [(1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [1.0]), (6, []), (7, [1e20, 1.0])]
    good = [(BIG, [0.0, 0.0]), (BIG, [0.0, 0.0]), (None, [1.0, 2.0]), (10, [3.0, -1.0]), (11, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "c", "n", "x") for r in odd + good], VEC)
    got = whitening.whitened_embeddings(df).collect()
    assert collections.Counter((r["vec_id"], r["component"]) for r in got) == collections.Counter((i, c) for i, _ in good for c in (1, 2))
    assert {r["n"] for r in got} == {5} and {r["deviation"] for r in got if r["vec_id"] == BIG} == {(64 * 6) ** 2 + (64 * 3) ** 2}
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 1, "c", "n", "x") for i in range(9)], VEC)
    assert {r["component"] for r in whitening.whitened_embeddings(flat).collect()} == {1}
    for few in (df.limit(0), df.where("vec_id < 5"), flat.limit(1)):
        assert whitening.whitened_embeddings(few).count() == 0
    wide = spark.createDataFrame([(i, [3e9 * i, 1.0 * (i % 3)]) for i in range(50)], "vec_id long, embedding array<double>")
    x = [[math.floor(64 * 3e9 * i) + 1_000_000, 64 * (i % 3) + 1_000_000] for i in range(50)]
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((50 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
    for r in whitening.whitened_embeddings(wide).collect():
        assert r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None)


# --- neighbours of vectors with unequal norms -------------------------------------------------------


def vectors(kind, spread, n=4000, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.25 * x
    return x / np.linalg.norm(x, axis=1)[:, None] * np.exp(spread * rng.normal(size=(n, 1)))


@pytest.mark.parametrize(("kind", "spread"), [("even", 0.0), ("even", 0.5), ("even", 1.0), ("clustered", 0.5), ("clustered", 1.0)])
def test_neighbours_of_unequal_norms(spark, kind, spread):
    x = vectors(kind, spread)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 40 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    found = 0
    for q in range(0, len(x), 40):
        dots = x @ x[q]
        dots[q] = -np.inf
        found += len(got[q] & set(np.argsort(-dots)[:20].tolist())) / 20
    assert len(got) == 100 and found / 100 >= 0.9
    fitted = ann.fit_index(x[:3000], len(x), 20)
    assert fitted.recall >= ann.LEAST_RECALL and (spread == 0 or fitted.met < 0.8)
