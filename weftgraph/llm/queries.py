"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, collocations, decontamination, html_text, language_id, license_scan, lm_scoring, mixing, ngram_join, pii, toxicity, whitening
from .common import documents


def _remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lattice_scores(documents(spark, sf_dir), _remainder(7) == 2, class_col="lang")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op4_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model)


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.detect_pii(docs, pii.fit_pii(docs))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit_language_model(docs, F.coalesce(_remainder(4) != 2, F.lit(True)))
    rows = docs.withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    return language_id.predict_languages(rows, model, ["doc_id", "held_out"])


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = byte_bpe.encode_bpe(documents(spark, sf_dir).select("doc_id", "text"), vocabulary)
    both = byte_bpe.decode_bpe(coded, vocabulary)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lattice_lm,
        op2_ngram_jaccard,
        op3_source_mixing,
        op4_multiprobe_ann,
        op5_ordinal_toxicity,
        op6_skip_chain_pii,
        op7_html_text,
        op8_license_compression,
        op9_template_decontamination,
        op10_language_id,
        op11_jacobi_whitening,
        op12_collocations,
        op13_byte_bpe,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM one a JOIN one b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM g
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, comp.component_id FROM g JOIN comp USING (doc_id)
"""

MIXING_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM ranked),
running AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER o, 0)::DOUBLE AS lft,
         (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS weights
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_free AS (SELECT ratio, rank, lft, weights FROM running WHERE lft * weight / weights <= cap ORDER BY ratio, rank LIMIT 1),
targets AS (
  SELECT r.source, r.rank, r.source_size, CASE WHEN r.ratio > f.ratio OR (r.ratio = f.ratio AND r.rank >= f.rank) THEN f.lft * r.weight / f.weights ELSE r.cap::DOUBLE END AS target
  FROM running r LEFT JOIN first_free f ON true
), bounds AS (SELECT *, sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM targets),
shape AS (
  SELECT sum(target) AS total, greatest(16, least(512, sum(source_size)::BIGINT // (1000 * greatest(1, count(*))))) AS block FROM targets
), chunked AS (
  SELECT doc_id, source, size, h, (h >> 30) % greatest(1, (SELECT count(*) FROM sizes) // 2000) AS chunk
  FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM sizes)
), line AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY chunk, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS pos FROM chunked
), slots AS (
  SELECT i AS id, ((i % 2147483648) * 1327217885 % 2147483648)::DOUBLE / 2147483648 * total AS point
  FROM shape, range((SELECT round(total / block)::BIGINT FROM shape)) t(i)
), placed AS (
  SELECT b.rank, ceil(b.source_size::DOUBLE / s.block)::BIGINT AS blocks, row_number() OVER (PARTITION BY b.rank ORDER BY id) - 1 AS r
  FROM slots JOIN bounds b ON point >= b.high - b.target AND point < b.high, shape s
), times AS (SELECT rank, r % blocks AS block, count(*) AS times FROM placed WHERE r < 2 * blocks GROUP BY ALL),
spans AS (SELECT l.*, b.rank, unnest(range(pos // s.block, (pos + size - 1) // s.block + 1)) AS k, s.block AS width FROM line l JOIN bounds b ON l.source IS NOT DISTINCT FROM b.source, shape s WHERE size > 0),
got AS (SELECT sp.rank, sp.pos, sum((least(pos + size, (k + 1) * width) - greatest(pos, k * width)) * t.times)::BIGINT AS taken FROM spans sp JOIN times t ON t.rank = sp.rank AND t.block = sp.k GROUP BY ALL)
SELECT l.doc_id, l.size, b.source_size, b.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM line l JOIN bounds b ON l.source IS NOT DISTINCT FROM b.source LEFT JOIN got g ON g.rank = b.rank AND g.pos = l.pos AND l.size > 0
"""


def _tagged_sql(text: str, raw: bool) -> str:
    keep = (lambda n: rf"\{n}") if raw else (lambda n: "")
    clean = rf"regexp_replace({text}, '[\x02\x03\x04\x05]', ' ', 'g')"
    one = rf"regexp_replace({clean}, '[0-9]+(?:[.,][0-9]+)*', ' ' || chr(2) || '{keep(0)}' || chr(3) || ' ', 'g')"
    two = rf"regexp_replace({one}, '(\x03 +)({decontamination.UNITS})([^\p{{L}}\p{{N}}]|$)', '\1' || chr(4) || '{keep(2)}' || chr(3) || ' \3', 'g')"
    return rf"regexp_replace({two}, '([\p{{Ll}},;:\x03] +)(\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*)', '\1' || chr(5) || '{keep(2)}' || chr(3) || ' ', 'g')"


_WINDOWS = "CASE WHEN len({t}) >= 5 THEN list_transform(range(1, len({t}) - 3), lambda i: array_to_string({t}[i:i + 4], ' ')) WHEN len({t}) > 0 THEN [array_to_string({t}, ' ')] ELSE [] END"
_SLOT = "substr({x}, 1, 1) IN (chr(2), chr(4), chr(5))"

DECONTAMINATION_SQL = rf"""
WITH items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
it0 AS (SELECT item_id, text, list_filter(string_split_regex(lower({_tagged_sql("text", False)}), '[^\p{{L}}\p{{N}}\x02\x04\x05]+'), lambda x: x <> '') AS t FROM items),
it AS (SELECT * FROM it0 WHERE len(t) >= 5),
brief AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM it0 WHERE len(t) < 5),
plain_docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM docs WHERE EXISTS (SELECT * FROM brief)),
brief_found AS (
  SELECT DISTINCT doc_id, item_id FROM plain_docs d, brief b
  WHERE len(b.w) > 0 AND (array_to_string(d.w, ' ') = array_to_string(b.w, ' ') OR (len(b.w) >= {decontamination.LEAST_WORDS} AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')))
),
dt AS (SELECT doc_id, list_filter(string_split_regex(lower({_tagged_sql("text", False)}), '[^\p{{L}}\p{{N}}\x02\x04\x05]+'), lambda x: x <> '') AS t FROM docs),
iw AS (SELECT DISTINCT item_id, unnest({_WINDOWS.format(t="t")}) AS h FROM it),
dw AS (SELECT DISTINCT doc_id, unnest({_WINDOWS.format(t="t")}) AS h FROM dt),
n AS (SELECT item_id, count(*) AS n_windows FROM iw GROUP BY item_id),
found AS (
  SELECT doc_id, item_id, count(*) AS hits, any_value(n_windows) AS n_windows FROM dw JOIN iw USING (h) JOIN n USING (item_id)
  GROUP BY doc_id, item_id HAVING count(*) >= {decontamination.CONTAINED} * any_value(n_windows)
), pair AS (
  SELECT f.doc_id, f.item_id, f.n_windows, md5(it.text || chr(0) || docs.text) AS t, regexp_extract_all({_tagged_sql("it.text", True)}, '[\x02\x04\x05][^\x03]*\x03|[\p{{L}}\p{{N}}]+') AS ir,
         regexp_extract_all({_tagged_sql("docs.text", True)}, '[\x02\x04\x05][^\x03]*\x03|[\p{{L}}\p{{N}}]+') AS dr
  FROM found f JOIN it USING (item_id) JOIN docs ON docs.doc_id = f.doc_id WHERE len(list_filter(it.t, lambda x: {_SLOT.format(x="x")})) > 0
), plain AS (
  SELECT *, list_transform(ir, lambda x: CASE WHEN {_SLOT.format(x="x")} THEN substr(x, 1, 1) ELSE lower(x) END) AS ip,
            list_transform(dr, lambda x: CASE WHEN {_SLOT.format(x="x")} THEN substr(x, 1, 1) ELSE lower(x) END) AS dp FROM pair
), wins AS (SELECT *, {_WINDOWS.format(t="ip")} AS iws, {_WINDOWS.format(t="dp")} AS dws FROM plain),
each_window AS (SELECT doc_id, item_id, ir, dr, p, list_position(dws, iws[p]) AS q FROM (SELECT *, unnest(range(1, len(iws) + 1)) AS p FROM wins)),
slots AS (
  SELECT DISTINCT doc_id, item_id, ir[p + k] AS a, dr[q + k] AS b FROM each_window, range(5) t(k)
  WHERE q IS NOT NULL AND q > 0 AND ir[p + k] IS NOT NULL AND dr[q + k] IS NOT NULL AND {_SLOT.format(x="ir[p + k]")}
), by_value AS (SELECT doc_id, item_id, a, count(*) AS vals, max(CASE WHEN a <> b THEN 1 ELSE 0 END) AS other FROM slots GROUP BY ALL),
checked AS (SELECT doc_id, item_id, avg(CASE WHEN vals = 1 THEN 1.0 ELSE 0.0 END) AS consistent, max(other) > 0 AS reparameterised FROM by_value GROUP BY doc_id, item_id),
unsure AS (SELECT w.*, row_number() OVER () AS u FROM wins w JOIN checked c USING (doc_id, item_id) WHERE c.consistent < {decontamination.AGREE} OR c.reparameterised),
own_places AS (SELECT u, p, iws[p] AS h FROM (SELECT u, iws, unnest(range(1, len(iws) + 1)) AS p FROM unsure)),
doc_places AS (SELECT u, q, dws[q] AS h FROM (SELECT u, dws, unnest(range(1, len(dws) + 1)) AS q FROM unsure)),
met AS (SELECT u, p, q, h, q - p AS off FROM own_places JOIN doc_places USING (u, h)),
near AS (
  SELECT m.u, pl.place, m.p, m.h, arg_min(m.q, (abs(m.off - pl.place), m.off)) AS q
  FROM met m JOIN (SELECT DISTINCT u, off AS place FROM met) pl ON m.u = pl.u JOIN unsure s ON s.u = m.u
  WHERE abs(m.off - pl.place) <= s.n_windows GROUP BY ALL
), enough AS (SELECT n.u, n.place FROM near n JOIN unsure s ON s.u = n.u GROUP BY n.u, n.place, s.n_windows HAVING count(DISTINCT n.h) >= {decontamination.CONTAINED} * s.n_windows),
place_slots AS (
  SELECT DISTINCT n.u, n.place, s.ir[n.p + k] AS a, s.dr[n.q + k] AS b FROM near n JOIN enough USING (u, place) JOIN unsure s ON s.u = n.u, range(5) t(k)
  WHERE s.ir[n.p + k] IS NOT NULL AND s.dr[n.q + k] IS NOT NULL AND {_SLOT.format(x="s.ir[n.p + k]")}
), place_values AS (SELECT u, place, a, count(*) AS vals, max(CASE WHEN a <> b THEN 1 ELSE 0 END) AS other FROM place_slots GROUP BY ALL),
place_checked AS (SELECT u, place, max(other) > 0 AS rep FROM place_values GROUP BY u, place HAVING avg(CASE WHEN vals = 1 THEN 1.0 ELSE 0.0 END) >= {decontamination.AGREE}),
held AS (SELECT doc_id, item_id, bool_or(NOT rep) AS verbatim FROM place_checked JOIN unsure USING (u) GROUP BY doc_id, item_id)
SELECT f.doc_id, f.item_id, f.hits::BIGINT AS hits, f.n_windows::BIGINT AS n_windows, coalesce(NOT h.verbatim, c.reparameterised, false) AS reparameterised
FROM found f LEFT JOIN checked c USING (doc_id, item_id) LEFT JOIN held h USING (doc_id, item_id)
WHERE coalesce(c.consistent, 1.0) >= {decontamination.AGREE} OR h.verbatim IS NOT NULL
UNION ALL SELECT doc_id, item_id, 1, 1, false FROM brief_found
"""

COLLOCATIONS_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 4) t(k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
halves AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:k], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ({collocations.SCALE}::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM halves c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase WHERE c.o = 1 AND 100 * coalesce(g.a, 0) < {collocations.SUBSUMED} * c.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""

ORACLE: dict[str, str] = {
    "op12_collocations": COLLOCATIONS_SQL,
    "op2_ngram_jaccard": NEAR_DUPLICATES_SQL,
    "op3_source_mixing": MIXING_SQL,
    "op9_template_decontamination": DECONTAMINATION_SQL,
}
