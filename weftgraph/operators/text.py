"""Text search: BM25 and trigrams with their indexes, line search, symbols, budgets."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .merge import round_robin

# fixed value: a search token
TOKEN = r"[\p{L}\p{N}_./:-]{2,}"


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf): lower-cased tokens of two characters or more."""
    words = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term"))
    return words.where("term is not null").groupBy("id", "term").agg(F.count("*").alias("tf"))


def _equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, id_col: str, text: Column, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with a term; only the terms' postings are kept, lengths come from the token count."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("_t"))
    hits = rows.select("id", F.size("_t").alias("len"), *[F.size(F.filter("_t", _equals(w))).alias(f"t{i}") for i, w in enumerate(terms)])
    stats = hits.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1.0) + (F.lit(float(stats["n"])) - stats[f"d{i}"] + 0.5) / (F.lit(float(stats[f"d{i}"])) + 0.5))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(stats["mean"] or 1))))
    return hits.where(" or ".join(f"t{i} > 0" for i in range(len(terms)))).select("id", score.alias("score"))


def diversify(hits: DataFrame, kind: str, limit: int) -> DataFrame:
    """Every kind's best hit first, kinds by their best score, then every kind's second, and so on.

    A kind's first `limit` hits are all that can be shown, so no more of it is ranked (a bounded top-k by kind).
    """
    best = hits.join(hits.groupBy(kind).agg(F.max("score").alias("best")), kind)
    return round_robin(first_group_rows(best, kind, [F.desc("score"), F.col("id")], limit), kind, [F.desc("score"), F.col("id")], [F.desc("best"), F.col(kind)]).limit(limit)


def _bucket(word: Column, buckets: int) -> Column:
    return (F.crc32(word.cast("binary")) % buckets).cast("int")


def term_places(tokens: Column) -> Column:
    """array<(term, positions, len)> of a text's terms in order: each distinct term once, with the places where it stands, ascending.

    len is the number of all its tokens; null if there are none. Made within the row, from the sorted pairs of term and place: a text's postings need no shuffle.
    """
    pairs = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at"))))

    def runs(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | (F.get(p, i - 1)["term"] != F.get(p, i - 2)["term"]))
        places = lambda b, after: F.transform(F.slice(p, b, F.coalesce(after, F.size(p) + 1) - b), lambda x: x["at"])
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda b, k: F.struct(F.get(p, b - 1)["term"].alias("term"), places(b, F.get(s, k + 1)).alias("positions"), F.size(p).alias("len"))))

    # arrays of one, so that what a lambda names is made once and not for each element
    return F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, F.flatten(runs(p)))))


def term_counts(tokens: Column) -> Column:
    """array<(term, tf, len)> of a text's terms in order, by their runs in its sorted tokens; null if there are none."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        tf = lambda b, after: (F.coalesce(after, F.size(w) + 1) - b).cast("long")
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda b, k: F.struct(F.get(w, b - 1).alias("term"), tf(b, F.get(s, k + 1)).alias("tf"), F.size(w).alias("len"))))

    return F.flatten(F.transform(F.array(F.sort_array(tokens)), lambda w: F.when(F.size(w) > 0, F.flatten(runs(w)))))


class _Index:
    """Postings below a folder, by a hash of the word: a search reads only the folders of its own words."""

    buckets = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, postings: DataFrame, word: str) -> None:
        rows = postings.withColumn("bucket", _bucket(F.col(word), self.buckets))
        # rebalanced: a task writes few folders, and one that a frequent word fills is split
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", word).write.partitionBy("bucket").parquet(f"{self.path}/postings")

    def _postings(self, word: str, words: list[str]) -> DataFrame:
        places = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(places) & F.col(word).isin(words))


class TextIndex(_Index):
    """BM25 over stored postings (id, len, term, tf) and one row of statistics."""

    def build(self, docs: DataFrame, id_col: str, text: Column) -> "TextIndex":
        tokens = docs.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")).alias("t"))
        each = tokens.select("id", F.explode_outer(term_counts(F.col("t"))).alias("p")).where("p is not null")
        self._write(each.select("id", "p.len", "p.term", "p.tf"), "term")
        tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).write.parquet(f"{self.path}/stats")
        return self

    def search(self, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of the documents with a term; only the terms' postings are read."""
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        found = self._postings("term", terms)
        df = F.broadcast(found.groupBy("term").agg(F.count("*").cast("double").alias("df")))
        idf = F.log(1.0 + (F.lit(float(stats["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(stats["mean"] or 1))))
        return found.join(df, "term").groupBy("id").agg(F.sum(part).alias("score"))


class TrigramIndex(_Index):
    """Which texts have which three characters in a row (upper-cased). What can't be indexed stays a candidate of every search."""

    def build(self, files: DataFrame, path: str, text: Column, most: int | None = None) -> "TrigramIndex":
        """Index the texts of up to `most` bytes; longer ones, and those that can't be read (null), are listed."""
        rows = files.select(F.col(path).alias("path"), text.alias("text"))
        readable = F.col("text").isNotNull() & (F.lit(True) if most is None else F.octet_length("text") <= most)
        self._write(trigram_index(rows.where(readable), "path", F.col("text")), "trigram")
        rows.select("path", readable.alias("indexed")).write.parquet(f"{self.path}/files")
        return self

    def candidates(self, query: str) -> DataFrame:
        """(path) of the texts with all trigrams of the query and of those that aren't indexed; all texts for a query of under three characters."""
        q = query.upper()
        grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        files = self.spark.read.parquet(f"{self.path}/files")
        if not grams:
            return files.select("path")
        found = self._postings("trigram", grams).groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("path")
        return found.unionByName(files.where(~F.col("indexed")).select("path"))


def symbols(files: DataFrame, path: str, text: Column) -> DataFrame:
    """(identifier, path, line, column, container): each identifier of each line; the container is what stands before its last point."""
    lines = files.select(path, F.posexplode(F.split(text, "\n")).alias("n", "row"))
    words = F.regexp_extract_all("row", F.lit(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"), F.lit(0))
    each = lines.select(path, (F.col("n") + 1).alias("line"), "row", F.explode_outer(F.array_distinct(words)).alias("whole")).where("whole is not null")
    return each.select(F.regexp_extract("whole", r"([^.]+)$", 1).alias("identifier"), path, "line", F.instr("row", F.col("whole")).alias("column"), F.regexp_extract("whole", r"^(.*)\.[^.]+$", 1).alias("container"))


def search_symbols(index: DataFrame, symbol: str, limit: int) -> DataFrame:
    """Occurrences of the symbol's last part, in containers that end in what stands before it; limit + 1 rows tell that there are more."""
    space, _, name = symbol.rpartition(".")
    hit = index.where(F.col("identifier") == name)
    if space:
        hit = hit.where((F.col("container") == space) | F.endswith("container", F.lit("." + space)))
    return hit.limit(limit + 1) if limit else hit


def first_group_rows(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, the first in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def trigram_index(files: DataFrame, path: str, text: Column) -> DataFrame:
    """(path, trigram): the distinct three-character windows of each upper-cased text."""
    chars = files.select(path, F.split(F.upper(text), "").alias("c"))
    grams = F.transform(F.slice("c", 1, F.greatest(F.size("c") - 2, F.lit(0))), lambda x, i: F.concat(x, F.get("c", i + 1), F.get("c", i + 2)))
    # explode_outer keeps the optimizer from testing the array below, where the split would run once a character
    return chars.select(path, F.explode_outer(F.array_distinct(grams)).alias("trigram")).where("trigram is not null")


def trigram_candidates(files: DataFrame, path: str, text: Column, query: str) -> DataFrame:
    """Paths whose text has every trigram of the query; all paths for a query of under three characters."""
    q, held = query.upper(), F.lit(True)
    for g in sorted({q[i : i + 3] for i in range(len(q) - 2)}):
        held = held & F.contains(F.col("_up"), F.lit(g))
    return files.select(path, F.upper(text).alias("_up")).where(held).select(path)


def search_lines(files: DataFrame, path: str, text: Column, query: str, limit: int, preview: int = 500) -> DataFrame:
    """(path, line, column, preview) of lines with the query, whatever its case, by path and line."""
    lines = files.where(F.contains(F.upper(text), F.lit(query.upper()))).select(path, F.posexplode(F.split(text, "\n")).alias("n", "row"))
    at = F.instr(F.upper("row"), F.lit(query.upper()))
    return lines.withColumn("column", at).where("column > 0").select(path, (F.col("n") + 1).alias("line"), "column", F.left("row", F.lit(preview)).alias("preview")).orderBy(path, "line").limit(limit)


def budget_prefix(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each group until the running cost first passes the budget; the first row always stays.

    Only rows of cost 1 or more can pass it, `budget` of them at most. So each group's row at that place, a top-k that
    Spark pushes before the shuffle, bounds what the running sum has to see; rows that cost nothing are never counted out.
    """
    g = rows.withColumns({"_g": F.struct(*group) if group else F.lit(0), "_c": cost, "_o": F.struct(*order)})
    last = first_group_rows(g.where("_c >= 1"), "_g", [F.col("_o")], budget + 1).groupBy("_g").agg(F.count("*").alias("_k"), F.max("_o").alias("_last"))
    last = last.where(F.col("_k") > budget).select(F.col("_g").alias("_h"), "_last")
    near = g.join(last, F.col("_g").eqNullSafe(F.col("_h")), "left").where(F.col("_last").isNull() | (F.col("_o") <= F.col("_last")))
    w = W.partitionBy("_g").orderBy("_o")
    kept = near.withColumn("used", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return kept.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n", "_g", "_h", "_c", "_o", "_last")
