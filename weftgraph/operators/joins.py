"""Lookups that attach facts to nodes: first match, synthesised targets, candidate lists, exact bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_lookup(rows: DataFrame, key: Column, table: DataFrame, table_key: Column, order: Column, value: Column, name: str) -> DataFrame:
    """rows with `name`: the value of the first row of table (by order) whose key is the same, whatever the case; null if none."""
    one = table.groupBy(F.lower(table_key).alias("_key")).agg(F.min_by(value, order).alias(name))
    return rows.withColumn("_at", F.lower(key)).join(one, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")


def resolve_or_create(wanted: DataFrame, known: DataFrame, key: str, status: str) -> DataFrame:
    """(key, status): known keys as they are, and a row with the given status for each wanted key that isn't known."""
    new = wanted.where(F.col(key).isNotNull()).select(key).distinct().join(known, key, "left_anti")
    return known.select(key, F.lit("KNOWN").alias("status")).unionByName(new.withColumn("status", F.lit(status)))


def first_existing(rows: DataFrame, id_col: str, candidates: Column, files: DataFrame, path: str) -> DataFrame:
    """(id, found): of each row's ordered candidate paths the first that exists; rows without one stay with null."""
    each = rows.select(id_col, F.posexplode(candidates).alias("_n", path))
    hit = each.join(files.select(path).distinct(), path, "left_semi").groupBy(id_col).agg(F.min_by(path, "_n").alias("found"))
    return rows.select(id_col).join(hit, id_col, "left")


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_kind, src_name, dst_kind and dst_name; edges with an end that isn't a node go."""
    end = lambda e: nodes.select(F.col("id").alias(e), F.col("kind").alias(f"{e}_kind"), F.col("name").alias(f"{e}_name"))
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def _grams_of(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))


def containing(texts: DataFrame, id_col: str, text_col: str, words: DataFrame, word_id: str, word_col: str) -> DataFrame:
    """(id, word id): the texts that hold each word, whatever the case; null and empty words are in none.

    A text that holds a word has the word's first three characters (all of a shorter one) in a row, so both meet by an
    equi-join on these and only such pairs are compared. Each different text is compared once. Neither join may be a
    broadcast: Spark takes the exploded side for as small as the column that it comes from.
    """
    w = words.select(F.col(word_id), F.lower(word_col).alias("_w")).where("_w <> ''").withColumn("_g", F.left("_w", F.lit(3)))
    low = texts.select(F.col(id_col), F.lower(text_col).alias("_t")).where("_t <> ''")
    grams = F.array_distinct(F.concat(*[F.when(F.length("_t") >= n, _grams_of(F.col("_t"), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    each = low.select("_t").distinct().select("_t", F.explode(grams).alias("_g"))
    pairs = each.hint("merge").join(w, "_g").where(F.contains("_t", F.col("_w"))).select("_t", word_id)
    return low.hint("merge").join(pairs, "_t").select(id_col, word_id)
