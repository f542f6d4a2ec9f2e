"""Merge and upsert operators with an explicit order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def last_non_null(df: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """One row a key: each column's last value that is not null."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def merge_edges(df: DataFrame, seq: str, first_wins: list[str], location: str | None = None, most: int = 20) -> DataFrame:
    """One row an edge (type, src, dst): occurrence count, first value of each column, distinct locations by arrival."""
    out = [F.count("*").alias("occurrence_count"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first_wins]]
    if location:
        # each distinct location at its first arrival: bounded before it is collected
        by = W.partitionBy("type", "src", "dst").orderBy("_at")
        firsts = df.where(F.col(location).isNotNull()).groupBy("type", "src", "dst", location).agg(F.min(seq).alias("_at")).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most)
        places = firsts.groupBy("type", "src", "dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", location))), lambda x: x[location]).alias("locations"))
        return df.groupBy("type", "src", "dst").agg(*out).join(places, ["type", "src", "dst"], "left")
    return df.groupBy("type", "src", "dst").agg(*out)


def last_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """Rows of both; on a conflict `keep` columns stay as they were and `replace` columns are taken from the new row."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in keep + replace])
    n = new.select(F.col(key).alias("_m"), *[F.col(c).alias(f"_n_{c}") for c in keep + replace])
    both = o.join(n, F.col("_k") == F.col("_m"), "full")
    had = F.col("_k").isNotNull()
    has = F.col("_m").isNotNull()
    return both.select(F.coalesce("_k", "_m").alias(key), *[F.when(had, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in keep], *[F.when(has, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in replace])


def round_robin(df: DataFrame, group: str, within: list[Column], groups_by: list[Column]) -> DataFrame:
    """Adds turn, the rank within the group; in order of turn: every group's first, then every second, and so on."""
    ranked = df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*within)))
    return ranked.orderBy("turn", *groups_by)


def snapshot_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change): added, removed or changed between two snapshots."""
    o, n = old.select(path, F.col(digest).alias("_o")), new.select(path, F.col(digest).alias("_n"))
    both = o.join(n, path, "full")
    return both.where(~F.col("_o").eqNullSafe(F.col("_n"))).select(path, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed").alias("change"))
