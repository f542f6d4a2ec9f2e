"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

* Targets: sources in code-point order (null last) weigh WEIGHTS, repeating. They share `share` of all words; a
  target stops at MOST times its source's size and the excess is shared again by weight until none is above:
  the water level, found with running sums over sources ordered by size / weight.
* Schedule: slot i maps to the point frac(i * golden ratio), kept in integers of 31 bits, and through the
  cumulative targets to a source. Slots rank within their source in schedule order.
* Blocks: a source's documents are shuffled by hash and laid end to end on a line of words, cut into blocks of
  `block` words (a thousand blocks a source, but LEAST_BLOCK to MOST_BLOCK words each). The r-th slot of a source takes its block r modulo their number, MOST rounds at most; a block
  gives each of its words once a time, so a document is taken at most MOST times its size.

Ranks and positions are two-level sums (chunk totals, then within a chunk), so a source with a third of all rows
is never one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEAST_BLOCK, MOST_BLOCK = 16, 512
GOLDEN = 1327217885  # the golden ratio's fraction in 31 bits
RING = 1 << 31
SLOT_CHUNK = 1 << 14
ROWS_IN_CHUNK = 2000
GRID = 1024


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, weight, target) from rows (source, size): one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # in this order, a source is capped as long as all before it are and its share of what is left is above its cap
    rows = rows.withColumn("left", left).withColumn("weights", weights)
    rows = rows.withColumn("free", F.col("left") * F.col("weight") / F.col("weights") <= F.col("cap"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "left", "weights"))).over(every)
    rows = rows.withColumn("first", first)
    above = F.col("first").isNotNull() & (F.struct(F.col("cap") / F.col("weight"), F.col("rank")) >= F.struct(F.col("first")["col1"], F.col("first")["rank"]))
    level = F.col("first")["left"] * F.col("weight") / F.col("first")["weights"]
    return rows.select("source", "rank", "source_size", "weight", F.when(above, level).otherwise(F.col("cap")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    A null text has size 0; a null source is a source of its own, last in order. Rows with equal ids order by
    their size, so repeated rows each get a share. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Reruns agree: every order is by hash and id.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"))
    sizes = materialize(sizes, "sizes")
    targets = materialize(source_targets(sizes), "targets")
    n_rows = sizes.count()
    total, n_words, n_sources = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block = block or int(min(MOST_BLOCK, max(LEAST_BLOCK, n_words // (1000 * max(1, n_sources)))))

    # where each document lies on its source's line of words
    chunks = max(1, n_rows // ROWS_IN_CHUNK)
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = sizes.withColumn("shuffled", key).withColumn("chunk", F.shiftright("shuffled", 30) % chunks)
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    ends = rows.groupBy("name", "chunk").agg(F.sum("size").alias("words"))
    ends = ends.withColumn("base", F.sum("words").over(W.partitionBy("name").orderBy("chunk")) - F.col("words")).drop("words")
    within = W.partitionBy("name", "chunk").orderBy("shuffled", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(ends, ["name", "chunk"])
    line = rows.select("doc_id", "name", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("at"))

    # the schedule: slots to sources through the cumulative targets
    named = targets.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    upto = F.sum("target").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    named = named.withColumn("high", upto).withColumn("low", F.col("high") - F.col("target"))
    named = materialize(named.withColumn("blocks", F.ceil(F.col("source_size") / block)), "bounds")
    slots = int(round(total / block)) if total else 0
    if total and not slots:
        slots = 1
    point = F.pmod(F.pmod(F.col("id"), F.lit(RING)) * GOLDEN, F.lit(RING)) / float(RING) * total
    cell = F.lit(GRID / total if total else 0.0)
    tall = named.where("target > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cell), F.floor(F.col("high") * cell)))).select("name", "low", "high", "cell", "blocks")
    plan = spark.range(slots).select("id", point.alias("point")).withColumn("cell", F.floor(F.col("point") * cell))
    plan = plan.join(tall, "cell").where("point >= low and point < high").select("id", "name", "blocks").withColumn("part", F.floor(F.col("id") / SLOT_CHUNK))
    parts = plan.groupBy("name", "part").count()
    parts = parts.withColumn("first", F.sum("count").over(W.partitionBy("name").orderBy("part")) - F.col("count")).drop("count")
    plan = plan.withColumn("r", F.row_number().over(W.partitionBy("name", "part").orderBy("id")) - 1).join(parts, ["name", "part"])
    taken = plan.withColumn("r", F.col("first") + F.col("r")).where(F.col("r") < F.col("blocks") * MOST)
    times = taken.groupBy("name", (F.col("r") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))

    # each document's share of the blocks that it lies in
    spans = line.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    overlap: Column = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    got = spans.join(times, ["name", "block"]).groupBy("name", "at").agg(F.sum(overlap * F.col("times")).alias("taken"))
    got = got.select(F.col("name").alias("gn"), F.col("at").alias("ga"), "taken")
    out = line.join(got, (F.col("name") == F.col("gn")) & (F.col("at") == F.col("ga")) & (F.col("size") > 0), "left")
    out = out.join(named.select(F.col("name").alias("tn"), "source_size", "target"), F.col("name") == F.col("tn"))
    return out.select("doc_id", "size", "source_size", F.col("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
