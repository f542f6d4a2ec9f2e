"""Structured Streaming forms: windowed counts, the last event of a key, the text of a run.

Each runs over what a folder holds (available-now) with its checkpoint in the shared folder, so that a restart goes
on where it stopped. Results are in update mode: a batch's rows are written under the batch's number, again
after a failure, and the row of a key's last batch counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import scratch_dir


def folder_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder; the pattern is the name itself, so that no sibling is read."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an update-mode stream over all that is there; one row a key, that of the last batch that had it."""
    spark = stream.sparkSession
    where = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{where}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def run_appends(stream: DataFrame, name: str, where: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Run an append-mode stream over all that is there and give its rows; with the same `where` a later run goes on from the checkpoint.

    A batch's rows are written under its number, again after a failure, so that each counts once. conf holds for this
    stream alone.
    """
    spark = stream.sparkSession
    where = where or f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    finally:  # a stream takes its settings along when it starts
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows").select(*stream.columns)


def window_counts(events: DataFrame, time: str, kind: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Streaming: (start, kind, n) by tumbling window; rows later than `late` behind the newest are dropped by the watermark."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", length).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def last_of_key(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Streaming: the newest row of each key, whatever order rows arrive in."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def run_text(tokens: DataFrame, run: str, order: list[str], text: str) -> DataFrame:
    """Streaming: a run's tokens in their order as one text; the state of a key is that run's own tokens."""
    got = F.sort_array(F.collect_list(F.struct(*order, text)))
    return tokens.groupBy(run).agg(F.array_join(F.transform(got, lambda x: x[text]), "").alias("content"), F.count("*").alias("n"))


def activity_spans(events: DataFrame, key: str, time: str, kind: str, ends: tuple[str, ...]) -> DataFrame:
    """Streaming: (key, started, ended, n): the first event of each activity, its last terminal one (null while it runs), and how many it had."""
    at = F.col(time).cast("timestamp")
    return events.groupBy(key).agg(F.min(at).alias("started"), F.max(F.when(F.col(kind).isin(*ends), at)).alias("ended"), F.count("*").alias("n"))


def first_of_turn(messages: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Streaming: each turn once, whatever comes again: the least of its columns, and how often it came."""
    return messages.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("r"), F.count("*").alias("n")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns], "n")


def job_states(events: DataFrame, key: str, order: str, kind: str, failed: str, retries: int = 2) -> DataFrame:
    """Streaming: (key, last, fails, given_up): the last step of each job, its failures, and whether they are more than its retries."""
    fails = F.count_if(F.col(kind) == failed)
    return events.groupBy(key).agg(F.max_by(kind, order).alias("last"), fails.alias("fails"), (fails > retries).alias("given_up"))
