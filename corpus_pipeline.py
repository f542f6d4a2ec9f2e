"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, PII redaction, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, language_id, mixing, ngram_join, pii
from weftgraph.llm.common import documents, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letter, or a confidence under its calibrated level) go; lang becomes the prediction."""
    model = language_id.fit_language_model(docs)
    kept = language_id.predict_languages(docs.withColumn("_body", F.col("text")), model, docs.columns, text_col="_body").where(~F.col("rejected"))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which tells rows apart by all their columns, so that a null or repeated id takes no other row out."""
    # a null passes a hash on unchanged, so where the nulls are is hashed too
    return docs.withColumn("_key", F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link, directly or by others, the one with the smallest id stays.

    Null ids come last, rows of one id in the order of their texts' hashes. Rows equal in all columns count once.
    """
    rows = keyed(docs)
    found = ngram_join.near_duplicates(rows, id_col="_key").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    order = rows.select(F.col("_key").alias("_row"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("text"), F.col("_key").alias("row")).alias("_place"))
    lead = order.join(found, "_row").groupBy("_group").agg(F.min("_place").alias("first")).select(F.col("first.row").alias("_key"))
    return rows.join(lead, "_key", "left_semi").select(docs.columns).dropDuplicates()


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, those without an id too; a row that shares its id with one stays."""
    rows = keyed(docs)
    leaks = decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(leaks, "_key", "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text become their kind in angle brackets, and n_chars follows."""
    return pii.redact_pii(docs, pii.fit_pii(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each kept document the mix takes."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("mixing", mix),
]

#: Language ID and the CRF are trained models, which SQL can't express; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
