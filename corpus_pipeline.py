"""The corpus pipeline: five stages, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import benchmark, fingerprints, language, numbering, personal, pieces, registry
from tessitura.llm.scratch import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects (no letter, or unlike every learned language)."""
    return language.keep_known(docs, language.fit(docs.where(~language.held_out())))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_no`` of each document, one row for each; of rows equal in key and text one is kept."""
    rows, _, unique = numbering.with_numbers(docs, "doc_id", "text")
    return rows if unique else rows.dropDuplicates(["_no"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the first by doc_id, of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    rows = _numbered(docs)
    groups = fingerprints.similar_numbers(rows, "_no", "text")
    kept = groups.where(F.col("_no") == F.col("component_id")).select("_no")
    return rows.join(kept, "_no", "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item, each judged by itself whatever its doc_id."""
    rows = numbering.with_numbers(docs, "doc_id", "text")[0]
    found = benchmark.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_no")
    leaks = written(found.where("contaminated").select("_no").distinct(), "leaks")
    return rows.join(leaks, "_no", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the names of its kinds; no document goes."""
    masked = personal.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return pieces.digests(docs, registry.model_path())


STAGES = [
    ("language identification", identify_language),
    ("simhash near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the mixture model, XXH64 or the tokenizer; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
