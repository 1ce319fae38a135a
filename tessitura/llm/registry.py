"""Queries of this subpackage, one thin query for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import benchmark, codes, collocations, fingerprints, language, licenses, personal, pieces, quality, secrets, substrings, suffixes, vectors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _count(spans: str, wanted, name: str):
    """How many spans are wanted. (A function of one argument only: Spark takes a second one for the index.)"""
    return F.size(F.filter(spans, lambda s: wanted(s))).cast("long").alias(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.detect(_read(spark, sf_dir, "documents"))
    count = [_count("found", lambda s, at=at: s["base"] & (s["kind"] == at), f"n_{k}") for at, k in enumerate(personal.BASE)]
    return found.select("doc_id", *count, F.sha2(personal.span_text(F.col("found"), True), 256).alias("base_sha256"), personal.span_text(F.col("found"), False).alias("spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(_read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_read(spark, sf_dir, "documents"))
    count = [_count("spans", lambda s, at=at: s["kind"] == at, f"n_{r.kind}") for at, r in enumerate(secrets.BASE)]
    return rows.select("doc_id", *count, F.sha2(secrets.span_text(F.col("spans"), secrets.RULES, True), 256).alias("base_sha256"), secrets.span_text(F.col("spans"), secrets.RULES).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"), model_path())


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (op1_personal_data, op2_suffix_dedup, op3_secrets, op4_simhash, op5_licenses, op6_decontamination, op7_embeddings, op8_substrings, op9_language, op10_pieces, op11_quality, op12_collocations, op13_vector_codes, pipeline)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from tessitura.llm.oracle import SQL

    return dict(SQL)
