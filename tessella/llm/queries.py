"""The registered queries of this subpackage, over the whole tables, and SQL for those that have some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_reuse, jaccard_join, language_id, license_scan, lm_score, nearest, packing, pii, quality_rules, token_file
from .common import Scratch, prepare


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _docs(spark, sf_dir), Scratch(spark)
    rows = lm_score.encode_documents(docs, scratch)
    return lm_score.score_documents(docs, lm_score.fit(docs, scratch, rows=rows), scratch, rows=rows)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_docs(spark, sf_dir)))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = Scratch(spark).path("token-file")
    token_file.write(_docs(spark, sf_dir), path)
    return token_file.read(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_rules.assess(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(_docs(spark, sf_dir)))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_docs(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.predict(docs, language_id.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.code_documents(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_license_scan, op3_nearest, op4_token_file, op5_packing, op6_quality_rules, op7_pii, op8_jaccard_join, op9_language_id, op10_bpe_reuse, pipeline)}
ORACLES: dict[str, str] = {}
