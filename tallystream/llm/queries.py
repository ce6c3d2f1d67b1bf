"""Registered queries of the corpus operators, opN_<name>, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_media, chat_format, decontaminate, html_extract, lm_scoring, mixing, oracle, resample, secret_scan, simhash, spelling, suffix_dedup, token_ids, toxicity


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm_scoring.score(_read(spark, d, "documents").select("doc_id", "text"))


def op2_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = html_extract.extract(_read(spark, d, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.probe(spark))
    return chat_format.digest(chat_format.format_chats(turns))


def op4_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(_read(spark, d, "documents").select("doc_id", "text")))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_read(spark, d, "documents"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _read(spark, d, "labels")))
    return scored.select("doc_id", (toxicity.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.ENOUGH).cast("int").alias("predicted"))


def op7_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, d, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spelled(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.spelled(F.col("secret_spans")).alias("spans"),
    )


def op8_media_columns(spark: SparkSession, d: str) -> DataFrame:
    return audio_media.describe(audio_media.store(_read(spark, d, "documents").select("doc_id", "text")))


def op9_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.components(_read(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "benchmark"))


def op11_token_ids(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return token_ids.stored(_read(spark, d, "documents").select("doc_id", "text"), tokenizer)


def op12_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    drawn = resample.draw(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(spelling.words(_read(spark, d, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_html_extraction": op2_html_extraction,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_mixing": op5_mixing,
        "op6_toxicity": op6_toxicity,
        "op7_secret_scans": op7_secret_scans,
        "op8_media_columns": op8_media_columns,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_token_ids": op11_token_ids,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
