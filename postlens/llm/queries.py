"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import archive, ball_codes, exact_dedup, filter_audit, fuzzy_lines, lm, mixing, near_dedup, packing, quality, sql, sql_more, substrings, token_counts, url_blocks
from postlens.llm.common import table


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.selectExpr("doc_id", "source_key", "n_tokens", "round(weight, 6) as weight", "budget", "order_key", "copies")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=3, similarity=85)


def op6_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.sound(archive.archived(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_line_report(table(spark, sf_dir, "documents"), max_bits=None)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.ball_codes(table(spark, sf_dir, "embeddings"))


def op13_redirect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_blocks.url_verdicts(table(spark, sf_dir, "pages"), url_blocks.rule_table(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_elias_fano_lm, op2_line_frequency, op3_exact_dedup, op4_temperature_mixing, op5_minhash, op6_content_archive,
        op7_fm_index, op8_token_counts, op9_lexical_packing, op10_fuzzy_lines, op11_filter_audit, op12_ball_codes, op13_redirect_blocks,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_frequency": sql.QUALITY,
        "op3_exact_dedup": sql.EXACT_DEDUP,
        "op4_temperature_mixing": sql.MIXING,
        "op5_minhash": sql.NEAR_DEDUP,
        "op6_content_archive": sql.ARCHIVE,
        "op7_fm_index": sql.SUBSTRINGS,
        "op11_filter_audit": sql_more.FILTER_AUDIT,
        "op12_ball_codes": sql_more.BALL_CODES,
        "op13_redirect_blocks": sql_more.URL_BLOCKS,
    }
