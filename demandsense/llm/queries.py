"""Registered queries of the package: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from demandsense.llm import (best_positions, binpack, bpe, chat, decontaminate, fixity, piece_table, pii, quality_rules, secret_scan, simhash, url_filter,
                             word_table)

RANK_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op3_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(rows.unionByName(chat.trial_conversation(spark)))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.farm_urls(pages))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.fixity_report(_table(spark, sf_dir, "pages"))


def op10_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.shard_report(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.fim_report(_table(spark, sf_dir, "documents"))


def op12_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.code_report(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE))


def op13_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_positions.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_byte_bpe, op3_simhash_vp_tree, op4_decontamination, op5_quality_rules, op6_chat_format, op7_personal_data, op8_url_filter,
    op9_warc_fixity, op10_vector_bin_packing, op11_fill_in_middle, op12_word_table_bpe, op13_best_positions)}
