"""One query for each operator, over its whole table and with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from currikit.llm.common import spread_table, table
from currikit.llm import line_dedup, quality_rules, topk_search
from currikit.llm.byte_bpe import encode_digests
from currikit.llm.license_scan import license_scan
from currikit.llm.packing import best_fit_packing, token_lengths
from currikit.llm.secret_scan import scan_secrets
from currikit.llm.simhash import near_duplicates
from currikit.llm.token_counts import token_counts
from currikit.llm.token_store import token_store


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(spread_table(spark, sf_dir, "documents")).drop("clean_text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and offsets are in tokens of the vocabulary that op3 encodes with."""
    lengths = token_lengths(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return best_fit_packing(lengths, F.col("length"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(spread_table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are taken as repositories and languages as their directories."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(spread_table(spark, sf_dir, "documents"), path)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are taken as owners, and each one's languages as repositories."""
    return scan_secrets(spread_table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_topk_search": op8_topk_search,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_store": op10_token_store,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op4_line_dedup": line_dedup.oracle(),
    "op8_topk_search": topk_search.ORACLE,
}
