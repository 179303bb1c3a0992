"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, byte_codec, embed_dedup, line_dedup, media, minhash_dedup, packing, resample, secret_scan, suffix_dedup, token_count, toxicity, vector_codes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_query(_docs(spark, sf_dir))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digest(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_query(_docs(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_query(_docs(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_query(_docs(spark, sf_dir))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_docs(spark, sf_dir))


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.codec_digest(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_embed_dedup": op2_embed_dedup,
        "op3_token_count": op3_token_count,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_bpe_codec": op6_bpe_codec,
        "op7_line_dedup": op7_line_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_byte_codec": op11_byte_codec,
        "op12_vector_codes": op12_vector_codes,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embed_dedup": embed_dedup.oracle(),
        "op7_line_dedup": line_dedup.oracle(),
        "op8_secret_scan": secret_scan.oracle(),
        "op9_suffix_dedup": suffix_dedup.oracle(),
        "op10_minhash_dedup": minhash_dedup.oracle(),
        "op12_vector_codes": vector_codes.oracle(),
        "op13_resample": resample.oracle(),
    }
