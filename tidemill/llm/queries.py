"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import ann, decontamination, langid, lmscore, neardup, packing, sharding, tokens, toxicity, warc
from tidemill.llm._common import read


def word_bpe() -> str:
    """The path of the public vocabulary that the packing and token-file queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=40)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"), threshold=0.8)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), word_bpe(), capacity=2048, end=0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file_digests(read(spark, sf_dir, "documents"), word_bpe(), end=2, length=2048)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_neardup": op3_neardup,
    "op4_ann": op4_ann,
    "op5_lmscore": op5_lmscore,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {"op10_warc": warc.ORACLE_SQL}
