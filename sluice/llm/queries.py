"""The registered queries of this folder: thin forms over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bytebpe, decontaminate, dialogue, kneser, langid, quality, shards, simhash, suffixdedup, syncmers, tokencount, variants, vectors
from sluice.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the word-end vocabulary."""
    return tokencount.counted(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text."""
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


ORACLES["op3_decontamination"] = decontaminate.SQL


@query
def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 200-byte string which starts more than once."""
    return suffixdedup.measured(documents(spark, sf_dir))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return langid.identified(documents(spark, sf_dir))


@query
def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next document's are."""
    return syncmers.fingerprinted(documents(spark, sf_dir))


@query
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text, each word after the two before it."""
    return kneser.scored(documents(spark, sf_dir), kneser.QUERY_ORDER)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the bytes they decode to."""
    return bytebpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = shards.sharded(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the digest of what the repair leaves."""
    return dialogue.examined(dialogue.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all texts, with the spelling each is a variant of."""
    return variants.variants(documents(spark, sf_dir))


@query
def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
