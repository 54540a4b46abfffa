"""The queries of this subpackage for the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import alignment, bpe, cuckoo, grammar, language, lines, minhash, mixing, quality, sharding, simhash, spelling, substrings
from pagelode.llm.common import documents
from pagelode.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary() -> str:
    return tokenizer("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))[0]


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(documents(spark, sf_dir), vocabulary())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.cascade(documents(spark, sf_dir).select("doc_id", "text"), rejected=quality.base_failed())
    rows = rows.withColumn("base_failed", quality.base_failed())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sharding.tree(8)
    rows = sharding.place(documents(spark, sf_dir), root, sharding.grown(root, 8))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(~language.held_out()))
    out = language.identify(docs, model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.against_next(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.dedup(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their classes of equal fingerprints, and links of classes within 3 bits, by operator 10's block tables."""
    return simhash.classes(simhash.fingerprints(documents(spark, sf_dir)), 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash, op2_substring_dedup, op3_token_binary, op4_line_dedup, op5_quality_rules,
        op6_sharding, op7_bpe, op8_mixing, op9_language_id, op10_simhash, op11_spelling_variants, op12_exact_dedup, op13_alignment, near_fingerprints,
    )
}

