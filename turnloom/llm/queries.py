"""The queries opN_<name> over the driver's tables, each the thin use of one operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import bpe, chat, ctw, exact, html, langid, lexical, merkle, minhash, mixing, rlz, suffix, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the 50k byte-level vocabulary and back."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    own = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(chat.events_of_turns(turns.unionByName(extra))))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_dedup(_table(spark, sf_dir, "documents")).drop("row")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents")).drop("row")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 50 words that repeat across documents."""
    return rlz.substring_dedup(_table(spark, sf_dir, "documents")).drop("n_factors")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that repeat across documents."""
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150% of their words, weights 3, 1, 2."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each fifth one tampered with."""
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=merkle.every_fifth())


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from nine tenths of them."""
    return ctw.lm_scores(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_chat_format": op2_chat_format,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_html_text": op5_html_text,
    "op6_language_id": op6_language_id,
    "op7_rlz_substring_dedup": op7_rlz_substring_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lm_scores": op12_lm_scores,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op3_minhash_near_dedup": minhash.SQL,
    "op4_exact_dedup": exact.SQL,
    "op7_rlz_substring_dedup": rlz.SQL,
    "op8_suffix_dedup": suffix.SQL,
    "op9_mix_sources": mixing.SQL,
    "op10_exact_top_k": topk.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_ranked_search": lexical.SQL,
}
