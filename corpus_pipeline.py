"""From raw documents to a mixed corpus in tokens.

Five stages, each a whole pass over what the one before kept: documents without a language go, exact
copies go, near copies go, sources are mixed to their target weights (documents repeat or go), and
the rest is encoded. All stages but the last return the columns of their input, also those that have
names which a stage uses itself. Null and empty texts go in the first stage; a null id is no reason to
go. An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import bpe, exact, langid, minhash, mixing
from turnloom.llm.common import cut, named, unused, with_rows

def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with row numbers, and the name of their column."""
    row = unused(docs, "_row")
    return with_rows(docs, row), row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: null, empty, or without a letter."""
    return langid.keep_known(docs, langid.fit(docs, ~langid.held_out()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the document with the largest id; of repeated rows, one."""
    rows, row = _numbered(docs)
    kept = exact.exact_dedup(rows, row_col=row).filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row).select(*map(named, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keeps the document with the smallest id."""
    rows, row = _numbered(docs)
    kept = minhash.near_dedup(rows, row_col=row).filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row).select(*map(named, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets; copies are rows."""
    rows, row = _numbered(docs)
    copies = mixing.mix_sources(rows, row_col=row).filter("copies > 0").select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(unused(rows, "_copy")))
    return rows.join(copies, row).select(*map(named, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded bytes."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

#: SQL has no byte-pair merges; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
