"""A corpus pipeline of five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), its result is written as Parquet, and the next one reads it back. All but
the last return the columns of documents. SQL can't express the stages (learned models, fingerprint components,
windows against a benchmark, a tokenizer), so ORACLE_SQL is None and tests/llm/test_pipeline.py holds each stage
against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import decontaminate, mixing, simhash, token_blocks, toxicity
from noticeworks.llm.common import materialize, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the toxicity models score 0.3 or more; empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(F.col("text"), model) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least id; see simhash.keep_first."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return docs.filter(~decontaminate.is_contaminated(F.col("text"), table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources at weights 3, 1, 2 to 150 % of all words; a document appears once for each time it's taken."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns doc_id, start, n_tokens and ids_crc32 as read from them."""
    return token_blocks.token_output(docs, TOKENIZER, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_to_target_weights", mix_sources),
    ("token_id_blocks", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
