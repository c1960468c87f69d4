"""The corpus pipeline: stages over documents, each on all that the one before it kept.

Toxic documents go; of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays;
personal data is replaced by its kind; sources are mixed towards equal weights, every document at least once; texts
are encoded. Each stage's result is written to the shared folder and read again, so a lost executor costs the running
stage at most. Null and empty texts pass all stages and have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import bpe, jaccard, mixing, pii, toxicity
from slotwise.llm.common import stored, table
from slotwise.llm.queries import RANK_FILE

NEAR = jaccard.Rule(words=5, num=80, den=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each row."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return bpe.round_trip(spark, docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: The stages train models and hash; SQL cannot express them, so they are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
