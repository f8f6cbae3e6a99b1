"""The corpus pipeline: documents to token shards in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, language_id, mixing, token_codes
from quarry.llm.common import ship, staged
from quarry.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; their source is the host."""
    ship(spark)
    return language_id.accepted_documents(docs, declared=F.col("lang"), host=F.col("source"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    ship(spark)
    return jaccard.one_of_each_group(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their sources' weights, some twice, some not."""
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written to shards; a row per document read back."""
    ship(spark)
    return token_codes.tokens_round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("jaccard_join", distinct_texts),
    ("decontamination", uncontaminated),
    ("mixing", mixed_sources),
    ("token_codes", token_shards),
]

# No stage but decontamination can be put in SQL; the test compares run() with its own stages called one by one, no plain Python version of the kept documents.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
