"""A cleaning pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeloom.llm import contamination, jaccard_join, mixing, repair_tokens, toxicity
from timeloom.llm._store import Scratch, table
from timeloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low expected severity (operator 8); the model is fitted on the labelled documents among ``docs``."""
    model = toxicity.fit_toxicity(docs, toxicity.graded(table(spark, sf_dir, "labels")))
    return toxicity.not_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id (operator 5).

    Of repeated rows of that id one stays. Rows without an id all stay, as nothing tells them apart.
    """
    return jaccard_join.without_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 3)."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, to the nearest whole number (operator 7)."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in compressed shards, and what is read back from them (operator 1).

    Blocks of 3 MB of text take some 100 MB less of a worker than those of 8 MB, beside what earlier stages have left behind.
    """
    return repair_tokens.token_digests(docs, vocabulary(), block_bytes=3 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("tokens", tokens),
]

#: The toxicity model and the token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        done, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(done)
    return docs
