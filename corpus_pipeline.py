"""The corpus pipeline: documents that pass the rules, without toxic texts and near copies, mixed and encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; run()
writes each stage's result as Parquet in the shared folder and reads it back for the next one, so a lost executor
costs the tasks of one stage at most. What a stage wrote on its way is deleted once its result stands, and a stage's
result once the next one stands.

Defined results, stage by stage. Null and empty texts have no words and go with the quality rules. Repeated rows are
judged alike, and near_dedup keeps one of them. Ties: near_dedup keeps the smallest doc_id of a group (null ids last),
and of equal ids the text with the smallest hash; mixing takes rows of one source, id and text together. Null sources
are a source. Extra columns pass through all stages but the last, whatever their names. Empty tables give an empty
result with the stage's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import mixing, pieces, quality, simhash, toxicity
from vecloom.llm.base import delete, materialize, read, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return quality.keep_clean(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; learns from the labels of documents that are still there."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows go, or come twice."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text."""
    return pieces.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Tokenisers, nearest examples and fingerprints are not SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            after = paths.pop()  # the stage's own result stays until the next one stands
        if before:
            delete(spark, before)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
