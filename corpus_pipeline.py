"""From raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import packing, queries, stages
from foliant.llm.common import drop, materialize, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_repeated_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_personal_data(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the fitted classifiers nor the similarity groups; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables go when it has been written, its input with the next one's."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            made = keep(materialize(stage(spark, docs, sf_dir)))
        if before is not None:
            for path in before.inputFiles()[:1]:
                drop(spark, path.rpartition("/")[0])
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
