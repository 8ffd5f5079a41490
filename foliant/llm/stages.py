"""Operators as steps from documents to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, language, line_dedup, pii
from foliant.llm.common import materialize, sparse_join, text_or_empty


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def known_language(docs: DataFrame) -> DataFrame:
    """docs without those that language identification rejects: no letters, or no language above a half.

    The text, its declared language and its source are the evidence. Equal rows share their fate.
    """
    key = F.xxhash64("doc_id", "text", "lang", "source").alias("key")
    profiles = language.fit_profiles(docs)
    rows = language.evidence(docs, profiles, text_or_empty(), F.col("lang"), F.lit(None).cast("string"), F.col("source"), [key])
    rejected = materialize(language.fuse(rows, profiles.langs).where("not accepted").select("key").distinct().withColumn("gone", F.lit(True)))
    kept = sparse_join(docs.select(F.struct("*").alias("doc"), key), rejected, "key").where("gone is null")
    return kept.select("doc.*")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated passages of lines cut; a text may become empty, its row stays."""
    return _counted(line_dedup.passage_dedup(docs).drop("n_lines_removed"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of documents that similarity links, the one with the smallest doc_id; of its rows with this doc_id, one.

    Rows that share a doc_id but no group each stay. Rows without doc_id, and those without words, are in no group and
    stay.
    """
    found = materialize(jaccard_join.similarity_components(docs).where("group_key is not null"))
    leads = found.where("doc_id = component_id").groupBy("group_key").agg(F.min("row_key").alias("lead"), F.count(F.lit(1)).alias("rows"))
    again = materialize(leads.where("rows > 1"))  # several rows with the smallest doc_id of their group
    gone = found.where("doc_id != component_id").select("row_key")
    repeated = not again.isEmpty()
    if repeated:
        gone = gone.unionByName(found.where("doc_id = component_id").join(again, "group_key").where("row_key != lead").select("row_key"))
    gone = materialize(gone.distinct().withColumn("gone", F.lit(True)))
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"))
    kept = sparse_join(keyed, gone, "row_key").where("gone is null").drop("gone")
    if repeated:
        lead = materialize(again.select(F.col("lead").alias("row_key"), F.lit(True).alias("leads")).distinct())
        told = sparse_join(kept, lead, "row_key")
        kept = told.where("leads is null").unionByName(told.where("leads").dropDuplicates(["row_key"]))
    return kept.select("doc.*")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with accepted personal data replaced by its kind."""
    return _counted(pii.redact(docs))
