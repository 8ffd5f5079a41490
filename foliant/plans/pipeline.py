"""The document plan: page text through cleaning and correction to one record a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import structure, text
from foliant.operators import lines


def text_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, raw_text, clean_text, corrected: frequent lines, noise, spacing, tables, then characters. One shuffle, by id."""
    unique = lines.dedup_lines(docs.select(id_col, F.col(text_col).alias("t")), id_col, "t", raw_col="raw_text")
    normal = unique.withColumn("t", text.normalize_lines(F.col("t")))
    quiet = normal.withColumn("t", text.filter_noise_lines(F.col("t")))
    clean = lines.tables_as_text(quiet.withColumn("t", text.clean_text(F.col("t"))), id_col, "t", ["raw_text"])
    return clean.select(id_col, "raw_text", F.col("t").alias("clean_text"), text.char_correct(F.col("t")).alias("corrected"))


def run(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", semantics: str = "reference", processed_at: str | None = None) -> DataFrame:
    """One record a document; ids are taken to be unique.

    semantics: "reference" extracts from the corrected text, in which zeros and line ends are gone; "intended"
    extracts and segments the clean text.
    """
    out = text_chain(docs, id_col, text_col)
    source = F.col("corrected" if semantics == "reference" else "clean_text")
    meta = F.struct(
        F.lit(processed_at).cast("string").alias("processed_at"),
        F.lit(1).alias("pages"),
        "raw_text",
        "clean_text",
        structure.announcements(F.col("raw_text")).alias("segments_raw"),
        structure.announcements(F.col("clean_text")).alias("segments_clean"),
        structure.announcements(source).alias("segments_corrected"),
        F.lit(None).cast("string").alias("embeddings_error"),
        F.lit(None).cast("string").alias("storage_error"),
    )
    return out.select(
        id_col,
        structure.extract_ref(source).alias("ref"),
        structure.extract_date(source).alias("date"),
        structure.detect_language(source).alias("language"),
        F.col("corrected").alias("announcement"),
        F.concat(F.col(id_col).cast("string"), F.lit(".pdf")).alias("source_pdf"),
        F.lit(None).cast("array<float>").alias("embedding"),
        meta.alias("metadata"),
        F.lit("v1").alias("schema_version"),
    )


def flagship(docs: DataFrame) -> DataFrame:
    """doc_id, ref, date, language, clean_text, corrected of every document, extraction from the clean text."""
    chain = text_chain(docs)
    clean = F.col("clean_text")
    return chain.select("doc_id", structure.extract_ref(clean).alias("ref"), structure.extract_date(clean).alias("date"), structure.detect_language(clean).alias("language"), "clean_text", "corrected")
