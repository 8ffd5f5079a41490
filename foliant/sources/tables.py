"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """ref string, date string, language string, announcement string, source_pdf string, embedding array<float>,
metadata struct<processed_at: string, pages: int, raw_text: string, clean_text: string, segments_raw: array<string>,
segments_clean: array<string>, segments_corrected: array<string>, embeddings_error: string, storage_error: string>, schema_version string"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def only_pdf(files: DataFrame) -> DataFrame:
    """Files that start as PDF does and hold more than a header."""
    return files.where((F.substring("content", 1, 4) == F.lit(b"%PDF")) & (F.length("content") > 32))


def read_records(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Record files of both generations, absent fields null: one pretty object a file, or one object a line."""
    return spark.read.schema(RECORD).option("multiLine", one_per_file).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object a record, nulls kept."""
    shown = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    records.select(shown.alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Append to a relational table; the driver class and credentials come with properties."""
    df.write.jdbc(url, name, mode="append", properties=properties)
