"""Exact document deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, materialize, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 512) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Of a group the row with the most code points
    stays, then the smallest doc_id (null last), then the row read first; so of repeated rows one is kept.
    Null texts count as empty. Digests are 256 bits of the normalised text.

    Misra-Gries counters (``freqItems``) name at most 1/support digests that may be frequent; their exact
    counts and winners, at most 1/support rows, are broadcast and decide those rows where they lie. All other
    digests hold fewer than support of the rows each and take the ordinary shuffle.
    """
    text = text_or_empty(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(text).alias("n_points"),
            F.sha2(F.encode(F.regexp_replace(text, f"{SPACE}+", ""), "UTF-8"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("seq"),
        )
    )
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq"))
    stats = [F.count(F.lit(1)).alias("group_size"), best.alias("best")]
    frequent = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    hot = materialize(rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(*stats).coalesce(1))
    cold = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    joined = rows.join(F.broadcast(hot), "text_sha256").unionByName(cold.join(cold.groupBy("text_sha256").agg(*stats), "text_sha256"))
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("seq") == F.col("best.seq")).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
