"""Line deduplication over content-defined chunks of lines and the runs of those left, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import among, frequent, materialize, sparse_join, spread_join


def _piece(start: Column, size: Column, chunk: Column) -> Column:
    return F.struct(start.alias("start"), size.alias("size"), chunk.alias("chunk"), F.xxhash64(F.slice("hashes", start + 1, size)).alias("hash"))


def _bounded(rows: DataFrame, modulus: int) -> DataFrame:
    """rows (row_key, row_id, lines) with hashes, of the lines, and the starts (from 0) and ends of their chunks.

    A chunk ends after a line whose rolling hash, over its hash and that of the line before, is 0 modulo
    `modulus`, or with the text. The two lines alone decide, so an insertion moves no later boundary.
    Each array is a column of its own: inside a lambda, an expression would be worked out for every element.
    """
    hashed = rows.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    rolling = lambda i: F.xxhash64(F.element_at("hashes", F.greatest(i - 1, F.lit(1))), F.element_at("hashes", i))
    size = F.size("hashes")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | ((i > 1) & (F.pmod(rolling(i), F.lit(modulus)) == 0)))
    return hashed.withColumn("ends", ends).withColumn("starts", F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1)))


def _chunks(rows: DataFrame, modulus: int, least_lines: int) -> DataFrame:
    """rows with pieces, an array of start, size and hash of each chunk's own lines."""
    pieces = F.filter(F.zip_with("starts", "ends", lambda a, b: _piece(a, b - a, a)), lambda c: c["size"] >= least_lines)
    return _bounded(rows, modulus).select("row_key", "row_id", "lines", pieces.alias("pieces"))


def _chunks_and_runs(rows: DataFrame, modulus: int, n: int) -> DataFrame:
    """rows with pieces as in _chunks: chunks, and runs of n lines that follow each other, one from every line.

    A chunk reaches n - 1 lines into the next, so each run lies in the one chunk (its start is chunk) where it begins.
    Chunks of one run are left out: the run says the same.
    """
    size = F.size("hashes")
    bounded = _bounded(rows, modulus).withColumn("at", F.flatten(F.zip_with("starts", "ends", lambda a, b: F.array_repeat(a, b - a))))
    chunks = F.filter(F.zip_with("starts", "ends", lambda a, b: _piece(a, F.least(b + n - 1, size) - a, a)), lambda c: c["size"] > n)
    runs = F.filter(F.zip_with(F.sequence(F.lit(0), size - 1), "at", lambda a, at: _piece(a, F.lit(n), at)), lambda c: c["start"] + n <= size)
    return bounded.select("row_key", "row_id", "lines", F.concat(chunks, runs).alias("pieces"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, least_lines: int = 2) -> DataFrame:
    """docs with repeated chunks cut from the text, and ``n_lines_removed``.

    Lines end at newlines. Of chunks of at least least_lines lines with the same bytes anywhere in the table, the
    one in the smallest (id, then hash of id and text, then place) stays and the others go, whatever their number.
    Hashes only find candidates; the SHA-256 of a candidate's bytes decides, so a chunk of any size is compared by
    32 bytes. A text that loses every chunk becomes empty; null stays null. Rows equal in id and text count as
    one document and are cut alike. Counts use partial aggregation; chunks above 1/512 of all (Misra-Gries)
    meet their first place by broadcast, the others by shuffle; of the texts only those that are cut are shuffled.
    """
    return _cut(docs, id_col, text_col, lambda base: _chunks(base, modulus, least_lines), _later)


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, least_lines: int = 2) -> DataFrame:
    """docs with every repeated passage of at least least_lines lines cut from the text, and ``n_lines_removed``.

    A line goes if it lies in a run of least_lines lines that stands at an earlier place (as in line_dedup) of the
    table too. Chunks find what repeats at large, and later copies of a chunk go whole. Boundaries cut passages, so an
    exact check follows: the runs of the chunks that are left, one from every line, are compared with each other. A
    run's first place is always in a chunk that is left, as is a passage's part beyond its whole chunks; so a passage
    goes to its last line wherever it begins and whatever is around it. Each line's first place in the table always
    stays. All else is as in line_dedup.
    """

    def later(seen: DataFrame) -> DataFrame:
        copies = materialize(_later(seen.where(F.col("size") > least_lines)))
        known = copies.select("row_key", F.col("start").alias("chunk"))
        runs = materialize(seen.where(F.col("size") == least_lines).join(known, ["row_key", "chunk"], "left_anti"))
        return copies.unionByName(_later(runs))

    return _cut(docs, id_col, text_col, lambda base: _chunks_and_runs(base, modulus, least_lines), later)


def _later(seen: DataFrame) -> DataFrame:
    """row_key, start and size of the pieces that stand at an earlier place too."""
    place = F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "row_key", "start")
    facts = materialize(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    is_first = (F.col("first.row_key") == F.col("row_key")) & (F.col("first.start") == F.col("start"))
    return spread_join(seen, facts, "digest", frequent(seen.select("digest"), "digest")).where(~is_first).select("row_key", "start", "size").distinct()


def _cut(docs: DataFrame, id_col: str, text_col: str, cut_up: Callable[[DataFrame], DataFrame], later: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the pieces of text, of those that cut_up makes, that later finds among the repeated ones.

    A piece is known by the SHA-256 of its lines: of two lines by both, of more by the SHA-256 of theirs.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.select(key.alias("row_key"), F.col(id_col).alias("row_id"), F.split(text_col, "\n").alias("lines")).where("lines is not null")
    rows = cut_up(base)
    # A plain explode is given a filter on its array, which goes below the columns that the lambdas read and undoes them.
    often = materialize(rows.select(F.explode_outer("pieces.hash").alias("hash")).where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    lines = rows.withColumn("digests", F.transform("lines", lambda x: F.sha2(x, 256)))
    of = lambda c: F.when(c["size"] == 2, F.concat(F.get("digests", c["start"]), F.get("digests", c["start"] + 1))).otherwise(F.sha2(F.array_join(F.slice("digests", c["start"] + 1, c["size"]), ""), 256))
    digested = F.transform("pieces", lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), c["chunk"].alias("chunk"), c["hash"].alias("hash"), of(c).alias("digest")))
    told = lines.select("row_key", "row_id", F.explode_outer(digested).alias("c")).where("c is not null").select("row_key", "row_id", "c.*")
    seen = materialize(among(told, often, "hash").where("may").drop("may", "hash").withColumn("digest", F.unhex("digest")))
    cut_out = later(seen)
    span = F.sequence("start", F.col("start") + F.col("size") - 1)
    cut = materialize(cut_out.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_list(span))).alias("cut")))
    joined = sparse_join(docs.select(F.struct("*").alias("doc"), key.alias("row_key")), cut, "row_key")
    joined = joined.withColumn("lines", F.when(F.col("cut").isNotNull(), F.split(F.col("doc")[text_col], "\n")))
    kept_lines = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut")
    left = F.when(F.col("cut").isNull(), F.col("doc")[text_col]).otherwise(F.array_join(F.transform(kept_lines, lambda i: F.get("lines", i)), "\n"))
    columns = [left.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns]
    gone = F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut"))
    return joined.select(*columns, gone.cast("long").alias("n_lines_removed"))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines_removed and the digest of the text that is left."""
    out = passage_dedup(docs)
    return out.select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text"), 256).alias("text_sha256"))
