"""Operators over the ordered lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import structure, text

def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "\n") -> DataFrame:
    """id, pos, line; documents are dealt by id once, which windows and regrouping by id then use."""
    lines = F.split(text.blank_if_null(F.col(text_col)), pattern, -1)
    return df.select(id_col, lines.alias("lines")).repartition(F.col(id_col)).select(id_col, F.posexplode("lines").alias("pos", "line"))


def join_lines(pairs: Column, between: str = "\n") -> Column:
    """Array of (pos, line) to text, by pos."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["line"]), between)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3, min_length: int = 10, raw_col: str | None = None) -> DataFrame:
    """Of lines of a document that occur more often than threshold, only the first stays; short lines all stay.

    Rows that share an id, and those without one, count as one document. raw_col: a column with the text as it was.
    """
    stripped = text.strip(F.col("line"))
    norm = F.when(F.length(stripped) >= min_length, F.lower(text.squeeze(F.col("line"))))
    lines = explode_lines(df, id_col, text_col).withColumn("norm", norm)
    own = Window.partitionBy(id_col, "norm")
    marked = lines.withColumns({"n": F.count(F.lit(1)).over(own), "nth": F.row_number().over(own.orderBy("pos"))})
    kept = F.when(F.col("norm").isNull() | (F.col("n") <= threshold) | (F.col("nth") == 1), F.struct("pos", "line"))
    raw = [join_lines(F.collect_list(F.struct("pos", "line"))).alias(raw_col)] if raw_col else []
    return marked.groupBy(id_col).agg(join_lines(F.collect_list(kept)).alias(text_col), *raw)


def tables_as_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Lines of three or more columns two spaces apart become rows with bars; blank lines set tables off."""

    def row(line: Column) -> Column:
        cells = F.filter(F.split(text.strip(line), r"(?U)\s{2,}"), lambda s: s != "")
        return F.transform(F.array(cells), lambda c: F.when(F.size(c) >= 3, F.array_join(c, " | ")))[0]

    carried = carried or []
    lines = df.select(id_col, *carried, F.split(text.blank_if_null(F.col(text_col)), "\n", -1).alias("lines"))
    rows = lines.select(id_col, *carried, "lines", F.transform("lines", row).alias("rows"))
    at = lambda i: F.get("rows", i)
    blank = lambda c: F.when(c, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def out(line: Column, i: Column) -> Column:
        first = (i > 0) & at(i - 1).isNull()
        last = (i < F.size("lines") - 1) & at(i + 1).isNull()
        return F.when(at(i).isNull(), F.array(line)).otherwise(F.concat(blank(first), F.array(at(i)), blank(last)))

    return rows.select(id_col, *carried, F.array_join(F.flatten(F.transform("lines", out)), "\n").alias(text_col))


def split_announcements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 40) -> DataFrame:
    """id, segment_no, segment: a boundary line starts a segment; short ones go unless the only one. Nothing is shuffled."""
    return df.select(id_col, F.posexplode(structure.announcements(F.col(text_col), least_letters)).alias("segment_no", "segment"))


def filter_low_confidence(df: DataFrame, tokens: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 25.0) -> DataFrame:
    """Noise lines go from documents without token confidences and from those whose mean is low."""
    means = tokens.groupBy(id_col).agg(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("mean"), F.count(F.lit(1)).alias("n_tokens"))
    low = F.col("n_tokens").isNull() | (F.coalesce("mean", F.lit(0.0)) < least)
    return df.join(means, id_col, "left").select(id_col, F.when(low, text.filter_noise_lines(F.col(text_col))).otherwise(text.blank_if_null(F.col(text_col))).alias(text_col))


def join_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text") -> DataFrame:
    """Page texts that are not blank, in page order, a blank line apart."""
    piece = F.when(text.strip(text.blank_if_null(F.col(text_col))) != "", F.struct(F.col(page_col).alias("pos"), F.col(text_col).alias("line")))
    return pages.groupBy(doc_col).agg(join_lines(F.collect_list(piece), "\n\n").alias(text_col))


def reliable_text(pages: DataFrame, doc_col: str, text_col: str = "text", least_letters: int = 200, least_share: float = 0.30) -> DataFrame:
    """Whether embedded text can stand for recognition: a page with many letters and a fair share of them overall."""
    own = pages.select(doc_col, text.letters(text.blank_if_null(F.col(text_col))).alias("a"), F.length(text.blank_if_null(F.col(text_col))).alias("n"))
    share = F.sum("a") / F.greatest(F.sum("n") + 2 * (F.count(F.lit(1)) - 1), F.lit(1))
    return own.groupBy(doc_col).agg(((F.max("a") >= least_letters) & (share >= least_share)).alias("reliable"))


def similar_words(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """word, similar, distance: dictionary words within an edit distance.

    Cut into most + 1 parts, a dictionary word within the distance has a part that the other word has as well, at
    most so many places away; so the join is an equi-join on length, part and place in order. Lower-cased words
    are cut, as lower case changes the length of some.
    """
    low, n, parts = F.lower("word"), F.length(F.lower("word")), most + 1
    start = lambda n, i: F.floor(n * i / parts).cast("int")
    key = lambda n, i, part: F.struct(n.alias("n"), i.alias("i"), part.alias("part"))
    numbers = F.array(*[F.lit(i) for i in range(parts)])
    right = dictionary.select(F.col("word").alias("similar"), F.explode(F.transform(numbers, lambda i: key(n, i, F.substring(low, start(n, i) + 1, start(n, i + 1) - start(n, i))))).alias("key"))

    def places(of: Column, i: Column) -> Column:
        first, size = start(of, i), start(of, i + 1) - start(of, i)
        at = F.filter(F.sequence(first - most, first + most), lambda q: (q >= 0) & (q <= F.col("n") - size))
        return F.transform(at, lambda q: key(of, i, F.substring(F.col("low"), q + 1, size)))

    lengths = F.sequence(F.greatest(F.col("n") - most, F.lit(0)), F.col("n") + most)
    keys = F.flatten(F.transform(lengths, lambda of: F.flatten(F.transform(numbers, lambda i: places(of, i)))))
    left = words.select("word", low.alias("low"), n.alias("n")).select("word", F.explode(F.array_distinct(keys)).alias("key"))
    distance = F.levenshtein(F.lower("word"), F.lower("similar"), most)
    pairs = left.join(right, "key").select("word", "similar", distance.alias("distance")).where("distance >= 0")
    return pairs.distinct()
