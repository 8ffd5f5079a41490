"""Unigram SentencePiece encoding as relations: substrings, an equi-join with the piece table, a fold over each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import frequent, materialize, spread_join, text_or_empty
from foliant.llm.pieces import SPACE_MARK, UNITS, UNKNOWN_PENALTY, Codec, codec

#: Characters of a word whose lattice is one row at most; longer words take the arrays of pieces.Codec.
LONGEST_WORD = 512


def words_of(docs: DataFrame, model: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, pos, word: the words of each text, each with the spaces before it; a text without any has one null."""
    marked = F.regexp_replace(text_or_empty(text_col), " ", SPACE_MARK)
    whole = F.when(text_or_empty(text_col) == "", "").otherwise(F.concat(F.lit(SPACE_MARK if model.dummy else ""), marked))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(whole, F.lit(UNITS.pattern), F.lit(0)).alias("words"))
    return rows.select("row", "doc_id", F.posexplode_outer("words").alias("pos", "word"))


def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word, end, len, id, score: every substring of up to `longest` characters that is a piece.

    pieces (piece, id, score) is a vocabulary, whose size is that of the model file; Spark may broadcast it.
    """
    n = F.length("word")
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - a)), lambda k: F.struct((a + k).alias("end"), k.alias("len"), F.substring(F.col("word"), a + 1, k).alias("piece"))),
        )
    )
    return words.where(n > 0).select("word", F.explode(parts).alias("p")).select("word", "p.*").join(pieces, "piece").drop("piece")


def viterbi(found: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """word and path, an array of (id, at): the pieces of the path with the best sum, -1 where a character has none.

    Edges are grouped by word and end, then by word; a fold over the places keeps the best path to each, and another
    from the last place back reads it off. Of equal sums the one with the longer last piece is taken.
    """
    by_end = found.groupBy("word", "end").agg(F.collect_list(F.struct("score", "len", "id")).alias("here"))
    by_word = by_end.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("end", "here"))).alias("ends"))
    ready = words.join(by_word, "word", "left")
    best = "array<struct<score:double,len:int,id:int>>"

    def forward(acc: Column, j: Column) -> Column:
        to = lambda e: F.struct((F.element_at(acc, j - e["len"] + 1)["score"] + e["score"]).alias("score"), e["len"].alias("len"), e["id"].alias("id"))
        here = F.coalesce(F.element_at(F.col("ends"), j), F.array().cast(best))
        alone = F.struct(F.lit(float(unknown)).alias("score"), F.lit(1).alias("len"), F.lit(-1).alias("id"))
        every = F.when(F.exists(here, lambda e: e["len"] == 1), here).otherwise(F.concat(here, F.array(alone)))
        return F.concat(acc, F.array(F.array_max(F.transform(every, to))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("len"), F.lit(0).alias("id"))).cast(best)
    folded = ready.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.length("word")), start, forward))

    def back(acc: Column, j: Column) -> Column:
        step = F.element_at(F.col("best"), j + 1)
        taken = F.concat(F.array(F.struct(step["id"].alias("id"), (j - step["len"]).alias("at"))), acc["path"])
        return F.when(acc["place"] == j, F.struct((j - step["len"]).alias("place"), taken.alias("path"))).otherwise(acc)

    end = F.struct(F.length("word").alias("place"), F.array().cast("array<struct<id:int,at:int>>").alias("path"))
    return folded.select("word", F.aggregate(F.sequence(F.length("word"), F.lit(1), F.lit(-1)), end, back, lambda acc: acc["path"]).alias("path"))


def ids_of(paths: DataFrame, model: Codec) -> DataFrame:
    """word and ids; characters without a piece become their bytes' ids, or one unknown for neighbours."""
    if not model.byte:
        first = lambda p, i: (p["id"] >= 0) | (i == 0) | (F.get(F.col("path"), i - 1)["id"] >= 0)
        return paths.select("word", F.transform(F.filter("path", first), lambda p: F.when(p["id"] < 0, F.lit(model.unk)).otherwise(p["id"])).alias("ids"))
    table = F.array(*[F.lit(model.byte[b]) for b in range(256)])

    def spelled(p: Column) -> Column:
        code = F.hex(F.encode(F.substring(F.col("word"), p["at"] + 1, F.lit(1)), "UTF-8"))
        of = lambda i: F.get(table, F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
        return F.when(p["id"] >= 0, F.array(p["id"])).otherwise(F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), of))

    return paths.select("word", F.flatten(F.transform("path", spelled)).alias("ids"))


def encode_unigram(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row doc_id and the ids of its text under a unigram model file, as the library gives them.

    Distinct words are cut into substrings, joined with the piece table, grouped and folded; the ids of the most frequent
    words (at most 512, Misra-Gries) meet their occurrences by broadcast, the others by shuffle. Null texts count as
    empty and give no ids; repeated rows each get a row.
    """
    spark, model = docs.sparkSession, codec(path)
    if model.bpe:
        raise ValueError("a BPE model's encoding is no path of best sum; pieces.encode merges")
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = spark.createDataFrame([(p, i, float(model.scores[i])) for p, i in model.ids.items()], "piece string, id int, score double")
    placed = materialize(words_of(docs, model, id_col, text_col))
    distinct = materialize(placed.where("word is not null").select("word").distinct())
    short = distinct.where(F.length("word") <= LONGEST_WORD)
    known = ids_of(viterbi(edges(short, pieces, model.longest), short, model.least - UNKNOWN_PENALTY), model)

    def arrays(batches):
        for b in batches:
            yield b.assign(ids=codec(path).words(b["word"].to_list()))

    known = materialize(known.unionByName(distinct.where(F.length("word") > LONGEST_WORD).mapInPandas(arrays, "word string, ids array<int>")))
    met = spread_join(placed.where("word is not null"), known, "word", frequent(placed.select("word"), "word"))
    every = met.select("row", "doc_id", "pos", "ids").unionByName(placed.where("word is null").select("row", "doc_id", F.lit(0).alias("pos"), F.array().cast("array<int>").alias("ids")))
    sorted_ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]))
    return every.groupBy("row").agg(F.first("doc_id").cast(kind).alias("doc_id"), sorted_ids.alias("ids")).drop("row")
