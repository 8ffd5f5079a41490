"""Records, results, history, statistics and row access."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_upsert(current: DataFrame, *changes: DataFrame, id_col: str = "id", version: str = "version") -> DataFrame:
    """One row an id: the one with the highest version, of the tables that have it the one given first."""
    both = reduce(DataFrame.unionByName, [df.withColumn("__place", F.lit(-i)) for i, df in enumerate((current, *changes))])
    rest = [c for c in current.columns if c != id_col]
    newest = both.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct(version, "__place")).alias("r"))
    return newest.select(id_col, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_append(current: DataFrame, new: DataFrame, key: str | None = None) -> DataFrame:
    """Plain append, as the table has no key; with one, rows whose key is there already are left out."""
    return current.unionByName(new if key is None else new.dropDuplicates([key]).join(current.select(key), key, "left_anti"))


def result_defaults(results: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return results.select("id", "filename", "text", zero("pages"), zero("columns"), zero("characters"), zero("processing_time"), "user_id", "created_at")


def user_stats(results: DataFrame) -> DataFrame:
    known = results.where(F.col("user_id").isNotNull())
    return known.groupBy("user_id").agg(F.sum(F.coalesce("pages", F.lit(0))).alias("total_pages"), F.count(F.lit(1)).alias("total_documents"), F.max("created_at").alias("last_activity"))


def user_stats_merge(current: DataFrame, update: DataFrame) -> DataFrame:
    """Counters added up, the later activity kept; users of either side."""
    both = current.unionByName(update)
    return both.groupBy("user_id").agg(F.sum("total_pages").alias("total_pages"), F.sum("total_documents").alias("total_documents"), F.max("last_activity").alias("last_activity"))


def visible_to(results: DataFrame, user_id: Column | int) -> DataFrame:
    """Row access: one's own rows and those of nobody."""
    return results.where((F.col("user_id") == user_id) | F.col("user_id").isNull())


def owned_by(results: DataFrame, user_id: Column | int) -> DataFrame:
    return results.where(F.col("user_id") == user_id)


def delete_owned(results: DataFrame, requests: DataFrame) -> DataFrame:
    """What is left after requests (id, user_id) to delete; only an owner's count."""
    return results.join(requests, (results["id"] == requests["id"]) & (results["user_id"] == requests["user_id"]), "left_anti")


def with_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that a foreign key allows: its parent is there, or it is null."""
    return rows.where(F.col(key).isNull()).unionByName(rows.join(parents.select(key), key, "left_semi").select(*rows.columns))


def cascade_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What is left when the parents in gone are deleted; rows without a parent stay."""
    return rows.join(gone.select(key), key, "left_anti").select(*rows.columns)


def update_rows(rows: DataFrame, changes: DataFrame, key: str, now: Column, stamp: str = "updated_at") -> DataFrame:
    """rows with the changes (one a key, columns of rows) put in; whatever a change names is stamped, also if it alters nothing."""
    new = changes.select(key, F.struct(*[c for c in changes.columns if c != key]).alias("__new"))
    names = set(changes.columns) - {key}
    joined = rows.join(new, key, "left")
    named = F.col("__new").isNotNull()
    put = lambda c: F.when(named, now if c == stamp else F.col("__new")[c]).otherwise(F.col(c)).alias(c)
    return joined.select(*[put(c) if c in names or c == stamp else F.col(c) for c in rows.columns])


def sanitized(c: Column, kind: T.DataType) -> Column:
    """The value with every binary in it, at any depth, told by its size."""
    match kind:
        case T.BinaryType():
            return F.when(c.isNotNull(), F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>")))
        case T.StructType():
            return F.when(c.isNotNull(), F.struct(*[sanitized(c[f.name], f.dataType).alias(f.name) for f in kind]))
        case T.ArrayType():
            return F.transform(c, lambda x: sanitized(x, kind.elementType))
        case T.MapType():
            return F.transform_values(c, lambda _, v: sanitized(v, kind.valueType))
    return c


def safe_errors(errors: DataFrame) -> DataFrame:
    """errors with all columns fit to be shown: no raw bytes."""
    return errors.select(*[sanitized(F.col(f.name), f.dataType).alias(f.name) for f in errors.schema])


def rename_owned(results: DataFrame, user_id: Column | int, result_id: Column | int, name: str) -> DataFrame:
    mine = (F.col("id") == result_id) & (F.col("user_id") == user_id)
    return results.withColumn("filename", F.when(mine, F.trim(F.lit(name))).otherwise(F.col("filename")))


def history_page(results: DataFrame, user_id: Column | int, page: int = 0, size: int = 10) -> DataFrame:
    return owned_by(results, user_id).orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size)


def rate_limit(requests: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """requests with accepted: of a key's requests in order, those with room in the window; rejected ones take none.

    Requests are dealt by key and sorted by time; a pass over them holds the last key's accepted times only, at most
    `limit`, however long its history is. Requests without a time are rejected.
    """
    kind = requests.schema[key].dataType.simpleString()
    window = seconds * 1_000_000

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), deque()
        for b in batches:
            ok = []
            for k, t in zip(b["k"], b["t"], strict=True):
                k = None if pd.isna(k) else k
                if k != now:
                    now, held = k, deque()
                while held and t - held[0] > window:
                    held.popleft()
                ok.append(bool(len(held) < limit and not pd.isna(t)))
                if ok[-1]:
                    held.append(t)
            yield pd.DataFrame({key: b["k"], "event_id": b["event_id"], "accepted": ok})

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.select(F.col(key).alias("k"), micros.alias("t"), "event_id").repartition("k").sortWithinPartitions("k", "t", "event_id")
    return rows.mapInPandas(passed, f"`{key}` {kind}, event_id long, accepted boolean")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, similarity: the k nearest other vectors of each stated query.

    queries is a stated set, dealt into blocks; vectors are dealt into parts, and each block of queries meets each part
    by an equi-join on both. The ranking is cut to k rows a query in every task before anything is shuffled.
    """
    spark = vectors.sparkSession
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(dot(c, c))
    blocks, parts = max(1, -(-queries.count() // block)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), norm(F.col("embedding")).alias("qn"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    right = vectors.select("vec_id", "embedding", norm(F.col("embedding")).alias("n"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    both = right.withColumn("block", all_of(blocks)).join(left.withColumn("part", all_of(parts)), ["block", "part"]).where("vec_id != query_id")
    scored = both.select("query_id", "vec_id", F.round(dot(F.col("embedding"), F.col("q")) / (F.col("n") * F.col("qn")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def l2_normalize(c: Column) -> Column:
    squares = F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(F.struct(c.alias("v"), F.sqrt(squares).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] > 0, s["n"]).otherwise(1.0)))[0]
