"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where none is set, a session whose executors are threads of the driver gets a temporary one; on a cluster the home
    folder of the default file system is taken, and a machine's own file system is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            path = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        else:
            home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getHomeDirectory().toString()
            if home.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = f"{home}/foliant-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths that materialize has written, a list for each scratch() that is open.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize writes inside go at the end, but for those that the given function is told to keep."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(made[-1])
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        for path in set(made) - kept:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor loses nothing of it. The files go with the scratch() around it, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    for made in _open[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows inner join facts, one fact a key, where hot (one column, key) names a bounded number of frequent keys.

    The facts of the hot keys are broadcast, so their rows stay where they are; the others are shuffled.
    """
    few = facts.join(F.broadcast(hot), key, "left_semi")
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(facts, key))


#: Bits of a filter over keys, at most. A full filter lets all rows pass; what follows it decides.
FILTER_BITS = 1 << 23


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with a column may: false if a hash filter over keys (one column, key) rules the row's key out.

    The filter is broadcast: at most FILTER_BITS / 64 rows of 64 bits, whatever the number of keys.
    """
    bits = lambda df: df.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))).withColumns({"__word": (F.col("__h") / 64).cast("int"), "__bit": (F.col("__h") % 64).cast("int")})
    words = materialize(bits(keys.select(key)).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits")))
    told = bits(rows).join(F.broadcast(words), "__word", "left")
    return told.withColumn("may", F.coalesce(F.expr("shiftright(__bits, __bit) & 1") == 1, F.lit(False))).drop("__h", "__word", "__bit", "__bits")


def sparse_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows left join facts (written before, one a key), where few rows have one: the others are not shuffled."""
    told = among(rows, facts, key)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key]
    here = told.where("may").drop("may").join(facts, key, "left")
    return here.unionByName(told.where("not may").drop("may").select("*", *none))


def frequent(rows: DataFrame, key: str, support: float = 1 / 512) -> DataFrame:
    """Keys that Misra-Gries counters hold: all above that share of rows, at most 1/support."""
    return materialize(rows.stat.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key)).where(F.col(key).isNotNull()))


class small_batches(contextlib.nullcontext):  # noqa: N801
    """From now on Python workers get so many rows at once at most: whole texts are long.

    The setting of the session stays lowered, as operators return frames that run later.
    """

    def __init__(self, spark: SparkSession, rows: int = 500):
        super().__init__()
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, str(rows))


def give_back() -> None:
    """Hand memory that is free back to the system: workers live on from task to task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
