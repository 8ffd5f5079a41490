"""Exact top-k search by inner product over KD-trees, one per shard."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize, shuffle_partitions

#: Vectors of a shard and of a block of queries, about, and of a leaf, at most.
SHARD, BLOCK, LEAF = 8192, 2048, 256
#: Above every score's size: finite doubles have less than 320 digits, and there are less than 2 ** 31 components.
ENDLESS = 10**700


class Tree:
    """Median splits along the widest side, kept as one order of the vectors and nodes with tight boxes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, children (0: leaf)
        boxes = []
        self.nodes.append((0, len(ids), 0, 0))
        boxes.append((vectors.min(axis=0), vectors.max(axis=0)))
        at = 0
        while at < len(self.nodes):
            lo, hi, _, _ = self.nodes[at]
            low, high = boxes[at]
            side = int((high - low).argmax())
            if hi - lo > LEAF and high[side] > low[side]:  # equal vectors are never split: their box is a point
                mid = (lo + hi) // 2
                part = order[lo:hi]
                order[lo:hi] = part[np.argpartition(vectors[part, side], mid - lo)]
                self.nodes[at] = (lo, hi, len(self.nodes), len(self.nodes) + 1)
                for a, b in ((lo, mid), (mid, hi)):
                    self.nodes.append((a, b, 0, 0))
                    own = vectors[order[a:b]]
                    boxes.append((own.min(axis=0), own.max(axis=0)))
            at += 1
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def search(self, queries: np.ndarray, rows: np.ndarray, best: list[list[tuple[int, int, int]]], floors: list, k: int) -> None:
        """Improves best, a heap of (score, -vec_id, -row) for each query, whose k-th score carries over from tree to tree.

        A node's bound is the largest inner product of the query with any point of its box. Nodes are taken by
        falling bound; a bound below the k-th score, or below the query's floor, ends the search, an equal one does
        not, as ties go by id. rows are the queries' own rows, which are no candidates.
        """
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q in range(len(queries)):
            heap, own, bound, floor = best[q], int(rows[q]), bounds[q], floors[q]
            open_nodes = [(-bound[0], 0)]
            while open_nodes:
                b, node = heapq.heappop(open_nodes)
                least = heap[0][0] if len(heap) == k else -math.inf
                least = least if floor is None else max(least, floor)
                if -b < least:
                    break
                lo, hi, left, right = self.nodes[node]
                if left:
                    for child in (left, right):
                        if bound[child] >= least:
                            heapq.heappush(open_nodes, (-bound[child], child))
                    continue
                scores = self.vectors[lo:hi] @ queries[q]
                at = np.flatnonzero(scores >= least)
                if len(at) > k + 1:
                    least = np.partition(scores[at], len(at) - k - 1)[len(at) - k - 1]  # k + 1: one may be the query
                    more, ties = at[scores[at] > least], at[scores[at] == least]
                    at = np.concatenate([more, ties[np.argsort(self.ids[lo:hi][ties], kind="stable")[: k + 1]]])
                for i in at:
                    row = int(self.rows[lo + i])
                    if row != own:
                        item = (int(scores[i]), -int(self.ids[lo + i]), -row)
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)


def _matrix(vectors: pd.Series, scale: int, kind: type) -> np.ndarray:
    """floor(scale * x) of all components: doubles where sums are exact in them, else integers, else Python's."""
    x = np.array(vectors.to_list(), dtype=np.float64).reshape(len(vectors), -1)
    if kind is not object:
        return np.floor(x * scale).astype(kind)
    whole = lambda v: int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale)
    return np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object)


def _plant(pdf: pd.DataFrame, scale: int, kind: type) -> pd.DataFrame:
    tree = Tree(pdf["vec_id"].to_numpy(dtype=np.int64), pdf["row"].to_numpy(dtype=np.int64), _matrix(pdf["v"], scale, kind))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})


def _gather(pdf: pd.DataFrame, scale: int, kind: type) -> pd.DataFrame:
    asked = (pdf["vec_id"].to_numpy(dtype=np.int64), pdf["row"].to_numpy(dtype=np.int64), _matrix(pdf["v"], scale, kind))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "queries": [pickle.dumps(asked)]})


def _look(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Trees that follow each other for one block of queries share its k-th scores; floors holds those of a group before."""
    now, asked, best, floors = None, None, [], []

    def told() -> pd.DataFrame:
        return pd.DataFrame({"dim": [now[0]], "block": [now[1]], "best": [pickle.dumps(best)]})

    for b in batches:
        for key, blob, tree, before in zip(zip(b["dim"], b["block"], b["group"], strict=True), b["queries"], b["tree"], b["floors"], strict=True):
            if key != now:
                if now:
                    yield told()
                now, asked = key, pickle.loads(blob)
                best = [[] for _ in asked[0]]
                floors = [heap[0][0] if len(heap) == k else None for heap in pickle.loads(before)] if before else [None] * len(best)
            pickle.loads(tree).search(asked[2], asked[1], best, floors, k)
    if now:
        yield told()


def _tell(batches: Iterator[pd.DataFrame], wide: bool) -> Iterator[pd.DataFrame]:
    """The heaps of a block as rows; the key sorts as the score falls, whatever its size."""
    for b in batches:
        for blob, found in zip(b["queries"], b["best"], strict=True):
            ids, rows, _ = pickle.loads(blob)
            out = [(int(ids[q]), int(rows[q]), f"{ENDLESS - s:0701d}" if wide else f"{2**63 - s:020d}", -v, -r, str(s)) for q, heap in enumerate(pickle.loads(found)) for s, v, r in heap]
            yield pd.DataFrame(out, columns=["query_id", "query_row", "key", "vec_id", "row", "score_exact"])


def topk_search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best rows for each query row: query_id, rank from 1, vec_id, score, score_exact.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller vec_id.
    Queries are the rows whose id is divisible by `every`; all rows but the query's own are candidates. Vectors
    that are null, empty, or hold a null or non-finite component, and rows without id, take no part; vectors of
    different lengths do not meet. Rows that share an id are rows of their own, as queries and as candidates.
    Finite components of any size count exactly: where sums could leave 64 bits, all shards work with Python's
    integers, and score, a long, is cut to its range, while score_exact has all digits.

    Rows are dealt by hash into shards, each a KD-tree, and shards into groups. A block of queries first goes through
    one group's trees, then with the k-th scores found there through each other group's; within a group they are
    carried from tree to tree. The best of the groups are merged.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    rows = materialize(rows.select("vec_id", "row", F.size("v").alias("dim"), F.transform("v", lambda c: c.cast("double")).alias("v")))
    is_query = F.col("vec_id") % every == 0
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    n, m, dim, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)), F.max("dim"), F.max(largest)).first()
    bound = (dim or 1) * (int(most or 0) * scale + scale) ** 2
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    groups = min(shards, shuffle_partitions(spark))
    seat = F.xxhash64("row")
    own = {"scale": scale, "kind": kind}
    trees = rows.withColumn("shard", F.pmod(seat, F.lit(shards))).groupBy("dim", "shard").applyInPandas(partial(_plant, **own), "dim int, shard long, tree binary")
    trees = materialize(trees.withColumn("group", F.col("shard") % groups))
    asked = rows.where(is_query).withColumn("block", F.pmod(seat, F.lit(blocks))).groupBy("dim", "block").applyInPandas(partial(_gather, **own), "dim int, block long, queries binary")
    asked = materialize(asked)

    def looked(met: DataFrame) -> DataFrame:
        both = met.join(trees.hint("shuffle_merge"), ["dim", "group"]).sortWithinPartitions("dim", "group", "block")
        found = both.select("dim", "block", "group", "queries", "tree", "floors").mapInPandas(partial(_look, k=k), "dim int, block long, best binary")
        return materialize(found)

    # The first group of a block is one that has trees of its dimension.
    seats = trees.groupBy("dim").agg(F.sort_array(F.collect_set("group")).alias("there"))
    placed = materialize(asked.join(F.broadcast(seats), "dim").withColumn("home", F.element_at("there", (F.pmod("block", F.size("there")) + 1).cast("int"))))
    first = looked(placed.withColumn("group", F.col("home")).withColumn("floors", F.lit(None).cast("binary")))
    later = placed.join(first.withColumnRenamed("best", "floors"), ["dim", "block"]).withColumn("group", F.explode("there")).where("group != home")
    found = first.unionByName(looked(later)) if groups > 1 else first
    told = asked.join(found, ["dim", "block"]).select("queries", "best").mapInPandas(partial(_tell, wide=kind is object), "query_id long, query_row long, key string, vec_id long, row long, score_exact string")
    best = told.groupBy("query_id", "query_row").agg(F.sort_array(F.collect_list(F.struct("key", "vec_id", "row", "score_exact"))).alias("all"))
    ranked = best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("p", "b"))
    wide = F.when(F.col("b.score_exact").startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    score = F.coalesce(F.expr("try_cast(b.score_exact as bigint)"), wide)
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), score.alias("score"), F.col("b.score_exact").alias("score_exact"))


ORACLE = """
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r q, r c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
