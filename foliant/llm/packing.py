"""Packing of tokenised documents into sequences: a configuration linear program over the length histogram."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import give_back, materialize, shuffle_partitions, small_batches, text_or_empty

#: Fixed value: how the byte-level vocabulary splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "piece int, start long, length long, ids_crc32 long"


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Encodes as ``tokenizers`` does with the file at path, without adding special tokens.

    Where the file is plain byte-level BPE whose ids follow its merges, the same merges run in tiktoken, which is
    several times as fast; texts with one of the file's special strings, and other files, take ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, model = spec["model"]["vocab"], spec["model"]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    in_order = all(vocab.get(m) == 256 + i for i, m in enumerate(merges))
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type") != "BPE" or not in_order or not plain or spec.get("normalizer") or model.get("ignore_merges"):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    fast = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id and its pieces: ids and an end id, cut where longer than capacity so that only the first is shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                start = 0
                for k in range(-(-len(ids) // capacity)):
                    stop = len(ids) - (-(-len(ids) // capacity) - 1 - k) * capacity
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(cut, f"doc_id {kind}, {PIECES}")


def knapsack(prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths and their numbers, worth most at these prices within capacity: dynamic programming over the room used.

    prices[l] and most[l] belong to length l; a pattern that would take more of a length than there are is cut.
    """
    usable = np.flatnonzero(most > 0)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    worth = prices[usable]
    ends = np.searchsorted(usable, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := ends[room]:
            value = best[room - usable[:n]] + worth[:n]
            i = int(value.argmax())
            if value[i] > best[room]:
                best[room], last[room] = value[i], usable[i]
    taken: dict[int, int] = {}
    room = capacity
    while room > 0:
        if not last[room]:
            room -= 1
            continue
        item = int(last[room])
        if taken.get(item, 0) < most[item]:
            taken[item] = taken.get(item, 0) + 1
        room -= item
    return taken


def plan(histogram: dict[int, int], capacity: int = 2048, rounds: int = 400, step: float = 0.5) -> list[tuple[int, dict[int, int]]]:
    """Patterns (copies, {length: number}) that hold every piece of the histogram exactly once.

    The configuration program (fewest patterns that cover each length's count) is solved by multiplicative
    weights: a length's price is its weight over its count, the dynamic program finds the dearest pattern, and
    the weights of what it covers fall. Of some shares of the fractional copies, made whole, the one that needs the
    fewest sequences is taken; what it leaves is packed best fit, longest first, on the histogram. Time and memory depend on capacity and rounds, not on the counts.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    done = [(int(left[capacity]), {capacity: 1})] if left[capacity] else []
    left[capacity] = 0
    counts, weights, used = left.astype(float), np.ones(capacity + 1), {}
    for _ in range(rounds if left.sum() else 0):
        prices = np.where(counts > 0, weights / np.maximum(counts, 1), 0) * (1 + np.arange(capacity + 1) / capacity)
        pattern = knapsack(prices, left, capacity)
        copies = step * min(left[i] / n for i, n in pattern.items())
        key = tuple(sorted(pattern.items()))
        used[key] = used.get(key, 0) + copies
        for i, n in pattern.items():
            weights[i] *= np.exp(-n * copies / counts[i])
    ranked = sorted(used.items(), key=lambda x: (capacity - sum(i * n for i, n in x[0]), -x[1], x[0]))
    tries = [_rounded(ranked, left.copy(), capacity, share) for share in (1.0, 0.5, 0.2, 0.05)]
    return done + min(tries, key=lambda p: sum(copies for copies, _ in p))


def _rounded(ranked: list, left: np.ndarray, capacity: int, share: float) -> list[tuple[int, dict[int, int]]]:
    """Whole copies of that share of the fractional ones, full patterns only, and best fit for what they leave."""
    done = []
    for key, copies in ranked:
        whole = int(min(np.ceil(share * copies), *(left[i] // n for i, n in key)))
        if whole > 0 and sum(i * n for i, n in key) == capacity:
            done.append((whole, dict(key)))
            for i, n in key:
                left[i] -= n * whole
    return done + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing over counts; alike sequences are one entry."""
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = min((c for c in groups if c >= length), default=None)
            if room is None:
                room = capacity
                per = room // length
                groups.setdefault(room, []).append((-(-n // per), {}))
            copies, held = groups[room].pop()
            if not groups[room]:
                del groups[room]
            per = min(room // length, n)
            full = min(copies, n // per)
            if copies > full:
                groups.setdefault(room, []).append((copies - full, held))
            groups.setdefault(room - per * length, []).append((full, held | {length: per}))
            n -= full * per
    return [(copies, held) for at in groups.values() for copies, held in at if held]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Only the histogram, at most capacity rows, goes to the driver. Each length's pieces are ranked by ranking
    within salted parts and adding the sizes of the parts before; the plan, runs of alike sequences, turns a
    rank into a place. Repeated rows are packed each for itself.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for copies, held in plan(histogram, capacity):
        at = 0
        for length, n in sorted(held.items(), reverse=True):
            table.setdefault(length, []).append((filled.get(length, 0), first, n, at))
            filled[length] = filled.get(length, 0) + copies * n
            at += n * length
        first += copies
    runs = {length: np.array(rows, dtype=np.int64) for length, rows in table.items()}

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(4 * shuffle_partitions(spark))))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    sizes = salted.groupBy("length", "salt").count().select("length", "salt", before.alias("before"))
    ranked = salted.withColumn("within", within).join(sizes, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            lengths, ranks = b["length"].to_numpy(), b["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(at):
                    own = runs[int(lengths[at[0]])]
                    lo, base, n, start = own[np.searchsorted(own[:, 0], ranks[at], side="right") - 1].T
                    i = ranks[at] - lo
                    sequence[at], offset[at] = base + i // n, start + i % n * lengths[at]
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*names).mapInPandas(place, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")
