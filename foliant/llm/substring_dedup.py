"""Removal of word sequences that occur elsewhere too, by fixed-block anchors."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import give_back, shuffle_partitions
from foliant.llm.wordhash import runs, word_hashes

#: Of a block's hash so many low bits are kept beside its bucket, with two flags; what they confuse, extension sorts out.
KEPT_BITS = 38
#: Bytes of text in a chunk, and of entries in a bucket, about.
CHUNK_BYTES = 1 << 22


class Chunk:
    """The documents of one chunk in a fixed order, with the hashes of their words."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        pdf = pdf.sort_values(["row_key"], kind="stable")
        self.ids, self.texts = pdf["doc_id"].to_list(), [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
        self.window, self.block = window, (window + 1) // 2
        self.words = [word_hashes(t)[0] for t in self.texts]

    def anchors(self, buckets: int) -> tuple[np.ndarray, ...]:
        """Bucket and entry of each distinct rolling hash, and which entry each reference block has, by document.

        An entry is the hash's low bits, a flag for "occurs twice in this chunk" and one for "is a block here".
        """
        hashes = [runs(w, self.block) for w in self.words]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        is_block = np.concatenate([np.arange(len(h)) % self.block == 0 for h in hashes]) if hashes else np.zeros(0, dtype=bool)
        bucket = (flat >> np.uint64(KEPT_BITS)) % np.uint64(buckets)
        low = flat & np.uint64((1 << KEPT_BITS) - 1)
        order = np.lexsort((low, bucket))
        b, v = bucket[order], low[order]
        first = np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])])[: len(b)]
        slot = np.cumsum(first) - 1
        where = np.flatnonzero(first)
        size = np.diff(np.append(where, len(b)))
        held = np.zeros(len(where), dtype=bool)
        held[slot[is_block[order]]] = True
        entry = (v[where] << np.uint64(2)) | (size > 1).astype(np.uint64) << np.uint64(1) | held.astype(np.uint64)
        of_block = np.empty(len(flat), dtype=np.int64)
        of_block[order] = slot
        return b[where].astype(np.int64), entry, of_block, is_block

    def candidates(self, repeated: np.ndarray, of_block: np.ndarray, is_block: np.ndarray) -> list[np.ndarray]:
        """By document the starts of the windows whose first whole reference block occurs elsewhere too."""
        out, at = [], 0
        for w in self.words:
            n = max(len(w) - self.block + 1, 0)
            hit = repeated[of_block[at : at + n : self.block]] if n else np.zeros(0, dtype=bool)
            starts = np.arange(max(len(w) - self.window + 1, 0))
            out.append(starts[hit[-(-starts // self.block)]] if len(starts) else starts)
            at += n
        return out

    def windows(self, starts: list[np.ndarray], buckets: int) -> tuple[np.ndarray, ...]:
        """Bucket, fingerprint of 95 bits from two independent hashes of each word and "occurs twice in this chunk" of each distinct candidate window; the entry of each."""
        none = np.zeros(0, np.uint64)
        a = np.concatenate([runs(w, self.window)[s] if len(s) else none for w, s in zip(self.words, starts, strict=True)])
        c = np.concatenate([runs(word_hashes(t, 1)[0], self.window)[s] if len(s) else none for t, s in zip(self.texts, starts, strict=True)]) >> np.uint64(33)
        bucket = (a >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((c, a, bucket))
        b, x, y = bucket[order], a[order], c[order]
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(b)]
        slot = np.cumsum(first) - 1
        where = np.flatnonzero(first)
        size = np.diff(np.append(where, len(b)))
        entry = np.empty(len(where), dtype=[("a", "<u8"), ("c", "<u4")])
        entry["a"], entry["c"] = x[where], (y[where] << np.uint64(1)) | (size > 1)
        of_window = np.empty(len(a), dtype=np.int64)
        of_window[order] = slot
        return b[where].astype(np.int64), entry, of_window


def _five(entry: np.ndarray) -> bytes:
    return entry.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _rows(chunk_id: int, bucket: np.ndarray, blobs) -> pd.DataFrame:
    """One row a bucket; bucket is sorted, blobs(a, b) packs the entries from a to b."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    cuts = [0, *edges.tolist(), len(bucket)] if len(bucket) else [0]
    return pd.DataFrame({"chunk": chunk_id, "bucket": bucket[cuts[:-1]], "entries": [blobs(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]}, columns=["chunk", "bucket", "entries"])


def _probe(pdf: pd.DataFrame, window: int, buckets: int) -> pd.DataFrame:
    chunk = Chunk(pdf, window)
    bucket, entry, _, _ = chunk.anchors(buckets)
    return _rows(pdf["chunk"].iloc[0], bucket, lambda a, b: _five(entry[a:b]))


def _hits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk of this bucket a bit for each entry: it is a block whose hash occurs twice or more."""
    parts = [_unfive(x) for x in pdf["entries"]]
    every = np.concatenate(parts)
    values, slot, count = np.unique(every >> np.uint64(2), return_inverse=True, return_counts=True)
    many = count > 1
    many[slot[(every & np.uint64(2)) > 0]] = True
    hit = many[slot] & ((every & np.uint64(1)) > 0)
    return _marked(pdf, hit, [len(p) for p in parts])


def _marked(pdf: pd.DataFrame, hit: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    found = np.split(hit, np.cumsum(sizes)[:-1])
    out = pdf[["chunk", "bucket"]].assign(hits=[np.packbits(h).tobytes() for h in found])
    return out[[bool(h.any()) for h in found]]


def _flags(bucket: np.ndarray, hits: pd.DataFrame) -> np.ndarray:
    """The bits of all buckets beside the chunk's own entries; buckets without a row have none."""
    out = np.zeros(len(bucket), dtype=bool)
    for b, blob in zip(hits["bucket"], hits["hits"], strict=True):
        lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
        out[lo:hi] = np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=hi - lo).astype(bool)
    return out


def _extend(docs: pd.DataFrame, hits: pd.DataFrame, window: int, buckets: int) -> pd.DataFrame:
    if not len(docs) or not len(hits):
        return pd.DataFrame({"chunk": [], "bucket": [], "entries": []})
    chunk = Chunk(docs, window)
    bucket, _, of_block, is_block = chunk.anchors(buckets)
    starts = chunk.candidates(_flags(bucket, hits), of_block, is_block)
    own, entry, _ = chunk.windows(starts, buckets)
    return _rows(docs["chunk"].iloc[0], own, lambda a, b: entry[a:b].tobytes())


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk of this bucket a bit for each window: it occurs twice or more."""
    parts = [np.frombuffer(x, dtype=[("a", "<u8"), ("c", "<u4")]) for x in pdf["entries"]]
    every = np.concatenate(parts)
    a, c = every["a"], every["c"] >> 1
    order = np.lexsort((c, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])])
    slot = np.empty(len(a), dtype=np.int64)
    slot[order] = np.cumsum(new) - 1
    many = np.bincount(slot) > 1
    many[slot[(every["c"] & 1) > 0]] = True
    return _marked(pdf, many[slot], [len(p) for p in parts])


def _remove(docs: pd.DataFrame, hits: pd.DataFrame, repeats: pd.DataFrame, window: int, buckets: int, emit_text: bool) -> pd.DataFrame:
    chunk = Chunk(docs, window)
    starts = [np.zeros(0, dtype=np.int64)] * len(chunk.texts)
    if len(repeats):
        bucket, _, of_block, is_block = chunk.anchors(buckets)
        starts = chunk.candidates(_flags(bucket, hits), of_block, is_block)
        own, _, of_window = chunk.windows(starts, buckets)
        again = _flags(own, repeats)[of_window]
        sizes = np.cumsum([len(s) for s in starts])[:-1]
        starts = [s[x] for s, x in zip(starts, np.split(again, sizes), strict=True)]
    out = []
    for doc_id, data, w, s in zip(chunk.ids, chunk.texts, chunk.words, starts, strict=True):
        edge = np.zeros(len(w) + 1, dtype=np.int32)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        words = data.split()
        left = b" ".join(words if not len(s) else [x for x, g in zip(words, gone.tolist(), strict=True) if not g])
        out.append((doc_id, len(w), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if emit_text else None))
    give_back()
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, emit_text: bool = True) -> DataFrame:
    """Per input row doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless emit_text).

    A word goes if a window of `window` words that covers it starts anywhere else too, in the same text or
    another, as judged on the input. Words are runs of other than ASCII white space; null texts have none.

    Reference blocks are the whole, non-overlapping runs of (window + 1) // 2 words from each text's start: every
    window holds one. They are probed with all rolling hashes; a block met elsewhere is extended to the windows
    that hold it, which fingerprints of 95 bits compare, made from two independent hashes of each word; their union
    is the maximal repeat.

    Rows are dealt by their place in the table into chunks of a fixed order, so a chunk's entries can be worked out
    again and answers to them are bits. Chunks follow the bytes of the texts. Each chunk sends a distinct hash once,
    whatever its frequency: a passage in a third of all rows is one entry a chunk. Equal rows are spread like others
    and repeat each other.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(shuffle_partitions(spark), size // (4 * CHUNK_BYTES))
    placed = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = placed.select(F.pmod(F.xxhash64("row_key"), F.lit(max(4 * n, size // CHUNK_BYTES))).alias("chunk"), "row_key", "doc_id", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    entries, marks = "chunk long, bucket long, entries binary", "chunk long, bucket long, hits binary"
    chunks = dealt.groupBy("chunk")
    hits = chunks.applyInPandas(partial(_probe, window=window, buckets=n), entries).groupBy("bucket").applyInPandas(_hits, marks)
    extended = chunks.cogroup(hits.groupBy("chunk")).applyInPandas(partial(_extend, window=window, buckets=n), entries)
    repeats = extended.groupBy("bucket").applyInPandas(_repeats, marks)
    both = hits.withColumn("step", F.lit(1)).unionByName(repeats.withColumn("step", F.lit(2)))

    def remove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _remove(left, right[right["step"] == 1], right[right["step"] == 2], window, n, emit_text)

    return chunks.cogroup(both.groupBy("chunk")).applyInPandas(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, emit_text=False).drop("kept_text")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: {'i': i, 's': sha256(array_to_string(w[i:i + 34], ' '))})) AS v FROM t),
again AS (SELECT v.s AS s FROM v GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(v.i, v.i + 35)) AS i FROM v WHERE v.s IN (SELECT s FROM again)),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
k AS (
  SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed
  FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
