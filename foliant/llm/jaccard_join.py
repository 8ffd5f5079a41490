"""Similarity join on word shingles: prefix filters under several global token orders, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import among, frequent, give_back, materialize, shuffle_partitions, small_batches, spread_join
from foliant.llm.components import components
from foliant.llm.wordhash import gathered, mix, runs, word_hashes

SHINGLE = 5
#: Similarity, in percent.
PERCENT = 75
#: Tokens that the orders put last, by their frequency: at most so many are broadcast.
FREQUENT = 1 << 16
#: Tokens that one task reports as frequent at most, and the documents of the task that they are in at least.
TASK_FREQUENT, TASK_LEAST = 20_000, 8
ORDERS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))
#: Hashes that a task gathers before it passes them on, and postings of a bucket, about.
HELD, BUCKET = 1 << 19, 1 << 20
#: Nodes of a token, at most, that are paired where they meet; the nodes of others meet by stars.
PAIRED = 12
#: Sets and bytes of sets in a block, about: a star's sets meet in pairs of blocks.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
#: Pairs that one set meets in one group at most, before its group is split.
FANNED = 512
#: Tokens that a strip of a block's matrix has.
STRIP = 4096

DOCS, TOKENS = 0, 1
TO = "array<struct<hub:bigint,fan:int>>"
PLACE = np.dtype([("node", "<i8"), ("pos", "<i4"), ("n", "<i4")])


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; with fewer words the whole sequence is one."""
    words = word_hashes(data.lower())[0]  # bytes: lower() changes A-Z alone
    if 0 < len(words) < SHINGLE:
        return mix(runs(words, len(words)) ^ np.uint64(len(words)))
    return np.unique(runs(words, SHINGLE))


def sketch(own: np.ndarray) -> bytes:
    """A bit for each of a power of two of residues: whether the set has an odd number of tokens there.

    A token that only one of two sets has changes one bit, so that the sketches differ in no more bits than the sets
    in tokens.
    """
    if not len(own):
        return b""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ; the halves of the larger one are added until both have the same size."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    while len(x) < len(y):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _digest(own: np.ndarray) -> str:
    return hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else ""


def _code(digest: str) -> int:
    """A set's node where its doc_id cannot be."""
    return int.from_bytes(bytes.fromhex(digest[:16]), "little", signed=True)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document and, from each task, its frequent tokens by lossy counting."""
    tokens, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    waiting, n_waiting = np.empty(HELD, dtype=np.uint64), 0  # one buffer: many small arrays would break up the memory

    def settle(least: int, more: np.ndarray) -> None:
        nonlocal tokens, counts
        every = np.concatenate([tokens, more])
        n = np.concatenate([counts, np.ones(len(more), dtype=np.int64)])
        tokens, slot = np.unique(every, return_inverse=True)
        counts = np.bincount(slot, weights=n, minlength=len(tokens)).astype(np.int64)
        keep = counts >= least
        tokens, counts = tokens[keep], counts[keep]

    for b in batches:
        out = []
        for group in gathered(b["text"]):
            for i, data in group:
                own = shingles(data)
                digest = _digest(own)
                out.append((b["doc_id"].iloc[i], len(own), digest, _code(digest), sketch(own)))
                if n_waiting + len(own) > HELD:
                    settle(2, waiting[:n_waiting])
                    n_waiting = 0
                    if len(own) > HELD:
                        settle(1, own)
                        continue
                waiting[n_waiting : n_waiting + len(own)] = own
                n_waiting += len(own)
        yield pd.DataFrame(out, columns=["doc_id", "n", "digest", "code", "sketch"]).assign(kind=DOCS, token=0, row_key=b["row_key"].to_numpy())
        give_back()
    if n_waiting or len(tokens):
        settle(TASK_LEAST, waiting[:n_waiting])
        top = np.argsort(-counts, kind="stable")[:TASK_FREQUENT]
        yield pd.DataFrame({"token": tokens[top].view(np.int64), "n": counts[top], "kind": TOKENS, "digest": "", "code": 0, "doc_id": None, "row_key": 0, "sketch": None})


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, order: np.uint64) -> np.ndarray:
    """The first tokens of the set under an order: rare before frequent, then by a hash of the order's own.

    Sets with the similarity share at least one of these, whatever the order.
    """
    at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
    often = np.where(common[at] == own, rank[at], 0) if len(common) else np.zeros(len(own), dtype=np.int64)
    return own[np.lexsort((mix(own ^ order), often))[: len(own) + (-len(own) * PERCENT) // 100 + 1]]


def _post(batches: Iterator[pd.DataFrame], common: np.ndarray, rank: np.ndarray, buckets: int) -> Iterator[pd.DataFrame]:
    """Prefix tokens by order and bucket: a token's bucket, or for those of the table of frequent ones any bucket.

    A token is known by its place in that table, or by its bucket and 40 bits of its hash.
    """
    tokens, places, bucket, n = np.empty(HELD, dtype=np.uint64), np.empty(HELD, dtype=PLACE), np.empty(HELD, dtype=np.int64), 0

    def packed(tokens: np.ndarray, places: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
        order = np.argsort(bucket, kind="stable")
        kinds, cuts = np.unique(bucket[order], return_index=True)
        low, rows = tokens[order].view(np.uint8).reshape(-1, 8)[:, :5], places[order]
        spans = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        return pd.DataFrame({"kind": kinds // buckets, "bucket": kinds % buckets, "tokens": [low[x].tobytes() for x in spans], "places": [rows[x].tobytes() for x in spans]})

    for b in batches:
        for group in gathered(b["text"]):
            for i, data in group:
                own = shingles(data)
                if not len(own):
                    continue
                node = _code(_digest(own)) if b["coded"].iloc[i] else int(b["doc_id"].iloc[i])
                for k, order in enumerate(ORDERS):
                    first = prefix(own, common, rank, order)
                    place = np.empty(len(first), dtype=PLACE)
                    place["node"], place["pos"], place["n"] = node, np.arange(len(first)), len(own)
                    where = ((first >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64) + k * buckets
                    if len(common):
                        at = np.minimum(np.searchsorted(common, first), len(common) - 1)
                        often = common[at] == first
                        where = np.where(often, hash(node) % buckets + (k + len(ORDERS)) * buckets, where)
                        first = np.where(often, at.astype(np.uint64), first)
                    if n + len(first) > HELD:
                        yield packed(tokens[:n], places[:n], bucket[:n])
                        n = 0
                    if len(first) > HELD:
                        yield packed(first, place, where)
                        continue
                    at = slice(n, n + len(first))
                    tokens[at], places[at], bucket[at] = first, place, where
                    n += len(first)
        give_back()
    if n:
        yield packed(tokens[:n], places[:n], bucket[:n])


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one kind and bucket, pairs of nodes (other is set) for each token that few have, and postings of the others.

    Tokens of one node end here. A pair passes if the token's places leave room for the similarity: what both share
    lies before both places, after both, or here.
    """
    sizes = [len(x) // 5 for x in pdf["tokens"]]
    low = np.zeros((sum(sizes), 8), dtype=np.uint8)
    low[:, :5] = np.frombuffer(b"".join(pdf["tokens"]), dtype=np.uint8).reshape(-1, 5)
    tokens = low.reshape(-1).view("<u8")
    places = np.frombuffer(b"".join(pdf["places"]), dtype=PLACE)
    kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
    order = np.lexsort((places["node"], tokens))
    t, node = tokens[order], places["node"][order]
    once = np.concatenate([[True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])])
    order, t = order[once], t[once]
    here = places[order]
    parts = []
    dense = np.ones(len(t), dtype=bool)
    if kind < len(ORDERS):
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        dense = np.repeat(np.diff(np.append(heads, len(t))) > PAIRED, np.diff(np.append(heads, len(t))))
        for step in range(1, min(PAIRED, len(t))):
            i = np.flatnonzero((t[step:] == t[:-step]) & ~dense[step:])
            if not len(i):
                break
            a, b = here[i], here[i + step]
            n_a, n_b = a["n"].astype(np.int64), b["n"].astype(np.int64)
            most = np.minimum(a["pos"], b["pos"]) + np.minimum(n_a - a["pos"], n_b - b["pos"])
            near = (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)) & ((100 + PERCENT) * most >= PERCENT * (n_a + n_b))
            a, b = a[near], b[near]
            parts.append(pd.DataFrame({"token": 0, "node": a["node"], "pos": 0, "n": a["n"], "other": b["node"], "n_other": b["n"]}))
    flag = np.int64(bucket % (1 << 22)) << 40 if kind < len(ORDERS) else np.int64(1) << 62
    own = here[dense]
    parts.append(pd.DataFrame({"token": t[dense].astype(np.int64) | flag, "node": own["node"], "pos": own["pos"], "n": own["n"], "other": pd.array([None] * len(own), dtype="Int64"), "n_other": 0}))
    out = pd.concat([x.astype({"other": "Int64"}) for x in parts], ignore_index=True).assign(order=kind % len(ORDERS))
    give_back()
    return out[["order", "token", "node", "pos", "n", "other", "n_other"]]


def _enough(common: Column, a: Column, b: Column) -> Column:
    """Whether so many common tokens give sets of these sizes the similarity."""
    return (100 + PERCENT) * common >= PERCENT * (a + b)


def _apart(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs (node, hub), each once, with n, n_hub and apart, at most the distance of their sets.

    Sketches (node, n, sketch) are a small part of the sets, and the others of them stay where they are.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            apart = [differing(x, y) for x, y in zip(b["sketch"], b["sketch_hub"], strict=True)]
            yield b[["node", "hub", "n", "n_hub"]].assign(apart=apart)

    wanted = materialize(pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct())
    few = among(sketches, wanted, "node").where("may").drop("may").join(wanted, "node", "left_semi")
    few = materialize(few.dropDuplicates(["node"]))
    hubs = few.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("sketch").alias("sketch_hub"))
    small_batches(pairs.sparkSession)
    return materialize(pairs.join(few, "node").join(hubs, "hub").mapInPandas(compare, "node long, hub long, n long, n_hub long, apart long"))


def _sets(named: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """node, own, the sorted shingles, and to, of the wanted nodes (node, to); named has doc_id, text and coded."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [shingles((t or "").encode("utf-8", "surrogatepass")) for t in b["text"]]
            node = [_code(_digest(x)) if c else d for d, c, x in zip(b["doc_id"], b["coded"], own, strict=True)]
            yield pd.DataFrame({"node": node, "own": [x.tobytes() for x in own], "to": b["to"]})
            give_back()

    wanted = materialize(wanted)
    ids = wanted.withColumnRenamed("node", "doc_id")
    plain = among(named.where("not coded"), ids.select("doc_id"), "doc_id").where("may").drop("may")
    rows = plain.join(ids.hint("merge"), "doc_id").select("doc_id", "text", "coded", "to")
    if repeated:  # the nodes of these are not known before their texts are read
        rows = rows.unionByName(named.where("coded").select("doc_id", "text", "coded", F.lit(None).cast(TO).alias("to")))
    small_batches(named.sparkSession)
    found = materialize(rows.mapInPandas(read, f"node long, own binary, to {TO}"))
    return materialize(found.drop("to").dropDuplicates(["node"]).join(wanted, "node")) if repeated else found


def _overlap(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of sets of hubs and of those that meet them: node, hub and how many tokens both have."""
    is_hub = pdf["node"].to_numpy() == pdf["hub"].to_numpy()
    hubs = {h: np.frombuffer(x, dtype=np.uint64) for h, x in zip(pdf["hub"][is_hub], pdf["own"][is_hub], strict=True)}
    rest = pdf[~is_hub]
    both = []
    for h, x in zip(rest["hub"], rest["own"], strict=True):
        hub, x = hubs[h], np.frombuffer(x, dtype=np.uint64)
        at = np.minimum(np.searchsorted(hub, x), len(hub) - 1)
        both.append(int((hub[at] == x).sum()))
    out = pd.DataFrame({"node": rest["node"], "hub": rest["hub"], "both": both, "n": [len(x) // 8 for x in rest["own"]], "n_hub": [len(hubs[h]) for h in rest["hub"]]})
    give_back()
    return out


def _overlaps(pairs: DataFrame, read: Callable[[DataFrame], DataFrame], before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """pairs (node, hub), each once, with what their sets have in common: both, n, n_hub; and all sets read so far.

    A hub's set travels once to every FANNED pairs, any other once to each of its hubs. Sets are read with the list of
    where they go, so they are shuffled once; before has those that were read already.
    """
    spark = pairs.sparkSession
    fans = materialize(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / FANNED).cast("int").alias("fans")))
    met = pairs.join(fans, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("fans")).cast("int").alias("fan"))
    hubs = fans.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"))
    to = materialize(met.unionByName(hubs).groupBy("node").agg(F.collect_list(F.struct("hub", "fan")).cast(TO).alias("to")))
    if before is None:
        sent = own = read(to)
    else:
        new = read(to.join(before.select("node"), "node", "left_anti"))
        sent = new.unionByName(before.drop("to").join(to.hint("merge"), "node"))
        own = new.unionByName(before)
    sent = sent.select("node", "own", F.explode("to").alias("at")).select("node", "own", "at.hub", "at.fan")
    weight = pairs.count() * (own.agg(F.avg(F.octet_length("own"))).first()[0] or 0)
    groups = max(2 * shuffle_partitions(spark), int(weight / BLOCK_BYTES))
    dealt = sent.withColumn("at", F.pmod(F.xxhash64("hub", "fan"), F.lit(groups))).select("at", "node", "hub", "own")
    small_batches(spark)
    return materialize(dealt.groupBy("at").applyInPandas(_overlap, "node long, hub long, both long, n long, n_hub long")), own


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row doc_id, n_shingles, n_links, component_id, and row_key and group_key.

    A-Z are lower-cased; words are runs of other than ASCII white space; a set holds the distinct five-word
    shingles of the whole text, or the whole sequence of fewer words. Documents link at a Jaccard similarity of
    0.75 or more; those without words link with nothing. component_id is the smallest doc_id that links lead to.
    n_links is the number of other sets in the table with the similarity to the row's own, however many documents
    have each. Rows without a doc_id are alone; rows that share one are documents of their own. row_key, the xxhash64
    of doc_id and text, tells rows apart; group_key tells components apart even where they share a component_id, and is
    null where there is no set or no doc_id.

    Equal sets form a class, one node. Each order posts the prefix tokens of the nodes; a token's postings are
    packed by bucket, and those with one node end there. The nodes of a token that few have are paired there; candidates
    must share tokens in the prefixes of both orders, as many as the sizes ask for. Tokens of many nodes make stars: a
    node whose prefix is largely that of another, more central one moves to that one's star, if their sets are half
    alike at least. Stars are ranked by size, and a node is a candidate of a larger star, not of each of its nodes,
    where under both orders a token of many can be the first that they share.
    Before a candidate's set travels, its sketch is compared with that of the star's centre: bits of parity, which
    differ in no more places than the sets in tokens, so that no link is lost and most candidates that are none end there.
    The overlap with the star's centre, of a star of one node the pair itself, is then counted. With d the size of the
    symmetric difference, a link asks for 7 d <= the sum of the sizes, and d of two nodes is at least the difference of
    their d to the centre: so only nodes near enough visit the star. Last, the nodes of a star meet each other and its
    visitors in pairs of blocks, each pair of nodes in the one star that is the larger of theirs; only sums and a
    spanning forest leave a task. So what travels for a group of near copies is in proportion to its size, but for the
    copies of blocks, one for every BLOCK sets of the star. Frequent tokens come last in both orders; the table of them
    is bounded, and any table keeps the result exact.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
        survey = materialize(keyed.mapInPandas(_survey, "doc_id long, n long, digest string, code long, kind int, token long, row_key long, sketch binary"))
    sets = survey.where(F.col("kind") == DOCS).select("doc_id", "n", "digest", "code", "row_key")
    often = survey.where(F.col("kind") == TOKENS).groupBy("token").agg(F.sum("n").alias("n"))
    table = often.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    common = table["token"].to_numpy(dtype=np.int64).view(np.uint64)
    up = np.argsort(common)
    common, rank = common[up], table["n"].to_numpy(dtype=np.int64)[up]

    known = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    ids = materialize(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), (F.min("code") != F.max("code")).alias("odd")).where("rows > 1"))
    repeated = not ids.isEmpty()
    odd = ids.where("odd").select("doc_id")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("code").alias("code"), F.count(F.lit(1)).alias("size"))
    if repeated:
        coded = known.join(odd, "doc_id", "left_semi").select("digest").distinct().withColumn("coded", F.lit(True))
        classes = classes.join(coded, "digest", "left").withColumn("node", F.when(F.col("coded"), F.col("code")).otherwise(F.col("rep")))
    else:
        classes = classes.withColumn("node", F.col("rep"))
    classes = materialize(classes.select("digest", "node", "rep", "size"))
    hot = frequent(known.select("digest"), "digest")
    copies = spread_join(known.select("doc_id", "digest"), classes.where("size > 1 or node != rep"), "digest", hot)
    skipped = copies.where("doc_id != node").select("doc_id").distinct()
    special = materialize(skipped.join(odd, "doc_id", "left_anti").withColumn("coded", F.lit(False)).unionByName(odd.withColumn("coded", F.lit(True))))

    # Most documents are the only ones of their class and stay where they are; the others are joined with what they are.
    near = among(docs.where(F.col("doc_id").isNotNull()), special, "doc_id")
    apart = near.where("may").join(special.hint("merge"), "doc_id", "left").where("coded is null or coded")
    apart = materialize(apart.withColumn("coded", F.coalesce("coded", F.lit(False))))  # it is read for each set of sets
    named = near.where("not may").withColumn("coded", F.lit(False)).unionByName(apart).drop("may")
    total = int(known.agg(F.sum("n")).first()[0] or 0) * (100 - PERCENT) // 100
    buckets = max(2 * shuffle_partitions(spark), total // BUCKET)
    posted = named.mapInPandas(partial(_post, common=common, rank=rank, buckets=buckets), "kind int, bucket long, tokens binary, places binary")
    met = posted.groupBy("kind", "bucket").applyInPandas(_meet, "order int, token long, node long, pos int, n int, other long, n_other int")
    with small_batches(spark):
        met = materialize(met)
    postings = met.where("other is null").select("order", "token", "node", "pos", "n")
    facts = materialize(postings.groupBy("node").agg(F.max("n").alias("n"), *[_of_order(k, f"d{k}") for k in (0, 1)]))
    pairs = _paired(met.where("other is not null"), facts)

    read = partial(_sets, named, repeated=repeated)
    held = survey.where((F.col("kind") == DOCS) & F.col("doc_id").isNotNull() & (F.col("n") > 0))
    sketches = held.select(F.col("doc_id").alias("node"), "n", "sketch")
    if repeated:
        sketches = sketches.unionByName(held.select(F.col("code").alias("node"), "n", "sketch"))
    homes, own = _homes(postings, facts, sketches, read)
    edges, counts = _across(postings, facts, pairs, homes, own, sketches, read)
    return _labelled(sets, known.drop("code"), classes, hot, edges, counts, repeated)


def _of_order(k: int, name: str) -> Column:
    return F.count(F.when(F.col("order") == k, 1)).alias(name)


def _paired(met: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (node, other) with c0 and c1, the tokens at which they met; those that cannot be alike go.

    What two nodes share of their prefixes is at most what they met at and the postings (d0, d1) that the one with
    fewer has among the tokens of many.
    """
    counted = met.groupBy("node", "other").agg(_of_order(0, "c0"), _of_order(1, "c1"), F.max("n").alias("n"), F.max("n_other").alias("n_other"))
    counted = materialize(counted)
    beyond = F.ceil(F.greatest("n", "n_other") * PERCENT / 100)  # one more than that, as two tokens may look alike when cut to their posted bits
    fits = lambda more: _enough(F.col("c0") + more[0] + beyond, F.col("n"), F.col("n_other")) & _enough(F.col("c1") + more[1] + beyond, F.col("n"), F.col("n_other")) & (F.col("c0") + more[0] > 0) & (F.col("c1") + more[1] > 0)
    alone = fits((F.lit(0), F.lit(0)))
    dense = [facts.select(F.col("node").alias(key), *[F.col(f"d{k}").alias(f"d{k}_{key}") for k in (0, 1)]) for key in ("node", "other")]
    rest = counted.where(~alone).join(dense[0], "node").join(dense[1], "other")
    more = [F.least(f"d{k}_node", f"d{k}_other") for k in (0, 1)]
    return materialize(counted.where(alone).unionByName(rest.where(fits(more)).select(*counted.columns)))


def _homes(postings: DataFrame, facts: DataFrame, sketches: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """node, star, n and d, the distance to the star's centre, of nodes in stars of two or more; and sets read for it.

    Of a token's nodes the one whose prefix others share most speaks for the token; a node chooses, among those
    who speak for most of its tokens, the one that most nodes look to. Any choice keeps the result exact.
    """
    rows = postings.where("order = 0").select("token", "node")
    central = F.struct((F.col("d0") / F.col("n")).alias("share"), (-F.col("node")).alias("least"))
    speakers = materialize(rows.join(facts.select("node", "n", "d0"), "node").groupBy("token").agg(F.max_by("node", central).alias("hub"), F.count(F.lit(1)).alias("df")).where("df > 1").drop("df"))
    votes = materialize(rows.join(speakers, "token").where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("k")))
    most = votes.groupBy("node").agg(F.max("k").alias("most"))
    likely = materialize(votes.join(most, "node").where("2 * k >= most").join(facts.select("node", "n"), "node").where("32 * k >= n").select("node", "hub", "k"))
    looked = materialize(likely.groupBy("hub").agg(F.count(F.lit(1)).alias("followers")))
    chosen = likely.join(looked, "hub").groupBy("node").agg(F.max_by("hub", F.struct("followers", "k", -F.col("hub"))).alias("hub"))
    near = _apart(materialize(chosen), sketches).where("3 * apart <= n + n_hub")  # as for a half of the union below
    met, own = _overlaps(materialize(near.select("node", "hub")), read)
    half = materialize(met.where("3 * both >= n + n_hub"))  # a half of the union
    centres = materialize(half.select(F.col("hub").alias("node"), F.col("n_hub").alias("n")).distinct())
    moved = half.join(centres.select("node"), "node", "left_anti").select("node", F.col("hub").alias("star"), "n", (F.col("n") + F.col("n_hub") - 2 * F.col("both")).alias("d"))
    homes = moved.unionByName(centres.select("node", F.col("node").alias("star"), "n", F.lit(0).cast("long").alias("d")))
    sizes = homes.groupBy("star").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(homes.join(materialize(sizes), "star")), own


def _across(postings: DataFrame, facts: DataFrame, pairs: DataFrame, homes: DataFrame, own: DataFrame, sketches: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect what links connect, and links by node.

    pairs holds all that can link and met at a token of few; what the tokens of many find besides shares no other, so
    that the first token which it shares, in either order, is one of theirs.
    """
    seats = homes.select("node", "star", "size")
    at_home = lambda rows: rows.join(seats, "node", "left").withColumns({"star": F.coalesce("star", "node"), "size": F.coalesce("size", F.lit(1))})
    larger = (F.col("size_s") > F.col("size")) | ((F.col("size_s") == F.col("size")) & (F.col("hub") < F.col("star")))

    placed = materialize(at_home(postings.join(facts.select("node", "d0", "d1"), "node")))
    grouped = placed.groupBy("order", "token", "star").agg(
        F.max("size").alias("size_s"), F.max(_room()).alias("room_s"), F.min("n").alias("least_s"), F.max("n").alias("most_s"), *[F.max(f"d{k}").alias(f"d{k}_s") for k in (0, 1)]
    )
    grouped = materialize(grouped.withColumnRenamed("star", "hub"))
    dense = placed.join(grouped, ["order", "token"]).where(larger & _reach())
    dense = dense.groupBy("node", "hub").agg(_of_order(0, "c0"), _of_order(1, "c1")).where("c0 > 0 and c1 > 0")

    # A pair counts for the node of the smaller star and the other's star.
    there = seats.select(F.col("node").alias("other"), F.col("star").alias("hub"), F.col("size").alias("size_s"))
    both = at_home(pairs).join(there, "other", "left").withColumns({"hub": F.coalesce("hub", "other"), "size_s": F.coalesce("size_s", F.lit(1))})
    both = both.where("star != hub").withColumn("up", larger)
    sparse = both.select(F.when(F.col("up"), F.col("node")).otherwise(F.col("other")).alias("node"), F.when(F.col("up"), F.col("hub")).otherwise(F.col("star")).alias("hub"))
    pairs = materialize(dense.select("node", "hub").unionByName(sparse).distinct())
    reach = materialize(homes.groupBy("star").agg(F.max(7 * F.col("d") + F.col("n")).alias("reach")))
    near = _apart(pairs, sketches).join(reach.withColumnRenamed("star", "hub"), "hub", "left")
    near = near.where(7 * F.col("apart") - F.col("n") <= F.coalesce("reach", "n_hub"))
    met, own = _overlaps(materialize(near.select("node", "hub")), read, own)
    own = own.select("node", "own")

    told = materialize(met.join(reach.withColumnRenamed("star", "hub"), "hub", "left"))
    linked = told.where(F.col("reach").isNull() & (F.col("both") > 0) & _enough(F.col("both"), F.col("n"), F.col("n_hub"))).select("node", "hub")
    distance = F.col("n") + F.col("n_hub") - 2 * F.col("both")
    visitors = told.where(F.col("reach").isNotNull() & (7 * distance - F.col("n") <= F.col("reach"))).select("node", F.col("hub").alias("star"), F.lit(True).alias("visits"))

    every = materialize(homes.select("node", "star", F.lit(False).alias("visits")).unionByName(visitors))
    theirs = among(own, every.select("node"), "node").where("may").drop("may")  # the other sets stay where they are
    every = materialize(every.join(theirs, "node"))
    inside = materialize(_blocks(every))
    edges = linked.select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(inside.select(F.col("node").alias("a"), F.col("root").alias("b")))
    one = F.lit(1).cast("long").alias("links")
    counts = linked.select("node", one).unionByName(linked.select(F.col("hub").alias("node"), one)).unionByName(inside.select("node", "links"))
    return materialize(edges), counts.groupBy("node").agg(F.sum("links").alias("n_links"))


def _room() -> Column:
    """The places from pos on, less what the set's own size asks of them; a similar set asks for as much again by its size."""
    return (100 + PERCENT) * (F.col("n") - F.col("pos")) - PERCENT * F.col("n")


def _reach() -> Column:
    """Whether a set and one of a star's can be alike and share a token at these places (n, pos) as their first.

    What they share then lies in each from its place on (room_s: most room in a set of the star, less its size); and of
    what both prefixes hold, under either order, they share no more than the postings (d0, d1) that the one with fewer
    has among the tokens of many. Of a star (with _s) the most favourable value of each counts. A token that looks like
    an earlier one of its set, when cut to its posted bits, has that one's place. One is allowed in d0 and d1 for it.
    """
    n, least, most = F.col("n"), F.col("least_s"), F.col("most_s")
    first = (_room() >= PERCENT * least) & (F.col("room_s") >= PERCENT * n)
    beyond = F.ceil(F.greatest(n, most) * PERCENT / 100)
    shared = [_enough(F.least(f"d{k}", f"d{k}_s") + beyond, n, least) & (F.least(f"d{k}", f"d{k}_s") > 0) for k in (0, 1)]
    return (100 * n >= PERCENT * least) & (100 * most >= PERCENT * n) & first & shared[0] & shared[1]


def _blocks(every: DataFrame) -> DataFrame:
    """node, links and root: sums of links and forests of the stars' sets (star, node, visits, own).

    A star's sets are dealt into blocks, and each pair of its blocks is a group of its own, as is each block of its
    visitors with each of its blocks. Stars of one block share groups, as many as keep these at the size of a block.
    """
    spark = every.sparkSession
    load = lambda side: F.greatest(F.lit(1), F.ceil(F.greatest(F.count(F.when(side, 1)) / BLOCK, F.coalesce(F.sum(F.when(side, F.octet_length("own"))), F.lit(0)) / BLOCK_BYTES))).cast("int")
    sizes = materialize(every.groupBy("star").agg(load(~F.col("visits")).alias("b"), load(F.col("visits")).alias("v"), F.sum(F.octet_length("own")).alias("bytes")))
    small = (F.col("b") == 1) & (F.col("v") == 1)
    groups = max(2 * shuffle_partitions(spark), -(-(sizes.where(small).agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    dealt = every.join(sizes.drop("bytes"), "star").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("visits"), F.col("v")).otherwise(F.col("b"))).cast("int"))
    alone = dealt.where(small).select("star", "node", "visits", "own", F.pmod(F.xxhash64("star"), F.lit(groups)).alias("at"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("mixed"), F.lit(0).alias("block"))
    large = dealt.where(~small)
    among = large.where("not visits").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    among = among.select("star", "node", "visits", "own", F.col("star").alias("at"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(False).alias("mixed"), "block")
    mixed = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("visits"), F.col("b")).otherwise(F.col("v")) - 1)))
    i, j = (F.when(F.col("visits") == side, F.col("block")).otherwise(F.col("other")) for side in (True, False))
    mixed = mixed.select("star", "node", "visits", "own", F.col("star").alias("at"), i.alias("i"), j.alias("j"), F.lit(True).alias("mixed"), "block")
    met = alone.unionByName(among).unionByName(mixed).groupBy("at", "i", "j", "mixed").applyInPandas(_count, "node long, links long, root long")
    with small_batches(spark):
        return materialize(met)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of blocks, or of several whole stars: the links of each node and a root for each that has any."""
    nodes, counts, roots = [], [], []

    def meet(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> None:
        if not len(a) or not len(b):
            return
        alike = _alike(*[[np.frombuffer(x, dtype=np.uint64) for x in side["own"]] for side in (a, b)])
        if same:
            np.fill_diagonal(alike, False)
        x, y = a["node"].to_numpy(dtype=np.int64), b["node"].to_numpy(dtype=np.int64)
        found = list(zip((x, y), (alike.sum(axis=1), alike.sum(axis=0)), _roots(x, y, alike), strict=True))
        for side, links, root in found[: 1 if same else 2]:
            nodes.append(side)
            counts.append(links)
            roots.append(root)

    i, j, mixed = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), bool(pdf["mixed"].iloc[0])
    for _, part in pdf.groupby("star", sort=False):
        visits = part["visits"].to_numpy(dtype=bool)
        members, visitors = part[~visits], part[visits]
        if mixed:
            meet(visitors, members, False)
        elif i == j:
            meet(members, members, True)
            meet(visitors, members, False)
        else:
            block = members["block"].to_numpy()
            meet(members[block == i], members[block == j], False)
    if not nodes:
        return pd.DataFrame({"node": [], "links": [], "root": []}, dtype=np.int64)
    out = pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(counts), "root": np.concatenate(roots)})
    give_back()
    return out[out["links"] > 0]


def _roots(x: np.ndarray, y: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of both sides the smallest that links lead to."""
    most = np.iinfo(np.int64).max
    root_x, root_y = x.copy(), y.copy()
    while True:
        new_y = np.minimum(root_y, np.where(alike, root_x[:, None], most).min(axis=0))
        new_x = np.minimum(root_x, np.where(alike, new_y[None, :], most).min(axis=1))
        if (new_x == root_x).all() and (new_y == root_y).all():
            return new_x, new_y
        root_x, root_y = new_x, new_y


def _alike(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of a have the similarity with which of b, as a matrix of truth values."""
    n_a, n_b = (np.array([len(x) for x in s], dtype=np.int64) for s in (a, b))
    both = np.zeros((len(a), len(b)), dtype=np.int32)
    tokens = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(tokens):
        return both > 0
    sides = []
    for sets, n in ((a, n_a), (b, n_b)):
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(tokens, every), len(tokens) - 1)
        held = tokens[at] == every
        at, row = at[held], np.repeat(np.arange(len(n)), n)[held]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], np.bincount(at, minlength=len(tokens))))
    (at_a, row_a, df_a), (at_b, row_b, df_b) = sides
    few = df_a * df_b * 64 <= both.size  # cheaper pair by pair than as a column of the matrix
    flat, first_b = both.reshape(-1), np.cumsum(df_b) - df_b
    own = few[at_a]
    rows, token = row_a[own], at_a[own]
    ends = np.cumsum(df_b[token])
    start = 0
    while start < len(rows):  # by parts, so that the pairs of a part are few
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), side="right")))
        k = df_b[token[start:stop]]
        within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        flat += np.bincount(np.repeat(rows[start:stop], k) * len(b) + row_b[np.repeat(first_b[token[start:stop]], k) + within], minlength=both.size).astype(np.int32)
        start = stop
    many = np.flatnonzero(~few)
    column = np.cumsum(~few) - 1
    for lo in range(0, len(many), STRIP):  # sums of a strip are exact in single precision
        width = min(STRIP, len(many) - lo)
        strips = []
        for (at, row, _), n in zip(sides, (n_a, n_b), strict=True):
            held = ~few[at]
            at, row = column[at[held]], row[held]
            part = slice(*np.searchsorted(at, [lo, lo + width]))
            strip = np.zeros((len(n), width), dtype=np.float32)
            strip[row[part], at[part] - lo] = 1
            strips.append(strip)
        both += (strips[0] @ strips[1].T).astype(np.int32)
    return (both > 0) & (100 * both.astype(np.int64) >= PERCENT * (n_a[:, None] + n_b[None, :] - both))


def _labelled(sets: DataFrame, known: DataFrame, classes: DataFrame, hot: DataFrame, edges: DataFrame, counts: DataFrame, repeated: bool) -> DataFrame:
    """The result per row from the nodes' labels."""
    whole = classes.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    if repeated:  # labels are the smallest nodes, which need not be a doc_id
        whole = materialize(whole)
        whole = whole.join(materialize(whole.groupBy("label").agg(F.min("rep").alias("component_id"))), "label")
    else:
        whole = whole.withColumn("component_id", F.col("label"))
    zero = F.lit(0).cast("long")
    whole = whole.join(counts, "node", "left").select("digest", "component_id", F.col("label").alias("group_key"), F.coalesce("n_links", zero).alias("n_links"))
    joined = spread_join(known, whole, "digest", hot)
    rest = sets.drop("code").where(F.col("doc_id").isNull() | (F.col("n") == 0)).withColumns({"component_id": F.col("doc_id"), "n_links": zero, "group_key": F.lit(None).cast("long")})
    return joined.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "n_links", "component_id", "row_key", "group_key")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM t),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
k AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS hits, any_value(a.n) AS na, any_value(b.n) AS nb FROM k a JOIN k b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 175 * hits >= 75 * (na + nb)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(d.n_links, 0)::BIGINT AS n_links, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.node = c.rep LEFT JOIN d ON d.a = c.rep
"""
