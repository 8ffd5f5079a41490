"""SentencePiece encoding and decoding by a word lattice."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_or_empty
from foliant.llm.wordhash import BASE, INVERSE, mix, powers

SPACE_MARK = "▁"
#: Words of more characters are merged with a queue, one by one.
LONG = 96
#: Words whose ids a task keeps; then it starts anew.
KEPT = 400_000
#: Characters of the texts worked on at once, and of the new words.
TEXTS, WORDS = 1 << 21, 1 << 19
SLOTS = 1 << 21
UNKNOWN_PENALTY = 10.0

UNITS = re.compile(f"\n|{SPACE_MARK}+[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+")


class Codec:
    """The pieces of a model file with what encodes words by them.

    BPE models merge the neighbours whose joint piece has the best score, leftmost first; unigram models take the
    path with the best sum. Both read the same lattice: for every place and length of a word, the piece there.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        odd = [p.piece for p in proto.pieces if p.type in (4, 5)]  # user-defined and unused ones
        if trainer.model_type not in (1, 2) or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or odd:
            raise ValueError("only BPE and unigram models without normalisation and user-defined pieces are read")
        self.bpe, self.dummy, self.unk = trainer.model_type == 2, normal.add_dummy_prefix, model.unk_id()
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}|.\n|\n.", p.piece, re.S) for _, p in plain):
            raise ValueError("a piece reaches over the start of a word")
        self.surface = [SPACE_MARK.join(p.piece.split(SPACE_MARK)) if p.type == 1 else "" for p in proto.pieces]
        self.surface = [s.replace(SPACE_MARK, " ") for s in self.surface]
        self.surface[self.unk] = " ⁇ "
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(len(p.piece) for _, p in plain)
        self.scores = np.array([p.score for p in proto.pieces], dtype=np.float64)
        self.ids = {p.piece: i for i, p in plain}
        self.least = min(p.score for _, p in plain)
        # The piece table as a hash table over slots; pieces that find theirs taken go to the next one.
        hashes = np.array([self._hash(p.piece) for _, p in plain], dtype=np.uint64)
        if len(set(hashes.tolist())) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.slot_hash, self.slot_id, self.steps = np.zeros(SLOTS, dtype=np.uint64), np.full(SLOTS, -1, dtype=np.int32), 1
        for h, (i, _) in zip(hashes, plain, strict=True):
            at, n = int(h) % SLOTS, 1
            while self.slot_id[at] >= 0:
                at, n = (at + 1) % SLOTS, n + 1
            self.slot_hash[at], self.slot_id[at], self.steps = h, i, max(self.steps, n)
        self.known: dict[str, list[int]] = {}

    def _hash(self, piece: str) -> int:
        codes = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4")
        return int(self._spans(codes, np.array([0]), np.array([len(codes)]))[0])

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes) + 1)[: len(codes)], out=sums[1:])
        return sums

    def _spans(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self._sums(codes) if sums is None else sums
        return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))

    def _join(self, hashes: np.ndarray) -> np.ndarray:
        """Equi-join of substrings with the piece table: the piece's id, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        at = (hashes % np.uint64(SLOTS)).astype(np.int64)
        for _ in range(self.steps):
            hit = self.slot_hash[at] == hashes
            out[hit] = self.slot_id[at[hit]]
            at = (at + 1) % SLOTS
        return out

    def lattice(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Edges of all words: the id of the piece at each place (row) of each length (column), or -1.

        ends: for each place the end of its word. Substrings up to the longest piece are joined, length by length.
        """
        edges = np.full((len(codes), self.longest + 1), -1, dtype=np.int32)
        sums, places = self._sums(codes), np.arange(len(codes))
        for n in range(1, self.longest + 1):
            places = places[places + n <= ends[places]]
            if not len(places):
                break
            edges[places, n] = self._join(self._spans(codes, places, places + n, sums))
        return edges

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (not empty)."""
        out: list[list[int] | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG or not self.bpe]
        for i in set(range(len(words))) - set(short):
            out[i] = self._long(words[i])
        group, size = [], 0
        for i in [*short, None]:
            if i is None or size + len(words[i]) > WORDS and group:
                if group:
                    for j, ids in zip(group, self._batch([words[j] for j in group]), strict=True):
                        out[j] = ids
                group, size = [], 0
            if i is not None:
                group.append(i)
                size += len(words[i])
        return out

    def _batch(self, words: list[str]) -> list[list[int]]:
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        stops = np.cumsum(lengths)
        edges = self.lattice(codes, np.repeat(stops, lengths))
        starts, sizes = (self._merge if self.bpe else self._viterbi)(edges, stops - lengths, lengths)
        found = edges[starts, np.minimum(sizes, self.longest)]
        found[sizes > self.longest] = -1
        cuts = np.searchsorted(starts, stops)
        ids, first, out = found.tolist(), 0, []
        for to in cuts.tolist():
            own = ids[first:to]
            if -1 in own:
                own = self._fallback(own, [chr(codes[s]) for s in starts[first:to]])
            out.append(own)
            first = to
        return out

    def _fallback(self, ids: list[int], chars: list[str]) -> list[int]:
        """Characters without a piece: their bytes, or one unknown for neighbours."""
        out: list[int] = []
        for k, (i, c) in enumerate(zip(ids, chars, strict=True)):
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
            elif not (k and ids[k - 1] == -1):
                out.append(self.unk)
        return out

    def _merge(self, edges: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fold of merges over all words at once: each round joins one pair in every word that still has one."""
        starts = np.arange(int(lengths.sum()))
        sizes = np.ones(len(starts), dtype=np.int64)
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_starts, done_sizes = [], []
        while len(starts):
            total = sizes[:-1] + sizes[1:]
            piece = np.where((word[:-1] == word[1:]) & (total <= self.longest), edges[starts[:-1], np.minimum(total, self.longest)], -1)
            score = np.append(np.where(piece >= 0, self.scores[piece], -np.inf), -np.inf)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.maximum.reduceat(score, heads)
            counts = np.diff(np.append(heads, len(word)))
            open_words = np.repeat(best > -np.inf, counts)
            done_starts.append(starts[~open_words])
            done_sizes.append(sizes[~open_words])
            at = np.flatnonzero(open_words & (score == np.repeat(best, counts)))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at  # leftmost of equals
            sizes[at] += sizes[at + 1] if len(at) else 0
            keep = open_words
            keep[at + 1] = False
            starts, sizes, word = starts[keep], sizes[keep], word[keep]
        starts, sizes = np.concatenate(done_starts), np.concatenate(done_sizes)
        order = np.argsort(starts, kind="stable")
        return starts[order], sizes[order]

    def _viterbi(self, edges: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fold over the places of all words at once: the best path to each place and the length of its last piece."""
        best = np.full(len(edges) + len(lengths), -np.inf)  # one place more than characters a word
        base = firsts + np.arange(len(lengths))
        best[base] = 0
        last = np.zeros(len(best), dtype=np.int64)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero(lengths >= j)
            for n in range(min(j, self.longest), 0, -1):  # of equal paths the one with the longest last piece
                piece = edges[firsts[on] + j - n, n]
                score = np.where(piece >= 0, self.scores[piece], self.least - UNKNOWN_PENALTY if n == 1 else -np.inf)
                value = best[base[on] + j - n] + score
                better = value > best[base[on] + j]
                best[base[on][better] + j], last[base[on][better] + j] = value[better], n
        starts, sizes = [], []
        place, on = lengths.copy(), np.flatnonzero(lengths > 0)
        while len(on):
            n = last[base[on] + place[on]]
            place[on] -= n
            starts.append(firsts[on] + place[on])
            sizes.append(n)
            on = on[place[on] > 0]
        starts, sizes = np.concatenate(starts or [np.zeros(0, int)]), np.concatenate(sizes or [np.zeros(0, int)])
        order = np.argsort(starts, kind="stable")
        return starts[order], sizes[order]

    def _long(self, word: str) -> list[int]:
        """A long word's merges from a queue by score, then place."""
        n = len(word)
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (i := self.ids.get(word[a : b + size[b]])) is not None:
                heapq.heappush(queue, (-self.scores[i], a, size[a], size[b]))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, x, y = heapq.heappop(queue)
            b = after[a]
            if size[a] != x or b >= n or size[b] != y:
                continue
            size[a], size[b], after[a] = x + y, 0, after[b]
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        spans = [(a, size[a]) for a in range(n) if size[a]]
        return self._fallback([self.ids.get(word[a : a + s], -1) for a, s in spans], [word[a] for a, _ in spans])

    def units(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it; line ends are words of their own. They join to the text."""
        marked = text.replace(" ", SPACE_MARK)
        return UNITS.findall(SPACE_MARK + marked if self.dummy else marked) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT:
            self.known.clear()
        units = [self.units(t) for t in texts]
        new = list({u for own in units for u in own} - self.known.keys())
        self.known.update(zip(new, self.words(new), strict=True))
        out = []
        for own in units:
            ids: list[int] = []
            for u in own:
                ids += self.known[u]
            out.append(np.array(ids, dtype=np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        parts, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            parts.append(self.surface[i])
        text = "".join([*parts, raw.decode("utf-8", "replace")])
        return text[1:] if self.dummy and text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _groups(texts: list[str]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > TEXTS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def _encode(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    own = codec(path)
    for b in batches:
        texts = b["text"].to_list()
        for group in _groups(texts):
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[group], "ids": own.encode([texts[i] for i in group])})


def _decode(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    own = codec(path)
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "text": [own.decode(np.asarray(x, dtype=np.int32)) if x is not None else None for x in b["ids"]]})


def _digest(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    own = codec(path)
    for b in batches:
        texts = b["text"].to_list()
        for group in _groups(texts):
            ids = own.encode([texts[i] for i in group])
            same = [own.decode(x) == texts[i] for i, x in zip(group, ids, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[group], "n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "round_trip": same})


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row doc_id and the ids of its text under the model file, as the library gives them.

    A task looks the substrings of its words, up to the longest piece, up in a hash table of the pieces and folds each
    word in arrays, for BPE models by merges, for unigram models by Viterbi; ids of words met before are kept up to a
    bound. lattice.encode_unigram does the latter with Spark's joins. Null texts count as empty and give no ids;
    repeated rows each get a row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(partial(_encode, path=model), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per input row doc_id and the text that the ids spell; null ids give null."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(partial(_decode, path=model), f"doc_id {kind}, text string")


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of pieces, the CRC of the ids, and whether decoding gives the text back."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    return rows.mapInPandas(partial(_digest, path=model), f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean")
