"""Hashes of words and of runs of words, worked out over whole buffers with numpy.

A word is a maximal run of bytes other than ASCII white space. Up to 16 bytes of it are read as two numbers, which
are mixed in turn with its size; longer words have a BLAKE2 digest. No polynomial of the bytes is used: modulo
2 ** 64, words that differ would meet under any base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xD6E8FEB86659FD93
#: Bytes of texts worked on at once, about.
BUFFER = 1 << 20

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_BY_SIZE = [mix(np.arange(18, dtype=np.uint64) + np.uint64(WORD_BASE ^ seed << 32)) for seed in range(2)]


@cache
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, dtype=np.uint64))])


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers; sizes are powers of two, so few are kept."""
    return _powers(base, 1 << max(n - 1, 1).bit_length())


def word_hashes(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word. Hashes under different seeds are independent of each other."""
    buf = np.frombuffer(data, dtype=np.uint8)
    word = ~SPACES[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    eights = np.ndarray(len(data) + 9, dtype="<u8", buffer=data + bytes(16), strides=(1,))
    size = ends - starts
    out = _BY_SIZE[seed][np.minimum(size, 17)]
    out = mix(out ^ (eights[starts] & _MASK[np.minimum(size, 8)]))
    out = mix((out + np.uint64(BASE)) ^ (eights[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]))
    for i in np.flatnonzero(size > 16):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out, starts, ends


def runs(hashes: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every n consecutive word hashes; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n) if n <= 8 else ():
        out = out * np.uint64(base) + hashes[i : i + len(out)]
    if n > 8:  # doubling: runs of 1, 2, 4, ... joined to n
        power, have, done = hashes, 1, 0
        rest = n
        while rest:
            if rest & 1:
                tail = power[done : done + len(out)]
                out = out * np.uint64(pow(base, have, 1 << 64)) + tail
                done += have
            rest >>= 1
            if rest:
                power = power[: len(power) - have] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
                have *= 2
    return mix(out)


def gathered(texts: Iterator, most: int = 4 * BUFFER) -> Iterator[list]:
    """(index, bytes) of texts in groups of about `most` bytes; a longer text alone."""
    group, size = [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > most:
            yield group
            group, size = [], 0
        group.append((i, data))
        size += len(data)
    if group:
        yield group
